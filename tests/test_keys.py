"""Duplicate, null and missing keys; converging or failing fits; exact bins; released caches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldframe.operators import blend, boost, folds, linear, stats
from foldframe.plans import pipelines, registry
from foldframe.sources import io


def _tables(spark):
    oof = spark.createDataFrame([(i, 0.1 * (i % 7) + 0.2 * (i % 2), i % 2) for i in range(40)], "id long, p1 double, y int")
    other = oof.select("id", (F.col("p1") * 0.5 + (F.col("id") % 5) * 0.1).alias("p2"), "y")
    fold = spark.createDataFrame([(i, f, 0.1 * f + 0.01 * i) for i in range(6) for f in range(2)], "id long, fold int, p1 double")
    return oof, other, fold, fold.select("id", "fold", (F.col("p1") * 2).alias("p2"))


def test_pipelines_reject_bad_keys(spark):
    oof, other, f1, f2 = _tables(spark)
    with pytest.raises(ValueError, match="duplicated"):
        pipelines.blend_pipeline([oof, other.unionByName(other.limit(1))], [f1, f2], ["p1", "p2"])
    with pytest.raises(ValueError, match="key"):
        pipelines.blend_pipeline([oof, other.filter("id <> 3")], [f1, f2], ["p1", "p2"])
    with pytest.raises(ValueError, match="key"):
        pipelines.vote_pipeline([oof, other], [f1, f2.filter("NOT (id = 1 AND fold = 0)")], ["p1", "p2"])
    with pytest.raises(ValueError, match="duplicated"):
        blend.stack_predictions(spark.createDataFrame([(1, "a", 0.1), (1, "a", 0.2)], "id long, model string, pred double"), ["a"])
    with pytest.raises(ValueError, match="no prediction"):
        io.submission(f1.select("id").distinct(), oof.filter("id < 2").select("id", F.col("p1").alias("pred")), "y", strict=True)


def test_logistic_converges_or_raises(spark):
    oof, other, _, _ = _tables(spark)
    d = folds.assign_kfold(oof.join(other.drop("y"), "id"), k=2)
    with pytest.raises(RuntimeError, match="passes"):
        linear.fit_logistic_cv(d, ["p1", "p2"], "y", "fold", k=2, max_iter=1)
    far = d.withColumn("p1", F.col("p1") * 1e4)      # plain Newton steps overshoot here
    m = linear.fit_logistic_cv(far, ["p1", "p2"], "y", "fold", C=1e3, k=2, max_iter=200, tol=1e-8)
    assert all(np.isfinite(b) and np.isfinite(w).all() for b, w in m.coefs.values())


def test_registry_knows_its_keys():
    with pytest.raises(ValueError, match="unknown"):
        registry.model_spec({"max_dept": 3})
    for name in registry.REGISTRY:
        p, _ = registry.model_spec(name)
        assert p.n_trees >= 100
    assert registry.model_spec("cls_symmetric_a")[0].n_trees == 1000
    assert registry.model_spec("bin_leafwise_1")[0].min_child_samples == 20


@pytest.mark.parametrize("parts", [1, 7])
def test_bins_are_exact_whatever_the_layout(spark, parts):
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.normal(size=500).round(2), np.zeros(300)])
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,), (float("nan"),)], "v double").repartition(parts)
    cuts = boost.quantile_cuts(df, ["v"], 8)[0]
    s = np.sort(v)
    want = sorted({float(s[-(-i * len(s) // 8) - 1]) for i in range(1, 8)})
    assert cuts == want


def test_missing_values_go_where_the_gain_is(spark):
    rows = [(i, None if i % 3 == 0 else float(i % 10), 0, float(i % 3 == 0 or i % 10 < 3)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, x double, fold int, y double")
    res = boost.fit_boosted(df, ["x"], "y", [boost.ModelSpec("m", F.lit(True))],
                            boost.BoostParams(n_trees=1, max_depth=1, learning_rate=1.0, reg_lambda=0.0))
    split = res.trees[0][0].splits[1]
    assert split.missing_left
    got = {r.id: r.p for r in res.state.select("id", res.prediction(0).alias("p")).collect()}
    assert all(abs(got[i] - y) < 1e-9 for i, _, _, y in rows)
    res.close()


def test_statistics_read_each_column_once(spark):
    df = spark.range(50).select((F.col("id") % 3).alias("a"), (F.col("id") % 5).alias("b"), (F.col("id") % 2).alias("y"))
    out = stats.external_stats(df, [df.drop("y")], ["a", "b"], "y")[0]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan and plan.count("Aggregate") == 2
