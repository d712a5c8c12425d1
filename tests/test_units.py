"""Hand-made edge cases (F-HAND) and properties of folds, encoders and metrics."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldframe.operators import blend, encode, folds, metrics, stats


def test_folds_disjoint_exhaustive_balanced(spark):
    df = spark.range(1003).select(F.col("id"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    out = folds.assign_stratified_kfold(df, "y", k=5, seed=7).toPandas()
    assert len(out) == 1003 and out["id"].is_unique
    sizes = out.groupby("fold").size()
    assert sizes.max() - sizes.min() <= 1
    per_class = out.groupby(["y", "fold"]).size().unstack()
    assert (per_class.max(axis=1) - per_class.min(axis=1)).max() <= 1


def test_folds_layout_independent(spark):
    df = spark.range(500).select("id", (F.col("id") % 2).cast("int").alias("y"))
    a = folds.assign_stratified_kfold(df.repartition(1), "y").toPandas().set_index("id")["fold"]
    b = folds.assign_stratified_kfold(df.repartition(13), "y").toPandas().set_index("id")["fold"]
    assert a.sort_index().equals(b.sort_index())


def test_folds_null_stratum_kept(spark):
    df = spark.createDataFrame([(i, None if i % 4 == 0 else i % 2) for i in range(40)], "id long, y int")
    out = folds.assign_stratified_kfold(df, "y", k=4).toPandas()
    assert len(out) == 40


def test_inner_folds_only_outer_train(spark):
    df = spark.range(200).select("id", (F.col("id") % 2).cast("int").alias("y"))
    base = folds.assign_stratified_kfold(df, "y", k=5)
    inner = folds.assign_inner_folds(base, "y", 5, 5, seed=1).toPandas()
    assert (inner["fold"] != inner["outer"]).all()
    assert len(inner) == 4 * 200
    s = inner.groupby(["outer", "inner"]).size().unstack()
    assert (s.max(axis=1) - s.min(axis=1)).max() <= 1


def _auc_pairs(y, s):
    pos = [a for a, b in zip(s, y) if b == 1]
    neg = [a for a, b in zip(s, y) if b == 0]
    tot = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


def test_auc_exact_with_ties_and_symmetry(spark):
    rng = np.random.RandomState(0)
    y = rng.randint(0, 2, 400).tolist()
    s = np.round(rng.rand(400), 1).tolist()          # many ties
    df = spark.createDataFrame(list(zip(y, s)), "y int, s double")
    auc = metrics.roc_auc(df, "s", "y", n_buckets=4).first()["auc"]
    assert abs(auc - _auc_pairs(y, s)) < 1e-12
    neg = metrics.roc_auc(df.withColumn("s", -F.col("s")), "s", "y").first()["auc"]
    assert abs(neg - (1 - auc)) < 1e-12


def test_auc_all_tied_is_half(spark):
    df = spark.createDataFrame([(i % 2, 0.3) for i in range(10)], "y int, s double")
    assert metrics.roc_auc(df, "s", "y").first()["auc"] == 0.5


def test_auc_layout_independent(spark):
    rng = np.random.RandomState(3)
    rows = [(int(rng.randint(0, 2)), float(rng.rand()), int(i % 3)) for i in range(300)]
    df = spark.createDataFrame(rows, "y int, s double, g int")
    a = metrics.roc_auc(df.repartition(1), "s", "y", by=["g"]).toPandas().sort_values("g")
    b = metrics.roc_auc(df.repartition(13), "s", "y", by=["g"], n_buckets=7).toPandas().sort_values("g")
    assert np.allclose(a["auc"].to_numpy(), b["auc"].to_numpy(), atol=1e-15)


def test_rmse(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0)], "y double, p double")
    assert abs(metrics.rmse(df, "p", "y").first()["rmse"] - math.sqrt(0.5)) < 1e-15


def test_key_stats_drop_null_and_nan_group_zeros(spark):
    df = spark.createDataFrame(
        [(0.0, 1), (-0.0, 0), (float("nan"), 1), (None, 1), (1.5, None), (1.5, 1)], "k double, y int")
    st = stats.key_target_stats(df, ["k"], "y")["k"].toPandas().sort_values("k")
    assert st["k"].tolist() == [0.0, 1.5]                   # NaN and null dropped, +-0 together
    assert st["k_count"].tolist() == [2, 2]                 # rows, null labels included (size)
    assert st["k_mean"].tolist() == [0.5, 1.0]              # mean of non-null labels


def test_external_unseen_is_null(spark):
    ref = spark.createDataFrame([("a", 1), ("a", 0), ("b", 1)], "c string, y int")
    tgt = spark.createDataFrame([(1, "a"), (2, "z"), (3, None)], "id long, c string")
    out = stats.external_stats(ref, [tgt], ["c"], "y")[0].toPandas().sort_values("id")
    assert out["c_mean"].tolist()[0] == 0.5
    assert math.isnan(out["c_mean"].tolist()[1]) and math.isnan(out["c_mean"].tolist()[2])


def test_ordinal_unknown_and_strict(spark):
    fit = spark.createDataFrame([("b",), ("a",), ("c",)], "c string")
    tgt = spark.createDataFrame([(1, "a"), (2, "zz"), (3, None)], "id long, c string")
    out = encode.ordinal_encode(fit, [tgt], ["c"])[0].toPandas().sort_values("id")
    assert out["c"].tolist()[:2] == [0, -1]
    cat = encode.category_encode(fit, [tgt], ["c"])[0].toPandas().sort_values("id")
    assert cat["c"].tolist() == [0, -1, -1]
    with pytest.raises(Exception):
        encode.ordinal_encode(fit, [tgt], ["c"], unknown="error")[0].collect()


def test_target_encode_unseen_and_null_get_prior(spark):
    fit = spark.createDataFrame([("a", 1), ("a", 1), ("b", 0), ("b", 1)], "c string, y int")
    tgt = spark.createDataFrame([(1, "a"), (2, "q"), (3, None)], "id long, c string")
    out = encode.target_encode(fit, [tgt], ["c"], "y", smoothing=2.0)[0].toPandas().sort_values("id")
    g = 0.75
    assert abs(out["c_encoded"].tolist()[0] - (2 + 2 * g) / 4) < 1e-15
    assert out["c_encoded"].tolist()[1:] == [g, g]


def test_oof_encoding_ignores_own_label(spark):
    """With folds fixed and smoothing 0, a row's own label never enters its own encoding."""
    rows = [(i, "abc"[i % 3], int(i % 5 == 0)) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, c string, y int")
    base = folds.assign_kfold(df, k=5, seed=3)
    enc1 = encode.target_encode_oof(base, ["c"], "y", smoothing=0.0).toPandas()
    # flip label of one row; keep folds (inner folds follow labels, so keep strata unchanged)
    flipped = base.withColumn("y", F.when(F.col("id") == 7, 1 - F.col("y")).otherwise(F.col("y")))
    enc2 = encode.target_encode_oof(flipped, ["c"], "y", smoothing=0.0, inner_k=5).toPandas()
    a = enc1[enc1["id"] == 7].set_index("outer")["c_encoded"].sort_index()
    b = enc2[enc2["id"] == 7].set_index("outer")["c_encoded"].sort_index()
    # row 7's inner fold may move with its stratum; when it does not, its value is unchanged
    same_inner = (enc1[enc1.id == 7].set_index("outer")["inner"].sort_index()
                  == enc2[enc2.id == 7].set_index("outer")["inner"].sort_index())
    assert np.allclose(a[same_inner], b[same_inner])


def test_oof_encoding_single_inner_fold_category_is_prior(spark):
    rows = [(i, "common", i % 2) for i in range(50)] + [(999, "rare", 1)]
    df = spark.createDataFrame(rows, "id long, c string, y int")
    base = folds.assign_kfold(df, k=5, seed=1)
    tr = encode.target_encode_oof(base, ["c"], "y", smoothing=1.0).toPandas()
    rare = tr[tr["id"] == 999]
    gm = base.toPandas()
    for _, r in rare.iterrows():
        outer_train = gm[gm["fold"] != r["outer"]]
        assert abs(r["c_encoded"] - outer_train["y"].mean()) < 1e-12


def test_noise_deterministic_and_gaussian(spark):
    from foldframe.functions.hashing import std_normal
    df = spark.range(20000).select(std_normal(F.lit("t"), F.col("id")).alias("z"))
    a = df.toPandas()["z"]
    b = spark.range(20000).repartition(7).select("id", std_normal(F.lit("t"), F.col("id")).alias("z")) \
        .toPandas().sort_values("id")["z"].reset_index(drop=True)
    assert np.allclose(a, b, atol=0)
    assert abs(a.mean()) < 0.03 and abs(a.std() - 1) < 0.03


def test_duplicate_keys_rejected(spark):
    df = spark.createDataFrame([(1, 0.1), (1, 0.2)], "id long, p double")
    with pytest.raises(ValueError):
        blend.assert_unique(df, ["id"])
    blend.assert_unique(df.limit(1), ["id"])


def test_math_features_skip_absent(spark):
    from foldframe.operators.features import math_features
    df = spark.createDataFrame([(3.0,)], "a double")
    out = math_features(df, sin_cols=["a", "missing"], num_cols=["a", "missing"])
    assert out.columns == ["a", "_a_sin", "log_a", "a_sq"]
    r = out.first()
    assert abs(r["_a_sin"] - np.float32(np.sin(2 * np.pi * 3 / 12))) < 1e-7
    assert dict(out.dtypes)["_a_sin"] == "float"


def test_auc_single_class_group_is_null(spark):
    df = spark.createDataFrame([(1, 0.2, 0), (1, 0.5, 0), (0, 0.1, 1), (1, 0.3, 1)], "y int, s double, g int")
    out = {r["g"]: r["auc"] for r in metrics.roc_auc(df, "s", "y", by=["g"]).collect()}
    assert out[0] is None and out[1] == 1.0
