"""Trees as data, leaf-wise and symmetric growth, subtraction, the inner hold-out."""

import numpy as np
import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

from foldframe.operators import boost, folds
from foldframe.operators.forest import Binning, Codes, Forest, Nodes, Split, Tree
from foldframe.plans import registry


def _rows(spark, n=700, seed=3):
    rng = np.random.RandomState(seed)
    x, c = rng.rand(n), rng.randint(0, 30, n)
    s = 3 * (x > 0.5) * (x < 0.8) + (c % 3 == 2) + 0.3 * rng.randn(n)
    rows = [(i, None if i % 11 == 0 else float(a), int(b), float(t)) for i, (a, b, t) in enumerate(zip(x, c, s))]
    return folds.assign_kfold(spark.createDataFrame(rows, "id long, x double, c int, s double"), k=3)


def _fit(spark, **kw):
    base = dict(n_trees=4, learning_rate=0.5, max_depth=3, max_bins=16)
    base.update(kw)
    return boost.fit_boosted(_rows(spark), ["x", "c"], "s", boost.cv_specs(3, refit=True), boost.BoostParams(**base),
                             categorical=["c"], keep_cols=["fold"])


def _walk(tree, bins, binning):
    n = 1
    while n in tree.splits:
        s = tree.splits[n]
        b = bins[s.feature]
        left = b in s.left if s.categorical else b <= s.threshold or (s.missing_left and b == binning.missing_bin(s.feature))
        n = 2 * n + (0 if left else 1)
    return tree.leaves[n]


def test_nodes_walk_like_the_tree():
    rng = np.random.RandomState(0)
    binning = Binning(["a", "b"], [False, True], [[1.0, 2.0, 3.0], []], [5, 6])
    trees = []
    for _ in range(40):
        t, todo = Tree(), [1]
        while todo:
            n = todo.pop()
            if n < 64 and rng.rand() < 0.7:
                cat = bool(rng.rand() < 0.5)
                t.splits[n] = Split(int(cat), cat, int(rng.randint(0, 4)), tuple(np.flatnonzero(rng.rand(6) < 0.5).tolist()), 0.0, bool(rng.rand() < 0.5))
                todo += [2 * n, 2 * n + 1]
            else:
                t.leaves[n] = float(rng.randn())
        trees.append(t)
    bins = np.array([(a, b) for a in range(5) for b in range(6)])
    want = [sum(_walk(t, row, binning) for t in trees) for row in bins.tolist()]
    assert np.allclose(Nodes(trees, binning).score(bins, cells=64), want, atol=1e-12)
    assert Nodes([], binning).score(bins).tolist() == [0.0] * 30


@pytest.mark.parametrize("kw", [{}, {"max_leaves": 5, "max_depth": 4}, {"symmetric": True}, {"objective": "squared", "subsample": 0.7}])
def test_saved_forest_scores_as_training_kept(spark, tmp_path, kw):
    res = _fit(spark, **kw)
    res.forest().save(spark, str(tmp_path / "model"))
    f = Forest.load(spark, str(tmp_path / "model"))
    got = f.score(_rows(spark), 3, "p").select("id", "p").toPandas().sort_values("id")
    want = res.state.select("id", F.col("__B3").alias("b")).toPandas().sort_values("id")
    assert np.allclose(got["p"].to_numpy(), want["b"].to_numpy(), atol=1e-9)
    nodes = res.forest().nodes(spark)
    assert nodes.where("feature is null").count() == sum(len(t.leaves) for ts in res.forest().trees for t in ts)
    res.close()


def test_forest_of_a_thousand_trees_equals_training_margins(spark):
    """84 bagged fold models of 12 trees each, together 1008, as one ensemble."""
    d = _rows(spark, n=300)
    k = 84
    d = d.withColumn("fold", (F.col("id") % k).cast("int"))
    p = boost.BoostParams(n_trees=12, learning_rate=0.3, max_depth=3, max_bins=16)
    res = boost.fit_boosted(d, ["x"], "s", [boost.ModelSpec(str(o), F.col("fold") != o) for o in range(k)], p, keep_cols=["fold"])
    one = Forest(res.binning, "squared", [sum(res.base)], [[t for ts in res.trees for t in ts]])
    assert len(one.trees[0]) == 1008
    got = one.score(d, 0, "p").select("id", "p").toPandas().sort_values("id")
    want = res.state.select("id", sum(F.col(f"__B{m}") for m in range(k)).alias("b")).toPandas().sort_values("id")
    assert np.allclose(got["p"].to_numpy(), want["b"].to_numpy(), atol=1e-8)


def _plain_best_first(rows, limit, depth):
    """Reference growth on (x, g) rows: split the leaf of greatest gain until the limit."""
    def best(part):
        xs = sorted(set(part[:, 0]))[:-1]
        tot = part[:, 1].sum()
        out = []
        for v in xs:
            left = part[part[:, 0] <= v, 1]
            gain = 0.5 * (left.sum() ** 2 / (len(left) + 1) + (tot - left.sum()) ** 2 / (len(part) - len(left) + 1) - tot ** 2 / (len(part) + 1))
            out.append((-round(gain, 8), v))
        return min(out) if out else (0, None)
    leaves, splits = {1: rows}, []
    while len(leaves) < limit:
        cand = sorted((best(part)[0], n, best(part)[1]) for n, part in leaves.items() if n.bit_length() <= depth)
        if not cand or cand[0][0] >= 0:
            break
        _, n, v = cand[0]
        part = leaves.pop(n)
        leaves[2 * n], leaves[2 * n + 1] = part[part[:, 0] <= v], part[part[:, 0] > v]
        splits.append((n, v))
    return splits


def test_leafwise_growth_is_best_first(spark):
    rng = np.random.RandomState(5)
    x = rng.randint(0, 40, 500)
    s = np.sin(x / 3.0) * 3 + (x > 30) * 4 + 0.2 * rng.randn(500)
    df = spark.createDataFrame([(i, int(a), float(b)) for i, (a, b) in enumerate(zip(x, s))], "id long, x int, s double")
    for limit, depth in ((7, 0), (6, 3), (100, 5)):
        p = boost.BoostParams(n_trees=1, learning_rate=1.0, max_depth=depth, max_leaves=limit, max_bins=64, min_child_weight=0.0)
        res = boost.fit_boosted(df, ["x"], "s", [boost.ModelSpec("all", F.lit(True))], p)
        want = _plain_best_first(np.c_[x, s.mean() - s], limit, depth or 60)
        tree = res.trees[0][0]
        cuts = res.binning.cuts[0]
        vals = sorted(set(x.tolist()))
        got = sorted((n, max(v for v in vals if v < cuts[sp.threshold])) for n, sp in tree.splits.items())
        assert got == sorted(want) and len(tree.leaves) == len(want) + 1


def test_symmetric_levels_share_one_split(spark):
    res = _fit(spark, symmetric=True)
    for tree in res.trees[3]:
        for level in range(4):
            own = {(s.feature, s.threshold, s.left) for n, s in tree.splits.items() if n.bit_length() == level + 1}
            assert len(own) <= 1
        assert len(tree.leaves) == 1 << max((n.bit_length() for n in tree.splits), default=0)


@pytest.mark.parametrize("kw", [{}, {"max_leaves": 6, "max_depth": 5}, {"symmetric": True}])
def test_subtraction_gives_the_same_trees(spark, kw):
    a, b = _fit(spark, subtract_from=0, **kw), _fit(spark, subtract_from=1 << 60, **kw)
    for x, y in zip(a.trees, b.trees):
        assert [[(n, s.feature, s.threshold, s.left, s.missing_left) for n, s in sorted(t.splits.items())] for t in x] == \
               [[(n, s.feature, s.threshold, s.left, s.missing_left) for n, s in sorted(t.splits.items())] for t in y]
        assert all(np.isclose(t.leaves[n], u.leaves[n], atol=1e-9) for t, u in zip(x, y) for n in t.leaves)


def test_inner_hold_out(spark):
    res = _fit(spark, n_trees=30, learning_rate=1.0, early_stopping=2, validation_fraction=0.2)
    st = res.state.toPandas()
    for m in range(4):
        train = st["fold"] != m if m < 3 else st["fold"] >= 0
        assert not (st[f"__T{m}"] & st[f"__S{m}"]).any() and ((st[f"__T{m}"] | st[f"__S{m}"]) == train).all()
        assert 0.1 < st[f"__S{m}"].sum() / train.sum() < 0.3
        assert res.best_iter[m] == int(np.argmin(res.valid_loss[m])) and len(res.trees[m]) - res.best_iter[m] <= 2


def test_registry_keeps_leaf_limits_and_levels():
    p, enc = registry.model_spec("bin_leafwise_5")
    assert (p.max_leaves, p.max_depth, p.n_trees) == (25, 4, 1000) and set(enc) == {"smoothing", "noise_level"}
    assert registry.model_spec("bin_hist_1")[0].max_leaves == 19 and registry.model_spec("bin_hist_1")[0].validation_fraction == 0.1
    assert registry.model_spec("cls_symmetric_a")[0].symmetric
    with pytest.raises(ValueError):
        registry.model_spec({"unknown": 1})


def test_a_registry_spec_runs_unchanged(spark):
    """A symmetric set of the registry at its own depth and regularisation, all rows of the small tables."""
    from foldframe.sources import fixtures as fx
    p, _ = registry.model_spec("reg_leafwise_1", n_trees=3)
    d = fx.fsig(spark, SF_SMALL).filter(F.col("part") == "train")
    res = boost.fit_boosted(d, ["o_totalprice", "c_acctbal"], "s", [boost.ModelSpec("all", F.lit(True))], p)
    assert all(len(t.leaves) <= 15 for t in res.trees[0]) and max(len(t.leaves) for t in res.trees[0]) > 8


@pytest.mark.parametrize("kw", [{}, {"objective": "logistic"}, {"subsample": 0.6}, {"validation_fraction": 0.2}])
def test_passes_read_cells_of_equal_rows(spark, monkeypatch, kw):
    """Passes read a row per bin and fold, however many rows; the trees are those of rows that can't be added up."""
    rng = np.random.RandomState(9)
    x = rng.randint(0, 4, 900)
    s = (x > 1) + 0.5 * rng.randn(900)
    y = (s > 0.5).astype(float) if kw.get("objective") else s
    df = spark.createDataFrame([(i, int(a), float(i), float(b), i % 3) for i, (a, b) in enumerate(zip(x, y))], "id long, x int, z double, s double, fold int")
    p = boost.BoostParams(n_trees=3, learning_rate=0.5, max_depth=2, max_bins=1024, early_stopping=3, **kw)
    sizes, plain = [], boost._pass
    monkeypatch.setattr(boost, "_pass", lambda view, *a, **k: (sizes.append(view.count()), plain(view, *a, **k))[1])
    few = boost.fit_boosted(df, ["x"], "s", boost.cv_specs(3), p, keep_cols=["fold"])
    assert max(sizes) <= 4 * 3 * 8
    # a second feature of as many bins as rows, which no split can use, keeps the rows apart
    sizes.clear()
    own = boost.fit_bins(df, ["x", "z"], (), 1024)
    monkeypatch.setattr(boost, "tree_features", lambda p, n, tree, model: [0])
    many = boost.fit_boosted(df, ["x", "z"], "s", boost.cv_specs(3), p, binning=own, keep_cols=["fold"])
    assert max(sizes) == 900
    for a, b in zip(few.trees, many.trees):
        assert [[(n, t.threshold) for n, t in sorted(u.splits.items())] for u in a] == [[(n, t.threshold) for n, t in sorted(u.splits.items())] for u in b]
        assert all(np.isclose(u.leaves[n], v.leaves[n], atol=1e-9) for u, v in zip(a, b) for n in u.leaves)
    assert np.allclose(few.valid_loss, many.valid_loss, atol=1e-9) and few.best_iter == many.best_iter
    for res in (few, many):
        res.pred = boost.oof_predictions(res, 3).toPandas().sort_values("id")
    assert len(few.pred) == 900 and np.allclose(few.pred["pred"], many.pred["pred"], atol=1e-9) and np.allclose(few.pred["y"], y)


@pytest.mark.parametrize("kw", [{}, {"subsample": 0.6}])
def test_folds_share_cells(spark, monkeypatch, kw):
    """A cell serves all fold models: as many of them as bins, not as bins and folds."""
    df = spark.createDataFrame([(i, i % 4, float(i % 7), i % 11 % 5) for i in range(600)], "id long, x int, s double, fold int")
    p = boost.BoostParams(n_trees=2, max_depth=2, max_bins=16, early_stopping=2, **kw)
    sizes, plain = [], boost._pass
    monkeypatch.setattr(boost, "_pass", lambda view, *a, **k: (sizes.append(view.count()), plain(view, *a, **k))[1])
    res = boost.fit_boosted(df, ["x"], "s", boost.cv_specs(5), p, keep_cols=["fold"])
    assert set(sizes) == {4}
    pred = boost.oof_predictions(res, 5).toPandas()
    for o in range(5):       # losses of the best iteration are those of the rows
        own = pred[pred["fold"] == o]
        assert np.isclose(((own["pred"] - own["y"]) ** 2).mean(), res.valid_loss[o][res.best_iter[o]], atol=1e-9)


@pytest.mark.parametrize("share", [0.0, 0.3, 0.7, 1.0 - 2.0 ** -34])
def test_bags_are_those_of_the_number(spark, share):
    """Comparing the digits gives the rows whose number is below the share; the plan converts none."""
    df = spark.createDataFrame([(i,) for i in range(300)] + [(None,)], "id long")
    text = boost.bag_sql(42, 3, 1, "id", share)
    number = "CAST(conv(substr(md5(concat_ws('|', 'bag', '42', '3', '1', CAST(id AS STRING))), 1, 8), 16, 10) AS DOUBLE) / 4294967296.0D"
    assert "conv(" not in text and df.where(f"({text}) <> ({number} < {share!r}D) OR ({text}) IS NULL").count() == 0


def test_sides_of_many_categories_are_bits(spark):
    """A side of 100,000 categories reaches the driver as a bit for each, and holds the codes of the best cut by ratio."""
    n = 100_000
    hist = spark.range(n).selectExpr("0 AS model", "1L AS node", "0 AS feat", "CAST(id AS INT) AS bin",
                                     "CAST((id * 7919 % 100003) - 50000 AS DOUBLE) AS G", "1.0D AS H", "1L AS C")
    row = boost.best_splits(hist, Binning(["c"], [True], [[]], [n + 1]), boost.BoostParams()).first()
    assert sum(len(x["bits"]) for x in row["left"]) <= n / 8 + 1
    g = np.arange(n, dtype=np.int64) * 7919 % 100003 - 50000.0
    order = np.argsort(g, kind="stable")
    left, k = np.cumsum(g[order])[:-1], np.arange(1, n)
    gain = 0.5 * (left ** 2 / (k + 1) + (g.sum() - left) ** 2 / (n - k + 1) - g.sum() ** 2 / (n + 1))
    best = int(np.argmax(gain))
    codes = Codes.of_parts(row["left"])
    assert row["feat"] == 0 and np.isclose(row["gain"], gain[best]) and list(codes) == sorted(order[:best + 1].tolist())
    assert len(codes) == best + 1 == row["CL"] and codes == Codes.of(order[:best + 1].tolist()) and int(order[best + 1]) not in codes


@pytest.mark.parametrize("kw", [{}, {"symmetric": True}, {"subsample": 0.7}, {"objective": "logistic"}])
def test_wide_columns_send_a_row_per_value(spark, monkeypatch, kw):
    """Where a task can't keep the sums of a column of many values, their rows lie together: what a pass sends follows the values, not the
    tasks or rows, also of a value that most rows have; the trees are the same."""
    rng = np.random.RandomState(4)
    n, k = 2400, 60
    c, x = np.where(rng.rand(n) < 0.4, 7, rng.randint(0, k, n)), rng.rand(n)
    s = (c % 3 == 1) + x + 0.1 * rng.randn(n)
    s = (s > 1).astype(float) if kw.get("objective") else s
    df = spark.createDataFrame([(i, float(a), None if b == 9 else int(b), float(t), i % 3) for i, (a, b, t) in enumerate(zip(x, c, s))],
                               "id long, x double, c int, s double, fold int").repartition(6).cache()
    p = boost.BoostParams(n_trees=2, learning_rate=0.5, max_depth=2, max_bins=40, early_stopping=2, **kw)

    def fit():
        return boost.fit_boosted(df, ["x", "c"], "s", boost.cv_specs(3), p, categorical=["c"], keep_cols=["fold"])
    kept = fit()
    monkeypatch.setattr(boost, "TASK_CELLS", 1 << 8)
    monkeypatch.setattr(boost, "HELD_CELLS", 150)
    sent, plain = [], boost._pass

    def counted(view, asks, kept, binning, p, persist):
        task = boost._histogram_task(asks, binning.bin_cols, binning.n_bins, p.objective, False, boost.HELD_CELLS)
        sent.append((view.mapInArrow(task, boost.HIST).where("feat = 1 AND C > 0").count(), max((len(a.nodes) for a in asks), default=0)))
        return plain(view, asks, kept, binning, p, persist)
    monkeypatch.setattr(boost, "_pass", counted)
    wide = fit()
    assert all(rows <= 3 * (k + 15) * nodes for rows, nodes in sent) and max(sent)[0] > 0
    for a, b in zip(kept.trees, wide.trees):
        assert [[(n, s.feature, s.threshold, s.left) for n, s in sorted(t.splits.items())] for t in a] == \
               [[(n, s.feature, s.threshold, s.left) for n, s in sorted(t.splits.items())] for t in b]
        assert all(np.isclose(t.leaves[n], u.leaves[n], atol=1e-9) for t, u in zip(a, b) for n in t.leaves)
    got = [boost.oof_predictions(r, 3).toPandas().sort_values("id") for r in (kept, wide)]
    assert len(got[1]) == n and np.allclose(got[0]["pred"], got[1]["pred"], atol=1e-9)
