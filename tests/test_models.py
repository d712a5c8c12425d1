"""Linear fits against numpy, booster sanity, pipelines, streaming scoring."""

import numpy as np
from pyspark.sql import functions as F

from foldframe.operators import boost, folds, linear


def _data(spark, n=600, seed=0):
    rng = np.random.RandomState(seed)
    x1, x2 = rng.rand(n), rng.rand(n)
    y = (rng.rand(n) < 1 / (1 + np.exp(-(3 * x1 - 2 * x2)))).astype(int)
    rows = [(i, float(a), float(b), int(c)) for i, (a, b, c) in enumerate(zip(x1, x2, y))]
    df = folds.assign_stratified_kfold(spark.createDataFrame(rows, "id long, x1 double, x2 double, y int"), "y")
    return df, x1, x2, y


def test_ridge_matches_numpy(spark):
    df, x1, x2, y = _data(spark)
    m = linear.fit_ridge_cv(df, ["x1", "x2"], "y", None, alpha=1.0)
    X = np.c_[x1, x2]
    Xc, yc = X - X.mean(0), y - y.mean()
    w = np.linalg.solve(Xc.T @ Xc + np.eye(2), Xc.T @ yc)
    b = y.mean() - X.mean(0) @ w
    assert np.allclose(m.coefs[linear.ALL][1], w, atol=1e-12) and abs(m.coefs[linear.ALL][0] - b) < 1e-12


def test_ridge_cv_equals_per_fold_fit(spark):
    df, *_ = _data(spark)
    m = linear.fit_ridge_cv(df, ["x1", "x2"], "y", "fold")
    pdf = df.toPandas()
    for o in range(5):
        sub = spark.createDataFrame(pdf[pdf.fold != o])
        one = linear.fit_ridge_cv(sub, ["x1", "x2"], "y", None)
        assert np.allclose(m.coefs[o][1], one.coefs[linear.ALL][1], atol=1e-12)


def test_lda_matches_formula(spark):
    df, x1, x2, y = _data(spark)
    m = linear.fit_lda_cv(df, ["x1", "x2"], "y", None)
    X = np.c_[x1, x2]
    mu0, mu1 = X[y == 0].mean(0), X[y == 1].mean(0)
    W = (X[y == 0] - mu0).T @ (X[y == 0] - mu0) + (X[y == 1] - mu1).T @ (X[y == 1] - mu1)
    beta = np.linalg.solve(W / (len(y) - 2), mu1 - mu0)
    assert np.allclose(m.coefs[linear.ALL][1], beta, atol=1e-10)


def _newton(X, y, pen_b=True):
    Xa = np.c_[np.ones(len(y)), X]
    w = np.zeros(Xa.shape[1])
    R = np.eye(len(w))
    if not pen_b:
        R[0, 0] = 0
    for _ in range(100):
        p = 1 / (1 + np.exp(-Xa @ w))
        g = Xa.T @ (p - y) + R @ w
        H = (Xa * (p * (1 - p))[:, None]).T @ Xa + R
        w = w - np.linalg.solve(H, g)
    return w


def test_logistic_matches_newton(spark):
    df, x1, x2, y = _data(spark)
    for pen in (True, False):
        m = linear.fit_logistic_cv(df, ["x1", "x2"], "y", "fold", penalize_intercept=pen)
        w = _newton(np.c_[x1, x2], y, pen)
        b, ww = m.coefs[linear.ALL]
        assert abs(b - w[0]) < 1e-9 and np.allclose(ww, w[1:], atol=1e-9)
        pdf = df.toPandas()
        sub = pdf[pdf.fold != 2]
        w2 = _newton(sub[["x1", "x2"]].to_numpy(), sub["y"].to_numpy(), pen)
        assert np.allclose(np.r_[m.coefs[2][0], m.coefs[2][1]], w2, atol=1e-9)


def test_vote_identity(spark):
    """mean(LR, LDA, vote) with vote = (LR+LDA)/2 equals the vote."""
    from foldframe.plans import pipelines
    df, *_ = _data(spark)
    oof = df.select("id", "x1", "x2", "y")
    test = df.select("id", "x1", "x2").withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(4))))
    a = pipelines.vote_pipeline([oof], [test], ["x1", "x2"], final="mean").submission.toPandas()
    b = pipelines.vote_pipeline([oof], [test], ["x1", "x2"], final="vote").submission.toPandas()
    m = a.merge(b, on="id")
    assert np.allclose(m["pred_x"], m["pred_y"], atol=1e-15)


def test_booster_beats_constant_and_is_repeatable(spark):
    rng = np.random.RandomState(1)
    n = 800
    x = rng.rand(n)
    c = rng.randint(0, 4, n)
    s = 3 * (x > 0.5) + (c == 2) + 0.3 * rng.randn(n)
    rows = [(i, float(a), int(b), float(t)) for i, (a, b, t) in enumerate(zip(x, c, s))]
    df = folds.assign_kfold(spark.createDataFrame(rows, "id long, x double, c int, s double"), k=3)
    p = boost.BoostParams(n_trees=8, learning_rate=0.5, max_depth=2, early_stopping=3, max_bins=16)
    r1 = boost.fit_boosted(df, ["x", "c"], "s", boost.cv_specs(3), p, categorical=["c"], keep_cols=["fold"])
    o1 = boost.oof_predictions(r1, 3).toPandas().sort_values("id")
    rmse = np.sqrt(((o1["y"] - o1["pred"]) ** 2).mean())
    assert rmse < 0.6 * np.std(s)
    r2 = boost.fit_boosted(df.repartition(5), ["x", "c"], "s", boost.cv_specs(3), p, categorical=["c"],
                           keep_cols=["fold"])
    o2 = boost.oof_predictions(r2, 3).toPandas().sort_values("id")
    assert np.allclose(o1["pred"].to_numpy(), o2["pred"].to_numpy(), atol=1e-9)
    # in-state scores equal those of the ensemble as data
    sc = r1.forest().score(df, 0, "p0").select("id", "fold", "p0").toPandas()
    st = r1.state.select("id", F.col("__B0").alias("b0")).toPandas()
    mm = sc.merge(st, on="id")
    assert np.allclose(mm["p0"], mm["b0"], atol=1e-9)


def test_booster_logistic_regularised(spark):
    rng = np.random.RandomState(2)
    n = 600
    x = rng.rand(n)
    y = (rng.rand(n) < np.where(x > 0.6, 0.85, 0.15)).astype(int)
    df = folds.assign_stratified_kfold(
        spark.createDataFrame([(i, float(a), int(b)) for i, (a, b) in enumerate(zip(x, y))],
                              "id long, x double, y int"), "y", k=3)
    p = boost.BoostParams(objective="logistic", n_trees=6, learning_rate=0.5, max_depth=2, reg_alpha=1.0,
                          reg_lambda=2.0, gamma=0.1, min_child_weight=5, subsample=0.8, max_bins=16)
    r = boost.fit_boosted(df, ["x"], "y", boost.cv_specs(3), p, keep_cols=["fold"])
    oof = boost.oof_predictions(r, 3)
    from foldframe.operators.metrics import roc_auc
    assert roc_auc(oof, "pred", "y").first()["auc"] > 0.75
    pr = oof.toPandas()["pred"]
    assert ((pr > 0) & (pr < 1)).all()


def test_streaming_scoring(spark, tmp_path):
    """Linear scoring expressions run unchanged on a streaming DataFrame."""
    df, *_ = _data(spark, n=200)
    m = linear.fit_ridge_cv(df, ["x1", "x2"], "y", None)
    src = str(tmp_path / "in")
    df.select("id", "x1", "x2").write.parquet(src)
    stream = spark.readStream.schema("id long, x1 double, x2 double").parquet(src)
    from foldframe.streaming import score_stream
    q = score_stream(stream, m, "scored_ridge", str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    out = spark.sql("SELECT * FROM scored_ridge").toPandas()
    assert len(out) == 200


def test_streaming_boosted_scoring(spark, tmp_path):
    rng = np.random.RandomState(5)
    rows = [(i, float(x), float(3 * (x > 0.5) + 0.1 * rng.randn())) for i, x in enumerate(rng.rand(300))]
    df = folds.assign_kfold(spark.createDataFrame(rows, "id long, x double, s double"), k=3)
    p = boost.BoostParams(n_trees=4, learning_rate=0.5, max_depth=2, max_bins=16)
    res = boost.fit_boosted(df, ["x"], "s", boost.cv_specs(3, refit=True), p, keep_cols=["fold"])
    src = str(tmp_path / "in")
    df.select("id", "x").write.parquet(src)
    stream = spark.readStream.schema("id long, x double").parquet(src)
    from foldframe.streaming import score_stream
    q = score_stream(stream, res, "scored_boost", str(tmp_path / "ck"), model_index=3)
    q.processAllAvailable()
    q.stop()
    out = spark.sql("SELECT * FROM scored_boost").toPandas().merge(
        res.state.select("id", F.col("__B3").alias("b")).toPandas(), on="id")
    assert len(out) == 300 and np.allclose(out["pred"], out["b"], atol=1e-9)


def test_wide_features_equal_the_dense_solution(spark, monkeypatch):
    """200 features for ridge and discriminant, 40 for the logistic regression; and the same as the expression path."""
    rng = np.random.RandomState(9)
    n, p = 900, 200
    X = rng.randn(n, p)
    y = (rng.rand(n) < 1 / (1 + np.exp(-(X[:, 0] - X[:, 1])))).astype(int)
    cols = [f"x{j}" for j in range(p)]
    df = spark.createDataFrame([(i, int(i % 3), int(y[i]), *map(float, X[i])) for i in range(n)],
                               "id long, fold int, y int, " + ", ".join(f"{c} double" for c in cols))
    m = linear.fit_ridge_cv(df, cols, "y", "fold")
    for key, rows in ((linear.ALL, slice(None)), (1, np.arange(n) % 3 != 1)):
        A, t = X[rows], y[rows]
        Ac, tc = A - A.mean(0), t - t.mean()
        w = np.linalg.solve(Ac.T @ Ac + np.eye(p), Ac.T @ tc)
        assert np.allclose(m.coefs[key][1], w, atol=1e-9) and abs(m.coefs[key][0] - (t.mean() - A.mean(0) @ w)) < 1e-9
    few = cols[:40]
    lr, lda = linear.fit_logistic_cv(df, few, "y", "fold", k=3), linear.fit_lda_cv(df, few, "y", "fold")
    w = _newton(X[:, :40], y)
    assert abs(lr.coefs[linear.ALL][0] - w[0]) < 1e-8 and np.allclose(lr.coefs[linear.ALL][1], w[1:], atol=1e-8)
    monkeypatch.setattr(linear, "WIDE", 1000)
    plain = linear.fit_lda_cv(df, few[:10], "y", "fold")
    monkeypatch.setattr(linear, "WIDE", 2)
    block, logit = linear.fit_lda_cv(df, few[:10], "y", "fold"), linear.fit_logistic_cv(df, few[:3], "y", "fold", k=3)
    for key in plain.coefs:
        assert np.allclose(plain.coefs[key][1], block.coefs[key][1], atol=1e-9)
    rows = np.arange(n) % 3 != 2
    w = _newton(X[rows][:, :3], y[rows])
    assert np.allclose(logit.coefs[2][1], w[1:], atol=1e-8) and set(lda.coefs) == {-1, 0, 1, 2}
