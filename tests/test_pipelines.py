"""Pipelines on the planted-signal fixture (F-SIG) and layout independence of encodings."""

import numpy as np
from conftest import SF_SMALL
from pyspark.sql import functions as F

from foldframe.operators import encode, folds, metrics
from foldframe.plans import pipelines, registry
from foldframe.sources import fixtures as fx


def test_target_encoding_layout_independent(spark):
    tr = folds.assign_stratified_kfold(fx.fcls(spark, SF_SMALL).filter(F.col("part") == "train"), "y")
    kw = dict(k=5, smoothing=2.0, noise_level=0.01, seed=3)
    a = encode.target_encode_oof(tr.repartition(1), ["c_mktsegment"], "y", **kw).toPandas()
    b = encode.target_encode_oof(tr.repartition(13), ["c_mktsegment"], "y", **kw).toPandas()
    key = ["outer", "id"]
    m = a.merge(b, on=key)
    assert len(m) == len(a) == len(b)
    assert np.allclose(m["c_mktsegment_encoded_x"], m["c_mktsegment_encoded_y"], atol=0)


def test_cv_pipeline_learns_planted_signal(spark):
    d = fx.fsig(spark, SF_SMALL)
    cols = ["o_totalprice", "c_acctbal", "c_mktsegment"]
    train = d.filter(F.col("part") == "train").select("id", "y_sig", *cols)
    test = d.filter(F.col("part") == "test").select("id", *cols)
    p, enc = registry.model_spec("bin_leafwise_7", n_trees=8, early_stopping=3, learning_rate=0.3, max_bins=32)
    r = pipelines.cv_pipeline(train, test, "y_sig", cols, p, k=5, target_encode_cols=["c_mktsegment"], **enc)
    auc = metrics.roc_auc(r.oof, "pred", "y").first()["auc"]
    assert auc > 0.75
    sub = r.submission.toPandas()
    assert len(sub) == test.count() and sub["pred"].notna().all()
    assert r.scores.count() == 5


def test_stacking_evaluator_fit_report_predict(spark):
    d = fx.fsig(spark, SF_SMALL)
    cols = ["o_totalprice", "c_acctbal"]
    train = d.filter(F.col("part") == "train").select("id", "y_sig", *cols)
    test = d.filter(F.col("part") == "test").select("id", *cols)
    pa, _ = registry.model_spec("cls_depthwise_a", n_trees=5, learning_rate=0.3, max_bins=16)
    pb, _ = registry.model_spec("cls_symmetric_b", n_trees=5, learning_rate=0.3, max_bins=16)
    ev = pipelines.StackingEvaluator([pipelines.BaseModel("a", pa, cols), pipelines.BaseModel("b", pb, cols[:1])],
                                     train, "y_sig", k=3).fit()
    rep = {r["model"]: r["value"] for r in ev.report().collect()}
    assert set(rep) == {"a", "b", "stacker_in_sample", "stacker_cv"}
    assert all(0.5 < v <= 1.0 for v in rep.values())
    pred = ev.predict(test).toPandas()
    assert len(pred) == test.count() and pred["pred"].between(0, 1).all()
