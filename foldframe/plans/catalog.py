"""Registered queries: ``name -> (spark, sf_dir) -> DataFrame``.

Each query runs one operator (or pipeline) of the library over a fixture
derived from the full test tables.  Float outputs are rounded to
``DIGITS`` decimals so the DuckDB oracle (``oracle.py``) compares equal
despite different summation orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..operators import folds, metrics
from ..sources import fixtures as fx

DIGITS = 9
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    return df.select(*[
        F.round(F.col(f.name), digits).alias(f.name) if isinstance(f.dataType, DoubleType)
        else F.col(f.name) for f in df.schema.fields])


def _train(spark, sf):
    return fx.fcls(spark, sf).filter(F.col("part") == "train")


# --------------------------------------------------------------- folds (K1-K3)
@query("kfold_assign")
def q_kfold(spark, sf):
    return folds.assign_kfold(fx.freg(spark, sf).select("id"), k=5, seed=42)


@query("stratified_kfold_assign")
def q_skfold(spark, sf):
    return folds.assign_stratified_kfold(_train(spark, sf).select("id", "y"), "y", k=5, seed=42)


@query("inner_fold_assign")
def q_inner(spark, sf):
    base = folds.assign_stratified_kfold(_train(spark, sf).select("id", "y"), "y", k=5, seed=42)
    return folds.assign_inner_folds(base, "y", k_outer=5, k_inner=5, seed=1).select(
        "outer", "id", "fold", "inner")


# --------------------------------------------------------------- metrics
def _pred_long(spark, sf):
    oof = fx.fpred_oof(spark, sf)
    parts = [oof.select("id", "fold", "y", F.lit(c).alias("model"), F.col(c).alias("score"))
             for c in ("p1", "p2", "p3")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("roc_auc_pooled")
def q_auc_pooled(spark, sf):
    return rounded(metrics.roc_auc(_pred_long(spark, sf), "score", "y", by=["model"], out_col="value"))


@query("roc_auc_by_fold")
def q_auc_fold(spark, sf):
    return rounded(metrics.roc_auc(_pred_long(spark, sf), "score", "y", by=["model", "fold"],
                                   out_col="value"))


@query("rmse_by_fold")
def q_rmse_fold(spark, sf):
    return rounded(metrics.rmse(_pred_long(spark, sf), "score", "y", by=["model", "fold"],
                                out_col="value"))


@query("mean_fold_score")
def q_mean_fold(spark, sf):
    s = metrics.roc_auc(_pred_long(spark, sf), "score", "y", by=["model", "fold"], out_col="value")
    return rounded(metrics.mean_fold_score(s, by=["model"]))


# --------------------------------------------------------------- encoders
from ..operators import encode, stats  # noqa: E402

CATS = ["o_orderpriority", "c_mktsegment"]
TE = dict(smoothing=2.0, noise_level=0.01, seed=0)


def _fcls_folds(spark, sf):
    return folds.assign_stratified_kfold(_train(spark, sf), "y", k=5, seed=42)


@query("ordinal_encode")
def q_ordinal(spark, sf):
    d = fx.fcls(spark, sf)
    fit = d.filter(F.col("part") == "train")
    tgt = d.filter(F.col("part").isin("train", "test")).select("id", "part", *CATS)
    return encode.ordinal_encode(fit, [tgt], CATS)[0]


@query("ordinal_encode_unknown")
def q_ordinal_unknown(spark, sf):
    d = fx.fcls(spark, sf)
    fit = d.filter((F.col("part") == "train") & (F.col("o_orderpriority") != "5-LOW"))
    return encode.ordinal_encode(fit, [d.select("id", "part", *CATS)], CATS)[0]


@query("ordinal_encode_strict")
def q_ordinal_strict(spark, sf):
    d = fx.fcls(spark, sf)
    return encode.ordinal_encode(d, [d.filter(F.col("part") == "test").select("id", *CATS)],
                                 CATS, unknown="error")[0]


@query("category_encode")
def q_category(spark, sf):
    d = fx.fcls(spark, sf)
    fit = d.filter((F.col("part") == "train") & (F.col("o_orderpriority") != "5-LOW"))
    cols = [*CATS, "c_nationkey"]
    return encode.category_encode(fit, [d.select("id", "part", *cols)], cols)[0]


@query("global_mean")
def q_global_mean(spark, sf):
    ex = folds.explode_outer_train(_fcls_folds(spark, sf), 5)
    return rounded(stats.global_mean(ex, "y", ["outer"]))


@query("target_encode")
def q_te(spark, sf):
    tr = _fcls_folds(spark, sf)
    rows = folds.explode_outer_train(tr, 5)
    fit = rows.filter(F.col("o_orderpriority") != "5-LOW")      # so that every table has an unseen category
    valid = tr.withColumn("outer", F.col("fold"))
    test = (fx.fcls(spark, sf).filter(F.col("part") == "test")
            .withColumn("outer", F.explode(F.sequence(F.lit(0), F.lit(4)))))
    keep = ["outer", "id", *[c + "_encoded" for c in CATS]]
    a, b, c = encode.target_encode(fit, [rows, valid, test], CATS, "y", by=["outer"], **TE)
    out = (a.select(*keep, F.lit("train").alias("role"))
           .unionByName(b.select(*keep, F.lit("valid").alias("role")))
           .unionByName(c.select(*keep, F.lit("test").alias("role"))))
    return rounded(out)


@query("target_encode_oof")
def q_te_oof(spark, sf):
    tr = _fcls_folds(spark, sf)
    enc = encode.target_encode_oof(tr, CATS, "y", k=5, **TE)
    return rounded(enc.select("outer", "id", *[c + "_encoded" for c in CATS]))


@query("target_encode_apply")
def q_te_apply(spark, sf):
    tr = _fcls_folds(spark, sf)
    test = fx.fcls(spark, sf).filter(F.col("part") == "test")
    valid, tst = encode.target_encode_apply(tr, test, CATS, "y", k=5, **TE)
    keep = ["outer", "id", *[c + "_encoded" for c in CATS]]
    return rounded(valid.select(*keep, F.lit("valid").alias("role"))
                   .unionByName(tst.select(*keep, F.lit("test").alias("role"))))


@query("te_oof_auc_by_fold")
def q_flagship(spark, sf):
    """Flagship slice: folds -> out-of-fold encoding of the training rows -> its AUC per outer fold."""
    tr = _fcls_folds(spark, sf)
    train = encode.target_encode_oof(tr, CATS, "y", k=5, **TE)
    scored = train.withColumn("score", F.col("o_orderpriority_encoded") + F.col("c_mktsegment_encoded"))
    return rounded(metrics.roc_auc(scored, "score", "y", by=["outer"], out_col="auc"))


# --------------------------------------------------------------- external statistics
STAT_COLS = ["o_orderpriority", "c_mktsegment", "c_nationkey", "o_totalprice", "c_acctbal"]


def _ext(spark, sf, cols, mean, count):
    d = fx.fcls(spark, sf)
    ref = d.filter(F.col("part") == "original")
    tgt = d.filter(F.col("part").isin("train", "test")).select("id", "part", *cols)
    out = stats.external_stats(ref, [tgt], cols, "y", mean=mean, count=count)[0]
    return rounded(out.drop(*cols))


@query("external_target_mean")
def q_ext_mean(spark, sf):
    return _ext(spark, sf, STAT_COLS[:4], True, False)


@query("external_count")
def q_ext_count(spark, sf):
    return _ext(spark, sf, STAT_COLS[:4], False, True)


@query("external_stats_all")
def q_ext_all(spark, sf):
    return _ext(spark, sf, STAT_COLS, True, True)


@query("category_stats")
def q_cat_stats(spark, sf):
    d = fx.fdoc(spark, sf)
    st = stats.multi_key_stats(d, ["lang", "source"], {
        "label_mean": F.avg(F.col("quality").cast("double")), "label_count": F.count("quality")})
    parts = [s.select(F.lit(c).alias("column"), F.col(c).cast("string").alias("key"),
                      "label_mean", "label_count") for c, s in st.items()]
    return rounded(parts[0].unionByName(parts[1]))


# --------------------------------------------------------------- features, labels, unions
from ..functions.hashing import gaussian_noise, std_normal  # noqa: E402
from ..operators import blend, features, linear  # noqa: E402


@query("math_features")
def q_math(spark, sf):
    d = fx.fevt(spark, sf).select("id", "value", "user_id")
    out = features.math_features(d, sin_cols=["value", "user_id"], num_cols=["value", "user_id", "absent"])
    return rounded(out.drop("value", "user_id"))


@query("hash_noise")
def q_noise(spark, sf):
    d = fx.fevt(spark, sf)
    return rounded(d.select("id", std_normal(F.lit("evt"), F.col("id")).alias("z"),
                            gaussian_noise(0.5, F.lit("evt2"), F.col("event_type"), F.col("id")).alias("noise")))


@query("map_label")
def q_map_label(spark, sf):
    d = fx.fcls(spark, sf).select("id", "status")
    return features.map_label(d, "status", {"F": 1, "O": 0}, out_col="label")


@query("augment_train")
def q_augment(spark, sf):
    tr = _fcls_folds(spark, sf).filter(F.col("fold") != 0).select("id", "y", "o_orderpriority", "c_acctbal")
    orig = fx.fcls(spark, sf).filter(F.col("part") == "original").select(
        "id", "y", "o_orderpriority", "c_acctbal", "status")
    return rounded(features.augment_train(tr, orig))


# --------------------------------------------------------------- blends
def _oof_tables(spark, sf):
    oof = fx.fpred_oof(spark, sf)
    return oof, [oof.select("id", c, "y") for c in ("p1", "p2", "p3")]


@query("join_oof")
def q_join_oof(spark, sf):
    _, parts = _oof_tables(spark, sf)
    return rounded(blend.join_oof(parts))


@query("align_fold_predictions")
def q_align(spark, sf):
    t = fx.fpred_test(spark, sf)
    return rounded(blend.align_fold_predictions([t.select("id", "fold", "p1"), t.select("id", "fold", "p2")]))


@query("mean_over_folds")
def q_mean_folds(spark, sf):
    return rounded(blend.mean_over_folds(fx.fpred_test(spark, sf), ["p1", "p2"]))


@query("mean_over_models")
def q_mean_models(spark, sf):
    oof = fx.fpred_oof(spark, sf)
    return rounded(blend.mean_over_models(oof, ["p1", "p2", "p3"]).select("id", "pred"))


# --------------------------------------------------------------- linear meta-models
BLEND_X = ["p1", "p2"]


@query("ridge_oof")
def q_ridge_oof(spark, sf):
    oof = fx.fpred_oof(spark, sf)
    m = linear.fit_ridge_cv(oof, BLEND_X, "y", "fold", alpha=1.0)
    return rounded(oof.select("id", "fold", m.predict_by_fold("fold").alias("pred")))


@query("lda_oof")
def q_lda_oof(spark, sf):
    oof = fx.fpred_oof(spark, sf)
    m = linear.fit_lda_cv(oof, BLEND_X, "y", "fold")
    return rounded(oof.select("id", "fold", m.predict_by_fold("fold").alias("pred")))


@query("logistic_oof")
def q_logistic_oof(spark, sf):
    oof = fx.fpred_oof(spark, sf)
    m = linear.fit_logistic_cv(oof, BLEND_X, "y", "fold", C=1.0, penalize_intercept=True)
    return rounded(oof.select("id", "fold", m.predict_by_fold("fold").alias("pred")))


@query("vote_blend")
def q_vote(spark, sf):
    oof = fx.fpred_oof(spark, sf)
    lr = linear.fit_logistic_cv(oof, BLEND_X, "y", "fold")
    lda = linear.fit_lda_cv(oof, BLEND_X, "y", "fold")
    return rounded(oof.select("id", "fold", linear.soft_vote_by_fold([lr, lda]).alias("pred")))


def _blend_submission(spark, sf, fit):
    oof = fx.fpred_oof(spark, sf)
    m = fit(oof)
    test = fx.fpred_test(spark, sf)          # one row per (id, fold)
    scored = test.select("id", "fold", m.predict().alias("pred"))
    return rounded(blend.mean_over_folds(scored, ["pred"]))


@query("ridge_blend_submission")
def q_ridge_sub(spark, sf):
    return _blend_submission(spark, sf, lambda d: linear.fit_ridge_cv(d, BLEND_X, "y", None))


@query("lda_blend_submission")
def q_lda_sub(spark, sf):
    return _blend_submission(spark, sf, lambda d: linear.fit_lda_cv(d, BLEND_X, "y", None))


# --------------------------------------------------------------- boosting (T1-T7) and pipelines
from ..operators import boost  # noqa: E402
from ..operators.forest import FEATURES as boost_features  # noqa: E402
from ..operators.forest import MODELS as boost_models  # noqa: E402
from . import pipelines, registry  # noqa: E402
from ..session import materialise  # noqa: E402

SIG_NUM = ["o_totalprice", "c_acctbal", "c_nationkey"]
SPLIT_CUTS = [50000.0, 100000.0, 150000.0, 200000.0, 250000.0, 300000.0, 350000.0, 400000.0]
SPLIT_P = boost.BoostParams(reg_lambda=1.0, reg_alpha=0.5, gamma=0.0, min_child_weight=1.0)


def _sig_rows(spark, sf, cat=True):
    # read by dictionaries, folds and fit: the joins and hashes are computed once
    d = materialise(fx.fsig(spark, sf).filter(F.col("part").isin("train", "test")), "sig-rows")
    if cat:
        d = encode.category_encode(d.filter(F.col("part") == "train"), [d], ["c_mktsegment", "o_orderpriority"])[0]
    return d


def _quick(objective, **kw):
    base = dict(objective=objective, n_trees=12, learning_rate=0.3, max_depth=3, reg_lambda=1.0,
                early_stopping=4, max_bins=32)
    base.update(kw)
    return boost.BoostParams(**base)


@query("quantile_bin")
def q_qbin(spark, sf):
    d = fx.fsig(spark, sf).filter(F.col("part") == "train").select("id", "o_totalprice", "c_acctbal")
    return boost.quantile_bin(d, ["o_totalprice", "c_acctbal"], max_bins=16).select(
        "id", "o_totalprice_bin", "c_acctbal_bin")


@query("best_split")
def q_best_split(spark, sf):
    """T6 at the root of five fold models: fixed cut points, closed form, SQL-checkable."""
    tr = folds.assign_kfold(fx.fsig(spark, sf).filter(F.col("part") == "train"), k=5, seed=42)
    ex = folds.explode_outer_train(tr, 5, outer_col="model")
    binning = boost.Binning(["o_totalprice", "c_nationkey"], [False, True], [SPLIT_CUTS, []], [len(SPLIT_CUTS) + 2, 26])
    ex = boost.apply_bins(ex, binning)
    base = ex.groupBy("model").agg(F.avg("s").alias("__b"))
    ex = ex.join(F.broadcast(base), "model")
    hist = boost.gradient_histogram(ex, "__b - CAST(s AS DOUBLE)", "1.0D", ["model"], binning).withColumn("node", F.lit(1).cast("long"))
    best = boost.best_splits(hist, binning, SPLIT_P)
    return rounded(best.select("model", "feat", "bin", "gain", "GL", "HL"), 6)


EARLY_P = _quick("squared", n_trees=30, learning_rate=0.6, early_stopping=2)
SAMPLED_P = _quick("squared", subsample=0.7, colsample_bytree=0.67, reg_alpha=1.0, gamma=0.5, min_child_weight=20.0)


@query("boost_regress_oof")
def q_boost_reg(spark, sf):
    d = _sig_rows(spark, sf, cat=False)
    tr = folds.assign_kfold(d.filter(F.col("part") == "train"), k=5, seed=42)
    rows = tr.unionByName(d.filter(F.col("part") == "test").withColumn("fold", F.lit(-1)))
    res = boost.fit_boosted(rows, SIG_NUM, "s", boost.cv_specs(5, "fold", "part"), _quick("squared"),
                            keep_cols=["fold", "part"])
    return rounded(boost.oof_predictions(res, 5), 6)


@query("boost_classify_oof")
def q_boost_cls(spark, sf):
    d = _sig_rows(spark, sf, cat=False)
    tr = folds.assign_stratified_kfold(d.filter(F.col("part") == "train"), "y_sig", k=5, seed=42)
    res = boost.fit_boosted(tr, SIG_NUM, "y_sig", boost.cv_specs(5, "fold"), _quick("logistic"),
                            keep_cols=["fold"])
    return rounded(boost.oof_predictions(res, 5), 6)


@query("boost_categorical")
def q_boost_cat(spark, sf):
    d = _sig_rows(spark, sf)
    tr = folds.assign_kfold(d.filter(F.col("part") == "train"), k=5, seed=42)
    feats = [*SIG_NUM, "c_mktsegment", "o_orderpriority"]
    res = boost.fit_boosted(tr, feats, "s", boost.cv_specs(5, "fold"), _quick("squared"),
                            categorical=["c_mktsegment", "o_orderpriority"], keep_cols=["fold"])
    return rounded(boost.oof_predictions(res, 5), 6)


@query("boost_early_stop")
def q_boost_es(spark, sf):
    d = _sig_rows(spark, sf, cat=False)
    tr = folds.assign_kfold(d.filter(F.col("part") == "train"), k=5, seed=42)
    p = EARLY_P
    res = boost.fit_boosted(tr, SIG_NUM, "s", boost.cv_specs(5, "fold"), p, keep_cols=["fold"])
    rows = [(o, res.best_iter[o], len(res.trees[o]), float(min(res.valid_loss[o]))) for o in range(5)]
    return rounded(spark.createDataFrame(rows, "fold int, best_iter int, trees_grown int, best_valid_loss double"), 6)


@query("boost_sampled")
def q_boost_sampled(spark, sf):
    d = _sig_rows(spark, sf, cat=False)
    tr = folds.assign_kfold(d.filter(F.col("part") == "train"), k=5, seed=42)
    p = SAMPLED_P
    res = boost.fit_boosted(tr, SIG_NUM, "s", boost.cv_specs(5, "fold"), p, keep_cols=["fold"])
    return rounded(boost.oof_predictions(res, 5), 6)


LEAF_P = _quick("squared", n_trees=5, max_depth=4, max_leaves=5, min_child_samples=20, early_stopping=3)
SYMMETRIC_P = _quick("logistic", n_trees=5, max_depth=3, symmetric=True, reg_lambda=3.0, early_stopping=3)
HOLD_P = _quick("squared", n_trees=12, max_leaves=6, min_child_samples=20, learning_rate=0.6, early_stopping=2, validation_fraction=0.1)
MANY_P = _quick("squared", n_trees=3, max_depth=2, early_stopping=2)


@query("boost_leafwise")
def q_boost_leafwise(spark, sf):
    """T1 leaf-wise: best split first, five leaves a tree."""
    tr = folds.assign_kfold(_sig_rows(spark, sf, cat=False).filter(F.col("part") == "train"), k=5, seed=42)
    res = boost.fit_boosted(tr, SIG_NUM, "s", boost.cv_specs(5, "fold"), LEAF_P, keep_cols=["fold"])
    return rounded(boost.oof_predictions(res, 5), 6)


@query("boost_symmetric")
def q_boost_symmetric(spark, sf):
    """T2 symmetric: one split for all nodes of a level, categories ordered over the whole level."""
    tr = folds.assign_stratified_kfold(_sig_rows(spark, sf).filter(F.col("part") == "train"), "y_sig", k=5, seed=42)
    res = boost.fit_boosted(tr, [*SIG_NUM, "c_mktsegment"], "y_sig", boost.cv_specs(5, "fold"), SYMMETRIC_P,
                            categorical=["c_mktsegment"], keep_cols=["fold"])
    return rounded(boost.oof_predictions(res, 5), 6)


@query("boost_holdout")
def q_boost_holdout(spark, sf):
    """T3 without given validation rows: rows held out of each training part, the losses on them, the best iteration."""
    tr = folds.assign_kfold(_sig_rows(spark, sf, cat=False).filter(F.col("part") == "train"), k=5, seed=42)
    res = boost.fit_boosted(tr, SIG_NUM, "s", boost.cv_specs(5, "fold"), HOLD_P, keep_cols=["fold"])
    rows = [(o, res.best_iter[o], len(res.trees[o]), float(min(res.valid_loss[o]))) for o in range(5)]
    found = spark.createDataFrame(rows, "fold int, best_iter int, trees_grown int, best_valid_loss double")
    held = res.state.agg(*[F.sum(F.col(f"__S{o}").cast("long")).alias(str(o)) for o in range(5)])
    held = held.select(F.explode(F.array(*[F.struct(F.lit(o).alias("fold"), F.col(str(o)).alias("held_rows")) for o in range(5)])).alias("e"))
    return rounded(found.join(held.select("e.*"), "fold"), 6)


@query("boost_many_categories")
def q_boost_many(spark, sf):
    """T7 on a column of as many values as there are customers."""
    d = fx.fsig(spark, sf).filter(F.col("part") == "train").select("id", "s", "o_totalprice", F.col("c_acctbal").cast("string").alias("account"))
    d = materialise(d, "sig-rows")      # read by dictionary, folds and fit: the join and hashes are computed once
    tr = encode.category_encode(d, [folds.assign_kfold(d, k=5, seed=42)], ["account"])[0]
    res = boost.fit_boosted(tr, ["o_totalprice", "account"], "s", boost.cv_specs(5, "fold"), MANY_P, categorical=["account"], keep_cols=["fold"])
    return rounded(boost.oof_predictions(res, 5), 6)


# the number of trees and the depth of the registry's "cls_leafwise_a"
FOREST_TREES, FOREST_DEPTH = registry.REGISTRY["cls_leafwise_a"]["n_estimators"], registry.REGISTRY["cls_leafwise_a"]["max_depth"]


@query("forest_score")
def q_forest_score(spark, sf):
    """An ensemble of full size as a table: quantile cuts of the training rows, features, cuts and leaf values of the nodes
    by hash; every row walks down all its trees."""
    d = fx.fsig(spark, sf)
    cols = ["o_totalprice", "c_acctbal"]
    binning = boost.fit_bins(d.filter(F.col("part") == "train"), cols, max_bins=16)
    inner = 1 << FOREST_DEPTH
    nodes = spark.range(FOREST_TREES * (2 * inner - 1)).select(
        (F.col("id") / F.lit(2 * inner - 1)).cast("int").alias("tree"), (F.col("id") % (2 * inner - 1) + 1).alias("node"))
    u = lambda i: F.conv(F.substring("h", 8 * i + 1, 8), 16, 10).cast("long")
    nodes = nodes.withColumn("h", F.md5(F.concat_ws("|", F.lit("forest"), "tree", "node"))).withColumn("f", (u(0) % 2).cast("int"))
    split = F.col("node") < inner
    bins = F.when(F.col("f") == 0, F.lit(len(binning.cuts[0]))).otherwise(F.lit(len(binning.cuts[1])))
    nodes = nodes.select(F.lit(0).alias("model"), "tree", "node", F.when(split, F.element_at(F.array(*map(F.lit, cols)), F.col("f") + 1)).alias("feature"),
                         F.when(split, (u(1) % bins).cast("int")).alias("bin"), F.lit(False).alias("missing_left"),
                         F.lit(None).cast("array<int>").alias("left_codes"),
                         F.when(~split, u(2) / F.lit(2.0 ** 36) - 0.03).alias("value"))
    features = spark.createDataFrame([(i, c, False, binning.cuts[i], binning.n_bins[i]) for i, c in enumerate(cols)], boost_features)
    models = spark.createDataFrame([(0, 0.25, "logistic")], boost_models)
    forest = boost.Forest.from_tables(nodes, features, models)
    return rounded(forest.score(d.select("id", *cols), 0, "pred").select("id", "pred"), 6)


# the pipelines' own parameters, small enough for a test run
CV_SUBMISSION_P = boost.BoostParams(objective="logistic", n_trees=6, learning_rate=0.3, max_depth=4, max_leaves=6, reg_alpha=1.0, reg_lambda=0.5,
                                    min_child_samples=31, max_bins=32, early_stopping=3)
STACK_A = boost.BoostParams(objective="logistic", n_trees=4, learning_rate=0.3, max_depth=3, min_child_weight=6.0, max_bins=32)
STACK_B = boost.BoostParams(objective="logistic", n_trees=4, learning_rate=0.3, max_depth=2, symmetric=True, reg_lambda=3.0, max_bins=32)


@query("cv_submission")
def q_cv_pipeline(spark, sf):
    d = fx.fsig(spark, sf)
    train = d.filter(F.col("part") == "train").select("id", "y_sig", "o_totalprice", "c_acctbal",
                                                      "c_mktsegment", "o_orderpriority")
    test = d.filter(F.col("part") == "test").select("id", "o_totalprice", "c_acctbal", "c_mktsegment",
                                                    "o_orderpriority")
    r = pipelines.cv_pipeline(train, test, "y_sig", ["o_totalprice", "c_acctbal", "c_mktsegment", "o_orderpriority"],
                              CV_SUBMISSION_P, k=5, target_encode_cols=["c_mktsegment", "o_orderpriority"], smoothing=0.5)
    return rounded(r.submission, 6)


SCORES_P = boost.BoostParams(objective="squared", n_trees=8, learning_rate=0.3, max_depth=3, gamma=1.5, min_child_weight=5.0,
                             colsample_bytree=0.6, reg_lambda=2.0, reg_alpha=2.5, max_bins=32, early_stopping=3)


@query("cv_scores")
def q_cv_scores(spark, sf):
    d = fx.fsig(spark, sf)
    train = d.filter(F.col("part") == "train").select("id", "s", "o_totalprice", "c_acctbal", "c_mktsegment")
    test = d.filter(F.col("part") == "test").select("id", "o_totalprice", "c_acctbal", "c_mktsegment")
    ext = d.filter(F.col("part") == "original").select("s", "c_mktsegment")
    r = pipelines.cv_pipeline(train, test, "s", ["o_totalprice", "c_acctbal", "c_mktsegment"], SCORES_P, k=5,
                              stratified=False, categorical_cols=["c_mktsegment"], external=ext,
                              external_cols=["c_mktsegment"], metric="rmse")
    return rounded(r.scores, 6)


@query("vote_submission")
def q_vote_pipeline(spark, sf):
    oof = fx.fpred_oof(spark, sf)
    t = fx.fpred_test(spark, sf)
    r = pipelines.vote_pipeline([oof.select("id", "p1", "y"), oof.select("id", "p2", "y")],
                                [t.select("id", "fold", "p1"), t.select("id", "fold", "p2")], ["p1", "p2"])
    return rounded(r.submission)


@query("stack_submission")
def q_stack(spark, sf):
    d = fx.fsig(spark, sf)
    train = d.filter(F.col("part") == "train").select("id", "y_sig", "o_totalprice", "c_acctbal", "c_nationkey")
    test = d.filter(F.col("part") == "test").select("id", "o_totalprice", "c_acctbal", "c_nationkey")
    orig = d.filter(F.col("part") == "original").select("y_sig", "c_nationkey")
    _, auc, sub = pipelines.stack_pipeline(train, test, "y_sig", ["o_totalprice", "c_acctbal", "c_nationkey"],
                                           [("a", STACK_A), ("b", STACK_B)], external=orig,
                                           external_cols=["c_nationkey"])
    return rounded(sub, 6)


@query("stacking_report")
def q_stacking_report(spark, sf):
    d = fx.fsig(spark, sf).filter(F.col("part") == "train").select(
        "id", "y_sig", "o_totalprice", "c_acctbal", "c_nationkey")
    ev = pipelines.StackingEvaluator(
        [pipelines.BaseModel("a", STACK_A, ["o_totalprice", "c_acctbal"]),
         pipelines.BaseModel("b", STACK_B, ["o_totalprice", "c_nationkey"])], d, "y_sig").fit()
    return rounded(ev.report())


# --------------------------------------------------------------- sinks
from ..sources import io  # noqa: E402


@query("submission")
def q_submission(spark, sf):
    """Template ids (all test rows) left-joined to the ridge blend of the fold predictions."""
    oof = fx.fpred_oof(spark, sf)
    t = fx.fpred_test(spark, sf)
    preds = pipelines.blend_pipeline([oof.select("id", "p1", "y"), oof.select("id", "p2", "y")],
                                     [t.select("id", "fold", "p1"), t.select("id", "fold", "p2")],
                                     ["p1", "p2"], kind="ridge")
    template = fx.fsig(spark, sf).filter(F.col("part") == "test").select("id")
    return rounded(io.submission(template, preds, "target", strict=True))


ACCT_CUTS = [-500.0, 0.0, 1000.0, 2000.0, 3000.0, 4000.0, 5000.0, 6000.0, 7000.0, 8000.0, 9000.0]


@query("gbt_first_tree")
def q_first_tree(spark, sf):
    """The first depth-2 tree of five fold models on fixed cut points (splits and leaves)."""
    tr = folds.assign_kfold(fx.fsig(spark, sf).filter(F.col("part") == "train"), k=5, seed=42)
    binning = boost.Binning(["o_totalprice", "c_acctbal"], [False, False], [SPLIT_CUTS, ACCT_CUTS],
                            [len(SPLIT_CUTS) + 2, len(ACCT_CUTS) + 2])
    p = boost.BoostParams(objective="squared", n_trees=1, learning_rate=1.0, max_depth=2, reg_alpha=0.5,
                          reg_lambda=1.0, min_child_weight=1.0)
    res = boost.fit_boosted(tr, binning.features, "s", boost.cv_specs(5, "fold"), p, binning=binning,
                            keep_cols=["fold"])
    rows = []
    for m in range(5):
        t = res.trees[m][0]
        rows += [(m, n, sp.feature, sp.threshold, None) for n, sp in sorted(t.splits.items())]
        rows += [(m, n, None, None, float(v)) for n, v in sorted(t.leaves.items())]
    return rounded(spark.createDataFrame(rows, "model int, node int, feat int, bin int, value double"), 6)


@query("source_flag")
def q_source_flag(spark, sf):
    """P5: generated rows flagged 1, external (original) rows 0."""
    d = fx.fcls(spark, sf)
    gen = features.add_source_flag(d.filter(F.col("part") == "train").select("id", "y"), 1)
    orig = features.add_source_flag(d.filter(F.col("part") == "original").select("id", "y"), 0)
    return gen.unionByName(orig)


@query("target_encode_oof_sparse")
def q_te_oof_sparse(spark, sf):
    """E5 on unbalanced labels (51 of 399 positive at sf0.01): near-empty (fold, class, category) cells."""
    d = fx.fdoc(spark, sf).select("id", F.col("toxic").alias("y"), "lang", "source")
    tr = folds.assign_stratified_kfold(d, "y", k=5, seed=42)
    enc = encode.target_encode_oof(tr, ["lang", "source"], "y", k=5, smoothing=1.0, noise_level=0.0, seed=0)
    return rounded(enc.select("outer", "id", "lang_encoded", "source_encoded"))


# --------------------------------------------------------------- operators on their own
from ..functions.scalar import as_int  # noqa: E402
from ..session import scratch_path  # noqa: E402


def _written(spark, df, write) -> str:
    """Path of a table written to the session's scratch folder by a sink under test."""
    path = scratch_path(spark, "sink")
    write(df, path)
    return path


@query("read_table")
def q_read_table(spark, sf):
    """The order keys and prices as CSV, read back with a schema and the key renamed."""
    d = fx.fcls(spark, sf).select(F.col("id").alias("key"), "o_totalprice", "o_orderpriority")
    path = _written(spark, d, lambda t, p: t.write.option("header", "true").csv(p))
    return rounded(io.read_table(spark, path, fmt="csv", rename_id="key",
                                 schema="key long, o_totalprice double, o_orderpriority string"))


@query("read_reference_table")
def q_read_reference(spark, sf):
    """External labelled rows with their own key and label names."""
    d = fx.fcls(spark, sf).filter(F.col("part") == "original").select(
        F.col("id").alias("ext_id"), F.col("y").alias("target"), "c_nationkey")
    path = _written(spark, d, lambda t, p: t.write.parquet(p))
    return io.read_reference_table(spark, path, key_col="ext_id", rename={"target": "y"})


@query("oof_round_trip")
def q_oof_round_trip(spark, sf):
    """S5 then S3: OOF predictions written, read back under a model name."""
    d = fx.fpred_oof(spark, sf).select("id", "fold", F.col("p1").alias("pred"), "y")
    return rounded(io.read_oof(spark, _written(spark, d, io.write_oof), "m1"))


@query("fold_predictions_round_trip")
def q_fold_round_trip(spark, sf):
    """S6 then S4: fold test predictions written by fold, read back under a model name."""
    d = fx.fpred_test(spark, sf).select("id", "fold", F.col("p1").alias("pred"))
    return rounded(io.read_fold_predictions(spark, _written(spark, d, io.write_fold_predictions), "m1"))


@query("split_features_label")
def q_split_features(spark, sf):
    """Feature columns without id, label and excludes; the label beside them."""
    d = fx.fcls(spark, sf)
    feats, label = features.split_features_label(d, "y", exclude=["part", "status"])
    assert features.select_stat_columns(d, "y", exclude=["part", "status"]) == feats
    return rounded(d.select("id", *feats, label))


@query("categorical_columns")
def q_categorical_columns(spark, sf):
    """The string columns."""
    d = fx.fcls(spark, sf)
    return d.select("id", *features.categorical_columns(d, exclude=["part"]))


@query("cast_label")
def q_cast_label(spark, sf):
    """A boolean label and a double code as integers."""
    d = fx.fcls(spark, sf).select("id", (F.col("status") == "F").alias("label"), F.col("c_nationkey").cast("double").alias("code"))
    return features.cast_label(d, "label").withColumn("code", as_int(F.col("code")))


@query("fill_default")
def q_fill_default(spark, sf):
    """A left-joined statistic filled with the global mean, renamed, its source column dropped."""
    d = fx.fcls(spark, sf)
    fit = d.filter((F.col("part") == "train") & (F.col("o_orderpriority") != "5-LOW"))
    st = stats.key_target_stats(fit, ["o_orderpriority"], "y", count=False)
    t = stats.join_key_stats(d.filter(F.col("part") == "test").select("id", "o_orderpriority"), st)
    t = t.crossJoin(F.broadcast(stats.global_mean(fit, "y")))      # one row
    t = features.fill_default(t, ["o_orderpriority_mean"], "global_mean")
    return rounded(features.rename_prediction(features.drop_encoded_sources(t, ["o_orderpriority"]), {"o_orderpriority_mean": "enc"}))


@query("train_valid_split")
def q_train_valid(spark, sf):
    """Fold 2 split off, every part put together again."""
    tr = _fcls_folds(spark, sf).select("id", "fold", "y")
    train, valid = folds.train_valid_split(tr, 2)
    other = folds.filter_fold(tr, 0).withColumn("role", F.lit("fold0"))
    return features.union_folds([train.withColumn("role", F.lit("train")), valid.withColumn("role", F.lit("valid")), other])


@query("stack_predictions")
def q_stack_predictions(spark, sf):
    """Long predictions of three models as a stack matrix."""
    long = _pred_long(spark, sf).select("id", "model", F.col("score").alias("pred"))
    return rounded(blend.stack_predictions(long, ["p1", "p2", "p3"]))


@query("score_report")
def q_score_report(spark, sf):
    """V5, V4: pooled AUC of each prediction column."""
    return rounded(metrics.score_report(fx.fpred_oof(spark, sf), ["p1", "p2", "p3"]))


@query("fold_scores")
def q_fold_scores(spark, sf):
    """V3: AUC and RMSE of one model per fold."""
    d = fx.fpred_oof(spark, sf)
    return rounded(metrics.fold_scores(d, "p1").unionByName(metrics.fold_scores(d, "p1", metric="rmse")))


def _blend_inputs(spark, sf):
    oof, t = fx.fpred_oof(spark, sf), fx.fpred_test(spark, sf)
    return ([oof.select("id", "p1", "y"), oof.select("id", "p2", "y")],
            [t.select("id", "fold", "p1"), t.select("id", "fold", "p2")], ["p1", "p2"])


@query("blend_pipeline_lda")
def q_blend_lda(spark, sf):
    """C2 with the discriminant."""
    return rounded(pipelines.blend_pipeline(*_blend_inputs(spark, sf), kind="lda"))


@query("vote_scores")
def q_vote_scores(spark, sf):
    """Pooled out-of-fold AUC of logistic regression, discriminant and vote."""
    return rounded(pipelines.vote_pipeline(*_blend_inputs(spark, sf)).scores, 7)


@query("vote_only_submission")
def q_vote_only(spark, sf):
    """C3 with the vote as the final prediction, which equals the mean of the three (Q22)."""
    return rounded(pipelines.vote_pipeline(*_blend_inputs(spark, sf), final="vote").submission)


@query("stacking_linear_bases")
def q_stacking_linear(spark, sf):
    """C5 with linear bases on the caller's folds: the bases' pooled out-of-fold scores."""
    d = fx.fpred_oof(spark, sf)
    ev = pipelines.StackingEvaluator([pipelines.BaseModel("ridge", "ridge", BLEND_X), pipelines.BaseModel("lda", "lda", BLEND_X)],
                                     d, "y", stacker="lda", fold_col="fold").fit()
    return rounded(ev.report().filter(F.col("model").isin("ridge", "lda")), 7)


CV_P = boost.BoostParams(objective="squared", n_trees=4, learning_rate=0.3, max_depth=3, max_bins=32, min_child_weight=5.0, early_stopping=3)


@query("cv_external_mean")
def q_cv_external(spark, sf):
    """C1 with external means only (E7) and external training rows in every fold."""
    d = fx.fsig(spark, sf)
    cols = ["id", "s", "o_totalprice", "c_acctbal", "c_nationkey"]
    ext = d.filter(F.col("part") == "original").select(*cols)
    r = pipelines.cv_pipeline(d.filter(F.col("part") == "train").select(*cols), d.filter(F.col("part") == "test").select(*cols),
                              "s", cols[2:], CV_P, stratified=False, external=ext, external_cols=["c_nationkey"],
                              external_stats=("mean",), external_rows=ext, metric="rmse")
    return rounded(r.oof, 6)


@query("cv_plain_encoding")
def q_cv_plain(spark, sf):
    """C1 with the plain target encoding (E4) of every outer-train part."""
    d = fx.fsig(spark, sf)
    cols = ["id", "s", "o_totalprice", "c_mktsegment"]
    r = pipelines.cv_pipeline(d.filter(F.col("part") == "train").select(*cols), d.filter(F.col("part") == "test").select(*cols),
                              "s", cols[2:], CV_P, stratified=False, target_encode_cols=["c_mktsegment"], encoding="plain",
                              smoothing=2.0, metric="rmse")
    return rounded(r.submission, 6)


@query("bucketed_join_oof")
def q_bucketed_oof(spark, sf):
    """S5, S3, J2 over tables bucketed by id: three joined side by side without another shuffle."""
    d = fx.fpred_oof(spark, sf)
    tables = []
    for c in ("p1", "p2", "p3"):
        path = _written(spark, d.select("id", c, "y"), lambda t, p: io.write_bucketed(t, p, buckets=16))
        tables.append(io.read_bucketed(spark, path, buckets=16))
    return rounded(blend.join_oof(tables))


@query("bucketed_align_folds")
def q_bucketed_align(spark, sf):
    """S6, S4, J3 over tables bucketed by (id, fold)."""
    d = fx.fpred_test(spark, sf)
    keys = ("id", "fold")
    paths = [_written(spark, d.select("id", "fold", c), lambda t, p: io.write_bucketed(t, p, keys, 16)) for c in ("p1", "p2")]
    return rounded(blend.align_fold_predictions([io.read_bucketed(spark, p, keys, 16) for p in paths]))
