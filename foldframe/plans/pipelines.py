"""Composite pipelines (C1-C5): the reference's scripts as Spark jobs.

Every pipeline keeps keys explicit: OOF rows ``(id, fold, pred, y)``, fold
test rows ``(id, fold, pred)``, submissions ``(id, pred)``.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import blend, boost, encode, folds, linear, metrics, stats
from ..operators.boost import BoostParams, ModelSpec
from ..session import materialise


# ------------------------------------------------------------------------- C1
@dataclass
class CVResult:
    oof: DataFrame                 # id, fold, y, pred
    fold_test: DataFrame           # id, fold, pred
    submission: DataFrame          # id, pred
    scores: DataFrame              # model, fold, metric, value
    best_iter: list[int]
    fit: boost.BoostResult | None = None

    def close(self) -> None:
        """Release the booster's cached rows; call it when the tables above have been written."""
        if self.fit:
            self.fit.close()


def cv_pipeline(train: DataFrame, test: DataFrame, label_col: str, features: Sequence[str],
                params: BoostParams, k: int = 5, seed: int = 42, stratified: bool = True,
                id_col: str = "id", ordinal_cols: Sequence[str] = (),
                categorical_cols: Sequence[str] = (), target_encode_cols: Sequence[str] = (),
                smoothing: float = 1.0, noise_level: float = 0.0,
                external: DataFrame | None = None, external_cols: Sequence[str] = (),
                external_stats: Sequence[str] = ("mean", "count"), external_rows: DataFrame | None = None,
                encoding: str = "oof", metric: str | None = None, name: str = "model") -> CVResult:
    """Folds -> encoders -> k boosted models (one pass per level) -> OOF, fold test,
    fold scores, submission.

    * ``ordinal_cols`` (E1) and ``categorical_cols`` (E3, split natively, T7) use a
      dictionary fitted on train;
    * ``external`` + ``external_cols`` add ``<col>_mean`` / ``<col>_count`` (E7/E8), those that
      ``external_stats`` names;
    * ``external_rows`` (same columns, own ids) join the training part of every fold (U2) and are never
      validated on (Q26); not together with ``target_encode_cols``;
    * ``target_encode_cols`` are encoded out-of-fold (E5) for training rows and with
      outer-train statistics for validation and test rows (E6), per outer fold; with
      ``encoding="plain"`` all three by the plain encoding of the outer-train part (E4).
    """
    if external_rows is not None and target_encode_cols:
        raise ValueError("external_rows can't be combined with target_encode_cols")
    metric = metric or ("auc" if params.objective == "logistic" or stratified else "rmse")
    feats = list(features)
    train, test = _written([train, test], "cv-rows")
    if external is not None and external_cols:
        tables = [train, test] + ([external_rows] if external_rows is not None else [])
        train, test, *more = stats.external_stats(external, tables, external_cols, label_col,
                                                  mean="mean" in external_stats, count="count" in external_stats)
        external_rows = more[0] if more else None
        feats += [f"{c}_{s}" for c in external_cols for s in ("mean", "count") if s in external_stats]
    fit_cats = train
    for cols, enc_fn in ((ordinal_cols, encode.ordinal_encode), (categorical_cols, encode.category_encode)):
        if cols and external_rows is not None:
            external_rows = enc_fn(fit_cats, [external_rows], cols)[0]
    if ordinal_cols:
        train, test = encode.ordinal_encode(train, [train, test], ordinal_cols)
    if categorical_cols:
        train, test = encode.category_encode(train, [train, test], categorical_cols)
    train = (folds.assign_stratified_kfold(train, label_col, k=k, seed=seed, id_col=id_col)
             if stratified else folds.assign_kfold(train, k=k, seed=seed, id_col=id_col))

    if target_encode_cols:
        train = materialise(train, "cv-folds")          # read by priors, statistics, copies and validation rows
        if encoding == "plain":
            part = folds.explode_outer_train(train, k)
            every = F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
            tr_enc, va_enc, te_enc = encode.target_encode(
                part, [part, train.withColumn("outer", F.col("fold")), test.withColumn("outer", every)],
                target_encode_cols, label_col, smoothing=smoothing, noise_level=noise_level, seed=seed, by=["outer"])
        else:
            tr_enc, va_enc, te_enc = encode.target_encode_cv(
                train, test, target_encode_cols, label_col, k=k, smoothing=smoothing,
                noise_level=noise_level, seed=seed, id_col=id_col)
        enc = [f"{c}_encoded" for c in target_encode_cols]
        feats = [f for f in feats if f not in set(target_encode_cols)] + enc
        cols = [id_col, "outer", "fold", label_col, *feats]
        rows = (tr_enc.select(*cols, F.lit("train").alias("__role"))
                .unionByName(va_enc.select(*cols, F.lit("valid").alias("__role")))
                .unionByName(te_enc.withColumn("fold", F.lit(-1)).withColumn(label_col, F.lit(None).cast("double"))
                             .select(*cols, F.lit("test").alias("__role"))))
        specs = [ModelSpec(f"fold{o}", (F.col("outer") == o) & (F.col("__role") == "train"),
                           (F.col("outer") == o) & (F.col("__role") == "valid")) for o in range(k)]
        res = boost.fit_boosted(rows, feats, label_col, specs, params, categorical=categorical_cols,
                                id_col=id_col, keep_cols=["outer", "fold", "__role"], disjoint=True,
                                owner=F.col("outer"))
        pred = None
        for o in range(k):
            pred = (F.when(F.col("outer") == o, res.prediction(o)) if pred is None
                    else pred.when(F.col("outer") == o, res.prediction(o)))
        oof = res.rows(F.col("__role") == "valid").select(id_col, "fold", F.col("__y").alias("y"),
                                                             pred.alias("pred"))
        fold_test = res.rows(F.col("__role") == "test").select(id_col, F.col("outer").alias("fold"),
                                                                 pred.alias("pred"))
    else:
        rows = (train.select(id_col, "fold", label_col, *feats, F.lit("train").alias("__role"))
                .unionByName(test.withColumn("fold", F.lit(-1))
                             .withColumn(label_col, F.lit(None).cast(train.schema[label_col].dataType))
                             .select(id_col, "fold", label_col, *feats, F.lit("test").alias("__role"))))
        specs = boost.cv_specs(k, "fold", "__role")
        if external_rows is not None:
            rows = rows.unionByName(external_rows.withColumn("fold", F.lit(-2)).select(
                id_col, "fold", label_col, *feats, F.lit("external").alias("__role")))
            specs = [ModelSpec(s.name, s.train | (F.col("__role") == "external"), s.valid) for s in specs]
        res = boost.fit_boosted(rows, feats, label_col, specs, params,
                                categorical=categorical_cols, id_col=id_col, keep_cols=["fold", "__role"])
        oof = boost.oof_predictions(res, k, id_col=id_col).select(id_col, "fold", "y", "pred")
        fold_test = boost.fold_test_predictions(res, k, F.col("__role") == "test", id_col=id_col)
    scores = metrics.fold_scores(oof, "pred", "y", metric=metric, model=name)
    submission = blend.mean_over_folds(fold_test, ["pred"], id_col=id_col)
    return CVResult(oof, fold_test, submission, scores, res.best_iter, res)


# ------------------------------------------------------------------------- C2, C3
def _written(tables: Sequence[DataFrame], tag: str) -> list[DataFrame]:
    """The tables in the shared folder: key checks, joins and fits read them several times each."""
    return [materialise(t, tag) for t in tables]


def blend_pipeline(oof_tables: Sequence[DataFrame], fold_tables: Sequence[DataFrame],
                   pred_cols: Sequence[str], kind: str = "ridge", label_col: str = "y",
                   id_col: str = "id") -> DataFrame:
    """J2 -> full ridge / LDA fit -> J3 -> score each (id, fold) -> A5 -> (id, pred)."""
    oof = blend.join_oof(_written(oof_tables, "blend-oof"), id_col, label_col)
    fit = linear.fit_ridge_cv if kind == "ridge" else linear.fit_lda_cv
    model = fit(oof, pred_cols, label_col, None)
    test = blend.align_fold_predictions(_written(fold_tables, "blend-test"), id_col)
    scored = test.select(id_col, "fold", model.predict().alias("pred"))
    return blend.mean_over_folds(scored, ["pred"], id_col)


@dataclass
class VoteResult:
    oof: DataFrame                 # id, y, fold, lr, lda, vote
    scores: DataFrame              # model, metric, value (pooled OOF AUC)
    submission: DataFrame          # id, pred


def vote_pipeline(oof_tables: Sequence[DataFrame], fold_tables: Sequence[DataFrame],
                  pred_cols: Sequence[str], label_col: str = "y", id_col: str = "id",
                  k: int = 5, seed: int = 42, final: str = "mean") -> VoteResult:
    """Logistic (penalised intercept), LDA and their soft vote; cross-validated
    OOF probabilities and pooled AUC; full fits scored on every (id, fold), averaged.

    ``final="mean"`` averages LR, LDA and vote (which equals the vote, Q22);
    ``final="vote"`` returns the vote only.
    """
    oof = blend.join_oof(_written(oof_tables, "vote-oof"), id_col, label_col)
    oof = materialise(folds.assign_stratified_kfold(oof, label_col, k=k, seed=seed, id_col=id_col, fold_col="__f"), "vote-rows")
    lr = linear.fit_logistic_cv(oof, pred_cols, label_col, "__f", k=k)
    lda = linear.fit_lda_cv(oof, pred_cols, label_col, "__f")
    scored = oof.select(id_col, label_col, F.col("__f").alias("fold"),
                        lr.predict_by_fold("__f").alias("lr"), lda.predict_by_fold("__f").alias("lda"),
                        linear.soft_vote_by_fold([lr, lda], "__f").alias("vote"))
    scores = metrics.score_report(scored, ["lr", "lda", "vote"], label_col)
    test = blend.align_fold_predictions(_written(fold_tables, "vote-test"), id_col)
    t = test.select(id_col, "fold", lr.predict().alias("lr"), lda.predict().alias("lda"),
                    linear.soft_vote([lr, lda]).alias("vote"))
    avg = blend.mean_over_folds(t, ["lr", "lda", "vote"], id_col)
    if final == "vote":
        sub = avg.select(id_col, F.col("vote").alias("pred"))
    else:
        sub = blend.mean_over_models(avg, ["lr", "lda", "vote"]).select(id_col, "pred")
    return VoteResult(scored, scores, sub)


# ------------------------------------------------------------------------- C5
@dataclass
class BaseModel:
    name: str
    params: BoostParams | str      # a booster's parameters, or "ridge", "lda", "logistic"
    features: list[str]
    categorical: list[str] = field(default_factory=list)


def _fit_linear(kind: str, df: DataFrame, features: Sequence[str], label_col: str, fold_col: str, k: int):
    if kind == "ridge":
        return linear.fit_ridge_cv(df, features, label_col, fold_col)
    if kind == "lda":
        return linear.fit_lda_cv(df, features, label_col, fold_col)
    if kind == "logistic":
        return linear.fit_logistic_cv(df, features, label_col, fold_col, penalize_intercept=False, k=k)
    raise ValueError(f"unknown linear model {kind!r}")


class StackingEvaluator:
    """Out-of-fold base predictions, per-base AUC, a stacker over them.

    ``fit`` trains every base model's k fold models **and** its refit on all
    rows in one boosted run, so ``predict`` needs no further fits (Q24).  The
    stacker is a linear model: ``"logistic"`` (free intercept, the default), ``"lda"``
    or ``"ridge"`` (regressor: raw prediction).  Bases are boosters or the same linear models.
    ``fold_col`` names the caller's own folds, else stratified folds are assigned.  ``report`` gives the base
    scores, the stacker's in-sample score and its cross-validated score.
    """

    def __init__(self, models: Sequence[BaseModel], df: DataFrame, label_col: str, k: int = 5,
                 seed: int = 42, stacker: str = "logistic", id_col: str = "id", fold_col: str | None = None):
        self.fold_col = fold_col
        self.models, self.df, self.label, self.k = list(models), df, label_col, k
        self.seed, self.stacker_kind, self.id = seed, stacker, id_col
        self.results: dict[str, boost.BoostResult] = {}
        self.stack: DataFrame | None = None
        self.stacker: linear.LinearModel | None = None
        self.scores: DataFrame | None = None

    def fit(self) -> StackingEvaluator:
        d = (self.df.withColumn("fold", F.col(self.fold_col)) if self.fold_col else
             folds.assign_stratified_kfold(self.df, self.label, k=self.k, seed=self.seed, id_col=self.id))
        # read by every fit and by the stack: computed once
        own = dict.fromkeys([self.id, "fold", self.label, *(f for bm in self.models for f in [*bm.features, *bm.categorical])])
        d = materialise(d.select(*own), "stacking-rows")
        blend.assert_unique(d, [self.id], "stacking rows")
        specs = boost.cv_specs(self.k, "fold", None, refit=True)
        stack = d.select(self.id, "fold", F.col(self.label).alias("y"))
        names = []
        for bm in self.models:
            if isinstance(bm.params, str):
                self.results[bm.name] = m = _fit_linear(bm.params, d, bm.features, self.label, "fold", self.k)
                stack = stack.join(d.select(self.id, m.predict_by_fold("fold").alias(bm.name)), self.id)
                names.append(bm.name)
                continue
            res = boost.fit_boosted(d, bm.features, self.label, specs, bm.params, categorical=bm.categorical,
                                    id_col=self.id, keep_cols=["fold"])
            self.results[bm.name] = res
            stack = stack.join(boost.oof_predictions(res, self.k, id_col=self.id)
                               .select(self.id, F.col("pred").alias(bm.name)), self.id)
            names.append(bm.name)
        self.stack = stack = materialise(stack, "stack")       # read by the stacker, the report and its scores
        self.stacker = _fit_linear(self.stacker_kind, stack, names, "y", "fold", self.k)
        rep = metrics.score_report(stack, names, "y")
        s_in = stack.select("y", self.stacker.predict().alias("stacker_in_sample"))
        s_cv = stack.select("y", self.stacker.predict_by_fold("fold").alias("stacker_cv"))
        self.scores = (rep.unionByName(metrics.pooled_score(s_in, "stacker_in_sample", "y"))
                          .unionByName(metrics.pooled_score(s_cv, "stacker_cv", "y")))
        return self

    def report(self) -> DataFrame:
        return self.scores

    def close(self) -> None:
        """Release the bases' cached rows; ``report`` and ``predict`` still work."""
        for res in self.results.values():
            if isinstance(res, boost.BoostResult):
                res.close()

    def predict(self, df: DataFrame) -> DataFrame:
        """Refit base models score ``df``; the stacker combines them -> ``(id, pred)``."""
        cols = []
        for bm in self.models:
            res = self.results[bm.name]
            cols.append(bm.name)
            if isinstance(res, linear.LinearModel):
                df = df.withColumn(bm.name, res.predict())
                continue
            df = res.forest().score(df, self.k, bm.name)
        return df.select(self.id, self.stacker.predict().alias("pred"))


# ------------------------------------------------------------------------- C4
def stack_pipeline(train: DataFrame, test: DataFrame, label_col: str, features: Sequence[str],
                   bases: Sequence[tuple[str, BoostParams]], external: DataFrame | None = None,
                   external_cols: Sequence[str] = (), k: int = 5, seed: int = 42,
                   id_col: str = "id", categorical: Sequence[str] = (),
                   external_bases: Sequence[tuple[str, BoostParams]] | None = None):
    """C4: bases on raw features, ``external_bases`` (default: the same) on features + external means (E7),
    OOF columns (K5) and refit test columns (K7), ridge stacker cross-validated (V4),
    ridge refit scores the test rows.  Returns ``(oof_stack, ridge_auc, submission)``; a base's predictions are written to the
    shared folder as soon as it is fitted, and its cached rows released."""
    d = folds.assign_stratified_kfold(train, label_col, k=k, seed=seed, id_col=id_col)
    feature_sets = [("raw", list(features))]
    if external is not None and external_cols:
        d, test = stats.external_target_mean(external, [d, test], external_cols, label_col)
        feature_sets.append(("ext", list(features) + [f"{c}_mean" for c in external_cols]))
    rows = (d.select(id_col, "fold", label_col, *feature_sets[-1][1], F.lit("train").alias("__role"))
            .unionByName(test.withColumn("fold", F.lit(-1))
                         .withColumn(label_col, F.lit(None).cast(d.schema[label_col].dataType))
                         .select(id_col, "fold", label_col, *feature_sets[-1][1], F.lit("test").alias("__role"))))
    rows = materialise(rows, "stack-rows")          # read by every base
    specs = boost.cv_specs(k, "fold", "__role", refit=True)
    learns = rows.filter(F.col("__role") == "train")
    oof = learns.select(id_col, "fold", F.col(label_col).alias("y"))
    tst = rows.filter(F.col("__role") == "test").select(id_col)
    names, todo = [], []
    binnings: dict = {}                             # bases of the same features and number of bins have the same bins
    for fs_name, feats in feature_sets:
        for b_name, params in (external_bases or bases) if fs_name == "ext" else bases:
            name = f"{b_name}_{fs_name}"
            cats = [c for c in categorical if c in feats]
            bins = (fs_name, params.max_bins)
            if bins not in binnings:
                binnings[bins] = boost.fit_bins(learns, [f for f in feats if f not in cats], cats, params.max_bins)
            todo.append((name, feats, params, cats, binnings[bins]))

    def fit(name: str, feats: list[str], params: BoostParams, cats: list[str], binning: boost.Binning) -> DataFrame:
        res = boost.fit_boosted(rows, feats, label_col, specs, params, categorical=cats, id_col=id_col,
                                binning=binning, keep_cols=["fold", "__role"])
        done = materialise(res.state.select(id_col, "__role", res.prediction(k).alias("refit"), boost.oof_expr(res, k).alias("oof")), "base")
        res.close()
        return done
    # two at a time: while the driver plans a pass of one, tasks of the other run
    with ThreadPoolExecutor(2) as pool:
        fitted = [x.result() for x in [pool.submit(fit, *job) for job in todo]]
    for (name, *_), done in zip(todo, fitted):
        oof = oof.join(done.filter(F.col("__role") == "train").select(id_col, F.col("oof").alias(name)), id_col)
        tst = tst.join(done.filter(F.col("__role") == "test").select(id_col, F.col("refit").alias(name)), id_col)
        names.append(name)
    ridge = linear.fit_ridge_cv(oof, names, "y", "fold", alpha=1.0)
    scored = oof.select("y", ridge.predict_by_fold("fold").alias("ridge"))
    auc = metrics.pooled_score(scored, "ridge", "y", model="ridge")
    sub = tst.select(id_col, ridge.predict().alias("pred"))
    return oof, auc, sub
