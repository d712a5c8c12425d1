"""Linear meta-models from sufficient statistics.

Every fit is a handful of aggregates whose result has a size fixed by the
number of features and folds, never by the number of rows:

* **ridge** (T8) and **LDA** (T9): one pass computes, per ``(fold, class)``,
  the count, the sums and the cross-products of the features centred on
  their global means.  Moments are additive, so the model of outer fold
  ``o`` uses ``total - fold o`` -- all ``k`` cross-validation models and the
  full refit come from the same pass (K5, K7).
* **logistic** (T10): Newton / IRLS.  One aggregate per step evaluates the
  gradient and Hessian of **all** ``k + 1`` models at once: each row adds
  to model ``o`` only when ``fold <> o`` (a masked sum, no row copies).
  ``penalize_intercept=True`` gives the liblinear objective
  ``1/2 (|w|^2 + b^2) + C * logloss``; ``False`` leaves ``b`` free (lbfgs).
* **Wide features**: p(p + 1) / 2 aggregate expressions are fine for a stack of predictions, not for hundreds of columns.
  From ``WIDE`` columns on the same sums are matrix products of Arrow batches: each task adds up a Gram matrix per group (or a Hessian
  per model) and emits it row by row; equal rows are summed in parallel.  The results agree up to rounding.
* **scoring** (T12) is a column expression with literal coefficients, so
  it stays inside whole-stage codegen and works on streaming DataFrames.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALL = -1   # key of the model fitted on every row
WIDE = 32   # columns from which sums are taken by matrix products


@dataclass
class LinearModel:
    kind: str                      # "ridge" | "lda" | "logistic"
    features: list[str]
    coefs: dict[int, tuple[float, np.ndarray]] = field(default_factory=dict)
    n_iter: int = 0

    @property
    def is_regressor(self) -> bool:
        return self.kind == "ridge"

    def margin(self, key: int = ALL) -> Column:
        b, w = self.coefs[key]
        e = F.lit(float(b))
        for f, wi in zip(self.features, w):
            e = e + F.lit(float(wi)) * F.col(f).cast("double")
        return e

    def predict(self, key: int = ALL) -> Column:
        """Regression value (ridge) or probability of class 1."""
        m = self.margin(key)
        return m if self.is_regressor else F.lit(1.0) / (F.lit(1.0) + F.exp(-m))

    def predict_by_fold(self, fold_col: str = "fold") -> Column:
        """Out-of-fold prediction: the row's own fold selects the model."""
        keys = sorted(k for k in self.coefs if k != ALL)
        e = None
        for k in keys:
            e = (F.when(F.col(fold_col) == k, self.predict(k)) if e is None
                 else e.when(F.col(fold_col) == k, self.predict(k)))
        return e

    def coef_table(self, spark) -> DataFrame:
        rows = [(int(k), float(b), [float(x) for x in w]) for k, (b, w) in sorted(self.coefs.items())]
        return spark.createDataFrame(rows, "outer int, intercept double, coef array<double>")


# ---------------------------------------------------------------- moments
def _means(df: DataFrame, cols: Sequence[str]) -> np.ndarray:
    row = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    return np.array([float(row[f"m{i}"]) for i in range(len(cols))])


def _rows_summed(parts: DataFrame, keys: Sequence[str]) -> list:
    """Rows (keys, i, v) of the tasks' matrices, equal (keys, i) added up: matrix rows x groups reach the driver."""
    names = [*keys, "i", "v"]

    def add(t: pa.Table) -> pa.Table:
        total = np.sum([np.asarray(v) for v in t.column("v").to_pylist()], axis=0)
        return pa.table([t.column(c)[:1] for c in names[:-1]] + [pa.array([total.tolist()], pa.list_(pa.float64()))], names=names)
    return parts.groupBy(*keys, "i").applyInArrow(add, parts.schema).collect()


def _gram(df: DataFrame, cols: Sequence[str], by: Sequence[str], m: np.ndarray) -> dict:
    """``{group: (n, s, Q)}`` by one matrix product per batch and group; null values add nothing, as in a SQL sum."""
    p, by = len(cols), list(by)

    def run(batches):
        sums: dict = {}
        for b in batches:
            if not b.num_rows:
                continue
            x = np.column_stack([b.column(c).fill_null(mi).to_numpy(zero_copy_only=False) for c, mi in zip(cols, m)]) - m
            groups: dict = {}
            for r, key in enumerate(zip(*(b.column(c).to_pylist() for c in by))) if by else [(slice(None), ())]:
                groups.setdefault(key, []).append(r)
            for key, rows in groups.items():
                own = x[rows] if by else x
                q = np.vstack([own.T @ own, own.sum(axis=0)])
                n, total = sums.get(key, (0, 0.0))
                sums[key] = (n + len(own), total + q)
        rows = [(*key, i, [float(n)] if i > p else total[i].tolist()) for key, (n, total) in sums.items() for i in range(p + 2)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[*by, "i", "v"])

    fields = [df.schema[c] for c in by]
    from pyspark.sql.pandas.types import to_arrow_type
    kinds = [*(to_arrow_type(f.dataType) for f in fields), pa.int32(), pa.list_(pa.float64())]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "i int", "v array<double>"])
    out: dict = {}
    for r in _rows_summed(df.mapInArrow(run, schema), by):
        out.setdefault(tuple(r[c] for c in by), {})[r["i"]] = np.array(r["v"])
    return {key: (int(v[p + 1][0]), v[p], np.array([v[i] for i in range(p)])) for key, v in out.items()}


def centred_moments(df: DataFrame, cols: Sequence[str], by: Sequence[str]):
    """``{group: (n, s, Q)}`` of ``cols`` centred on their global means ``m``.

    ``s = sum(x - m)``, ``Q = sum((x - m)(x - m)^T)``.  Returns ``(m, groups)``.
    """
    # two passes (means, then centred moments) over a narrow cached projection
    df = df.select(*by, *[F.col(c).cast("double").alias(c) for c in cols]).persist(
        StorageLevel.MEMORY_AND_DISK)
    m = _means(df, cols)
    if len(cols) >= WIDE:
        out = _gram(df, cols, by, m)
        df.unpersist()
        return m, out
    xs = [F.col(c) - F.lit(float(mi)) for c, mi in zip(cols, m)]
    p = len(cols)
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.sum(xs[i]).alias(f"s{i}") for i in range(p)]
    aggs += [F.sum(xs[i] * xs[j]).alias(f"q{i}_{j}") for i in range(p) for j in range(i, p)]
    out = {}
    for r in df.groupBy(*by).agg(*aggs).collect():      # one row per (fold, class): bounded
        key = tuple(r[b] for b in by)
        s = np.array([float(r[f"s{i}"]) for i in range(p)])
        Q = np.zeros((p, p))
        for i in range(p):
            for j in range(i, p):
                Q[i, j] = Q[j, i] = float(r[f"q{i}_{j}"])
        out[key] = (int(r["n"]), s, Q)
    df.unpersist()
    return m, out


def _combine(parts):
    n = sum(p[0] for p in parts)
    s = sum(p[1] for p in parts)
    Q = sum(p[2] for p in parts)
    return n, s, Q


def _folds_of(groups, fold_pos=0):
    return sorted({k[fold_pos] for k in groups})


# ---------------------------------------------------------------- ridge
def _ridge_solve(n, s, Q, m, alpha):
    """Columns: features then label (last)."""
    mean = m + s / n
    C = Q - np.outer(s, s) / n                   # centred scatter of the subset
    p = len(m) - 1
    A = C[:p, :p] + alpha * np.eye(p)
    w = np.linalg.solve(A, C[:p, p])
    b = mean[p] - mean[:p] @ w
    return float(b), w


def fit_ridge_cv(df: DataFrame, features: Sequence[str], label_col: str, fold_col: str | None = "fold",
                 alpha: float = 1.0) -> LinearModel:
    """Ridge (intercept unpenalised): one model per outer fold and one on all rows."""
    cols = [*features, label_col]
    by = [fold_col] if fold_col else []
    m, g = centred_moments(df, cols, by)
    model = LinearModel("ridge", list(features))
    model.coefs[ALL] = _ridge_solve(*_combine(list(g.values())), m, alpha)
    if fold_col:
        for o in _folds_of(g):
            model.coefs[int(o)] = _ridge_solve(*_combine([v for k, v in g.items() if k[0] != o]), m, alpha)
    return model


# ---------------------------------------------------------------- LDA
def _lda_solve(per_class, m):
    (n0, s0, Q0), (n1, s1, Q1) = per_class[0], per_class[1]
    if n0 == 0 or n1 == 0:
        raise ValueError("LDA needs both classes in every training part")
    mu0, mu1 = m + s0 / n0, m + s1 / n1
    W = (Q0 - np.outer(s0, s0) / n0) + (Q1 - np.outer(s1, s1) / n1)
    S = W / (n0 + n1 - 2)
    beta = np.linalg.pinv(S) @ (mu1 - mu0)
    b = -0.5 * (mu1 + mu0) @ beta + np.log(n1 / n0)
    return float(b), beta


def fit_lda_cv(df: DataFrame, features: Sequence[str], label_col: str,
               fold_col: str | None = "fold") -> LinearModel:
    """Two-class LDA: pooled covariance ``W/(n-2)``, empirical priors."""
    by = ([fold_col] if fold_col else []) + [label_col]
    m, g = centred_moments(df, list(features), by)
    model = LinearModel("lda", list(features))

    def classes(keep):
        out = {}
        for c in (0, 1):
            out[c] = _combine([v for k, v in g.items() if int(k[-1]) == c and keep(k)])
        return out

    model.coefs[ALL] = _lda_solve(classes(lambda k: True), m)
    if fold_col:
        for o in _folds_of(g):
            model.coefs[int(o)] = _lda_solve(classes(lambda k, o=o: k[0] != o), m)
    return model


# ---------------------------------------------------------------- logistic
def _newton_sums(data: DataFrame, keys: Sequence[int], w: dict, xs: Sequence[str]) -> dict:
    """``{key: (loss, gradient, Hessian)}`` of all models in one aggregate, written as SQL text
    (one JVM call per expression, not one per operator)."""
    d, aggs = len(xs), []
    for key in keys:
        z = " + ".join([f"({float(w[key][0])!r}D)"] + [f"({float(w[key][j])!r}D) * {xs[j]}" for j in range(1, d)])
        p = f"(1.0D / (1.0D + exp(-({z}))))"
        mask = "" if key == ALL else f"CASE WHEN __fold <> {key} THEN 1.0D ELSE 0.0D END * "
        tag = "a" if key == ALL else str(key)
        aggs.append(F.expr(f"sum({mask}(greatest({z}, 0.0D) + log1p(exp(-abs({z}))) - __y * ({z}))) AS l{tag}"))
        aggs += [F.expr(f"sum({mask}({p} - __y) * {xs[i]}) AS g{tag}_{i}") for i in range(d)]
        aggs += [F.expr(f"sum({mask}{p} * (1.0D - {p}) * {xs[i]} * {xs[j]}) AS h{tag}_{i}_{j}") for i in range(d) for j in range(i, d)]
    row, out = data.agg(*aggs).first(), {}
    for key in keys:
        tag = "a" if key == ALL else str(key)
        H = np.zeros((d, d))
        for i in range(d):
            for j in range(i, d):
                H[i, j] = H[j, i] = row[f"h{tag}_{i}_{j}"]
        out[key] = (row[f"l{tag}"] or 0.0, np.array([row[f"g{tag}_{i}"] for i in range(d)]), H)
    return out


def _newton_wide(data: DataFrame, keys: Sequence[int], w: dict, d: int) -> dict:
    """The same by matrix products of batches; rows with a null feature, label or fold are not allowed."""
    point = {k: np.array(w[k]) for k in keys}

    def run(batches):
        sums = {k: np.zeros((d + 2, d)) for k in keys}
        for b in batches:
            if not b.num_rows:
                continue
            col = lambda c: b.column(c).to_numpy(zero_copy_only=True)  # noqa: E731  nulls fail here
            x = np.column_stack([np.ones(b.num_rows), *(col(f"__x{j}") for j in range(1, d))])
            y, fold = col("__y"), col("__fold") if "__fold" in b.schema.names else None
            for k in keys:
                rows = slice(None) if k == ALL else fold != k
                own, t = x[rows], y[rows]
                z = own @ point[k]
                p = 0.5 * (1.0 + np.tanh(0.5 * z))
                sums[k][:d] += (own * (p * (1.0 - p))[:, None]).T @ own
                sums[k][d] += own.T @ (p - t)
                sums[k][d + 1, 0] += float((np.maximum(z, 0.0) + np.log1p(np.exp(-np.abs(z))) - t * z).sum())
        rows = [(k, i, v.tolist()) for k, total in sums.items() for i, v in enumerate(total)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.list_(pa.float64())))],
                                         names=["k", "i", "v"])
    total = {k: np.zeros((d + 2, d)) for k in keys}
    for r in _rows_summed(data.mapInArrow(run, "k int, i int, v array<double>"), ["k"]):
        total[r["k"]][r["i"]] = r["v"]
    return {k: (float(t[d + 1, 0]), t[d], t[:d]) for k, t in total.items()}


def fit_logistic_cv(df: DataFrame, features: Sequence[str], label_col: str,
                    fold_col: str | None = "fold", C: float = 1.0,
                    penalize_intercept: bool = True, max_iter: int = 50,
                    tol: float = 1e-10, k: int | None = None) -> LinearModel:
    """L2 logistic regression by damped Newton steps, all fold models per pass.

    Each pass also sums the objective; a step that did not lower a model's objective is halved and
    tried again.  Raises if ``max_iter`` passes don't bring the step below ``tol``.
    """
    feats = list(features)
    d = len(feats) + 1
    if fold_col and k is None:
        k = int(df.agg(F.max(fold_col)).first()[0]) + 1
    keys = ([*range(k)] if fold_col else []) + [ALL]
    w = {key: np.zeros(d) for key in keys}
    last = {key: (np.zeros(d), np.inf, np.zeros(d)) for key in keys}   # accepted point, its objective, its step
    reg = np.eye(d)
    if not penalize_intercept:
        reg[0, 0] = 0.0
    data = df.select(*[F.col(f).cast("double").alias(f"__x{j}") for j, f in enumerate(feats, 1)],
                     F.col(label_col).cast("double").alias("__y"),
                     *([F.col(fold_col).alias("__fold")] if fold_col else []))
    data = data.persist(StorageLevel.MEMORY_AND_DISK)     # narrow: p features, label, fold
    xs = ["1.0D"] + [f"__x{j}" for j in range(1, d)]
    it, step = 0, 0.0
    for it in range(1, max_iter + 1):
        sums = _newton_wide(data, keys, w, d) if d > WIDE else _newton_sums(data, keys, w, xs)
        step = 0.0
        for key in keys:
            loss, gradient, hessian = sums[key]
            value = loss * C + 0.5 * float(w[key] @ reg @ w[key])
            point, least, move = last[key]
            if not value <= least + 1e-9 * max(1.0, abs(least)):    # also when not a number
                last[key] = (point, least, move / 2)
                w[key] = point - move / 2
                step = max(step, float(np.max(np.abs(move / 2))))
                continue
            g = gradient * C + reg @ w[key]
            H = hessian * C + reg
            delta = np.linalg.solve(H, g)
            last[key] = (w[key], value, delta)
            w[key] = w[key] - delta
            step = max(step, float(np.max(np.abs(delta))))
        if step < tol:
            break
    data.unpersist()
    if step >= tol:
        raise RuntimeError(f"logistic regression: step {step:.3g} after {max_iter} passes, tolerance {tol:g}")
    model = LinearModel("logistic", feats, n_iter=it)
    for key in keys:
        model.coefs[key] = (float(w[key][0]), w[key][1:].copy())
    return model


# ---------------------------------------------------------------- voting and scoring
def soft_vote(models: Sequence[LinearModel], key: int = ALL) -> Column:
    """Mean class-1 probability of several classifiers."""
    e = models[0].predict(key)
    for mdl in models[1:]:
        e = e + mdl.predict(key)
    return e / F.lit(float(len(models)))


def soft_vote_by_fold(models: Sequence[LinearModel], fold_col: str = "fold") -> Column:
    e = models[0].predict_by_fold(fold_col)
    for mdl in models[1:]:
        e = e + mdl.predict_by_fold(fold_col)
    return e / F.lit(float(len(models)))


def batch_score(df: DataFrame, model: LinearModel, out_col: str = "pred", key: int = ALL) -> DataFrame:
    """Apply a fitted model as a column expression."""
    return df.withColumn(out_col, model.predict(key))
