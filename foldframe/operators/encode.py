"""Encoders (E1-E6, M4, M5).

* Ordinal / category codes come from a dictionary fitted on one table
  (sorted distinct values -> 0..k-1) and joined onto any other (Q19).
* Target encodings are smoothed means ``(S + s*g) / (N + s)`` with a
  deterministic hash-Gaussian noise (Q10).
* The out-of-fold encoding (E5) is computed for **all** outer folds in one
  job: one window ranks every row inside each outer-train part, the rows are then
  replicated once per outer fold they train in, one aggregate per column yields the
  ``(outer, key, inner)`` cells, and the leave-one-inner-fold-out statistic
  is ``total - own`` (a window over the small cell table).  No per-fold
  loop, no per-row Python.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import gaussian_noise
from ..functions.scalar import smoothed_mean
from ..session import materialise
from .folds import assign_inner_folds
from .stats import global_mean, multi_key_stats, valid_key


# --------------------------------------------------------------------- E1-E3
def fit_dictionaries(fit: DataFrame, cols: Sequence[str]) -> dict[str, DataFrame]:
    """Sorted distinct non-null values of each column -> ``(col, <col>__code)``.

    The distinct values (map-side combined) are sorted by ranges and written; a code is the place inside the range plus the
    sizes of the ranges before, so no task orders a whole dictionary, and its size is known before it is joined.
    """
    values = multi_key_stats(fit, cols, {"__one": F.lit(1)})
    out = {}
    for c, v in values.items():
        ranged = materialise(v.select(c).repartitionByRange(c).withColumn("__part", F.spark_partition_id()), "codes")
        # a row per range
        parts = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
        before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
        parts = parts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
        place = F.row_number().over(Window.partitionBy("__part").orderBy(F.col(c).asc()))
        out[c] = ranged.withColumn("__place", place).join(F.broadcast(parts), "__part").select(
            c, (F.col("__off") + F.col("__place") - 1).cast("int").alias(f"{c}__code"))
    return out


def apply_dictionaries(df: DataFrame, dicts: dict[str, DataFrame], unknown: str = "minus_one",
                       null_code: int | None = None, suffix: str = "") -> DataFrame:
    """Replace each column by its code.

    ``unknown``: ``"minus_one"`` (unseen -> -1) or ``"error"`` (unseen value
    fails the job).  ``null_code``: code for a null input (default: null).
    """
    for c, d in dicts.items():
        df = df.join(d, c, "left")
        code = F.col(f"{c}__code")
        if unknown == "minus_one":
            miss = F.lit(-1)
        elif unknown == "error":
            miss = F.raise_error(F.concat(F.lit(f"unknown category in {c}: "),
                                          F.col(c).cast("string"))).cast("int")
        else:
            raise ValueError("unknown must be 'minus_one' or 'error'")
        null_val = F.lit(null_code).cast("int") if null_code is not None else F.lit(None).cast("int")
        enc = (F.when(F.col(c).isNull(), null_val)
                .when(code.isNull(), miss).otherwise(code))
        df = df.withColumn(c + suffix if suffix else c, enc).drop(f"{c}__code")
    return df


def ordinal_encode(fit: DataFrame, targets: Sequence[DataFrame], cols: Sequence[str],
                   unknown: str = "minus_one") -> list[DataFrame]:
    """E1 (unknown -> -1) / E2 (``unknown="error"``): codes replace the strings."""
    dicts = fit_dictionaries(fit, cols)
    return [apply_dictionaries(t, dicts, unknown=unknown) for t in targets]


def category_encode(fit: DataFrame, targets: Sequence[DataFrame],
                    cols: Sequence[str]) -> list[DataFrame]:
    """Nominal codes for native categorical splits; null and unseen -> -1."""
    dicts = fit_dictionaries(fit, cols)
    return [apply_dictionaries(t, dicts, unknown="minus_one", null_code=-1) for t in targets]


# --------------------------------------------------------------------- E4
def _noise_tag(kind: str, seed: int, col: str):
    return F.lit(f"{kind}|{seed}|{col}")


def target_encode(fit: DataFrame, targets: Sequence[DataFrame], cat_cols: Sequence[str],
                  label_col: str, smoothing: float = 1.0, noise_level: float = 0.0,
                  seed: int = 0, by: Sequence[str] = (), suffix: str = "_encoded",
                  gm_col: str = "__gm") -> list[DataFrame]:
    """Plain smoothed target encoding fitted on ``fit`` (leaky on its own rows, Q11).

    Noise is one draw **per category** (and per ``by`` group), so every
    table that sees the category gets the same noisy value (Q9).  Unseen
    or null categories get the global mean, without noise (Q12).
    """
    by = list(by)
    gm = global_mean(fit, label_col, by, gm_col)   # one row per by-group
    y = F.col(label_col).cast("double")
    stats = multi_key_stats(fit, cat_cols, {"__s": F.sum(y), "__n": F.count(y)}, by)
    encoded = {}
    # the prior table has one row per by-group: broadcast only when that is a single row,
    # otherwise AQE picks the join from its measured size
    for c, st in stats.items():
        st = st.join(gm, by, "inner") if by else st.crossJoin(F.broadcast(gm))
        e = (smoothed_mean(F.coalesce(F.col("__s"), F.lit(0.0)), F.col("__n"), F.col(gm_col), smoothing)
             + gaussian_noise(noise_level, _noise_tag("te", seed, c), *[F.col(b) for b in by],
                              F.col(c)))
        encoded[c] = st.select(*by, c, e.alias(c + suffix))
    out = []
    for t in targets:
        t = t.join(gm, by, "left") if by else t.crossJoin(F.broadcast(gm))
        for c, st in encoded.items():
            t = t.join(st, [*by, c], "left").withColumn(
                c + suffix, F.coalesce(F.col(c + suffix), F.col(gm_col)))
        out.append(t.drop(gm_col))
    return out


# --------------------------------------------------------------------- E5, E6
def target_encode_apply(train: DataFrame, test: DataFrame | None, cat_cols: Sequence[str], label_col: str,
                        k: int = 5, smoothing: float = 1.0, id_col: str = "id", fold_col: str = "fold",
                        outer_col: str = "outer", suffix: str = "_encoded", **_):
    """E6 for every outer fold: ``(valid_enc, test_enc)`` keyed by ``(outer, id)``, without noise.

    ``valid_enc`` holds rows with ``fold = outer``, ``test_enc`` every test row once per outer fold
    (Q20).  The statistics of an outer-train part are all minus its own fold, from one aggregate by
    ``(fold, key)``: no training row is copied.
    """
    y = F.col(label_col).cast("double")
    sums = [F.coalesce(F.sum(y), F.lit(0.0)).alias("__s"), F.count(y).alias("__n")]
    folds_ = F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias(outer_col)

    def less_own(cells: DataFrame, keys: list[str]) -> DataFrame:
        """(outer, keys...) -> sums over all folds but ``outer``."""
        total = cells.groupBy(*keys).agg(F.sum("__s").alias("__ts"), F.sum("__n").alias("__tn")).select("*", folds_)
        own = cells.withColumnRenamed(fold_col, outer_col)
        return total.join(own, [outer_col, *keys], "left").select(
            outer_col, *keys, (F.col("__ts") - F.coalesce("__s", F.lit(0.0))).alias("__ts"),
            (F.col("__tn") - F.coalesce("__n", F.lit(0))).alias("__tn"))

    known = train.filter(F.col(fold_col).isNotNull())
    gm = less_own(known.groupBy(fold_col).agg(*sums), []).select(       # k rows
        outer_col, F.when(F.col("__tn") > 0, F.col("__ts") / F.col("__tn")).alias("__gm"))
    valid = known.withColumn(outer_col, F.col(fold_col)).join(F.broadcast(gm), outer_col, "inner")
    tst = None if test is None else test.select("*", folds_).join(F.broadcast(gm), outer_col, "inner")
    for c in cat_cols:
        cells = known.filter(valid_key(known, c)).groupBy(fold_col, c).agg(*sums)
        stat = less_own(cells, [c])
        e = F.coalesce(smoothed_mean(F.col("__ts"), F.col("__tn"), F.col("__gm"), float(smoothing)), F.col("__gm"))
        valid = valid.join(stat, [outer_col, c], "left").withColumn(c + suffix, e).drop("__ts", "__tn")
        if tst is not None:
            tst = tst.join(stat, [outer_col, c], "left").withColumn(c + suffix, e).drop("__ts", "__tn")
    return valid.drop("__gm"), tst.drop("__gm") if tst is not None else None


def target_encode_oof(train: DataFrame, cat_cols: Sequence[str], label_col: str, k: int = 5, smoothing: float = 1.0,
                      noise_level: float = 0.0, inner_k: int = 5, inner_seed: int = 1, seed: int = 0, id_col: str = "id",
                      fold_col: str = "fold", outer_col: str = "outer", suffix: str = "_encoded") -> DataFrame:
    """E5 for every outer fold: rows with ``fold <> outer``, each encoded with the statistics of the *other*
    inner folds of its outer-train part, the prior being the whole outer-train mean (Q8), plus one noise
    draw per training row (Q9).  The ranked rows are written once to the shared folder, since the prior, the
    cells and every column's join read them."""
    ex = assign_inner_folds(train, label_col, k_outer=k, k_inner=inner_k, seed=inner_seed,
                            id_col=id_col, fold_col=fold_col, outer_col=outer_col)
    ex = materialise(ex, "inner-folds")
    y = F.col(label_col).cast("double")
    gm = global_mean(ex, label_col, [outer_col], "__gm")          # k rows: broadcast
    cells = multi_key_stats(ex, cat_cols, {"__s": F.sum(y), "__n": F.count(y)},
                            by=[outer_col, "inner"])
    per_key = Window.partitionBy(outer_col, "__key")
    out = ex.join(F.broadcast(gm), outer_col, "inner")
    for c in cat_cols:
        cell = cells[c].withColumnRenamed(c, "__key").withColumn(
            "__s", F.coalesce(F.col("__s"), F.lit(0.0)))
        own = cell.select(outer_col, "inner", F.col("__key").alias(c),
                          (F.sum("__s").over(per_key) - F.col("__s")).alias("__rs"),
                          (F.sum("__n").over(per_key) - F.col("__n")).alias("__rn"))
        e = (F.coalesce(smoothed_mean(F.col("__rs"), F.col("__rn"), F.col("__gm"), float(smoothing)), F.col("__gm"))
             + gaussian_noise(noise_level, _noise_tag("te_oof", seed, c), F.col(outer_col), F.col(id_col)))
        out = out.join(own, [outer_col, "inner", c], "left").withColumn(c + suffix, e).drop("__rs", "__rn")
    return out.drop("__gm")


def target_encode_cv(train: DataFrame, test: DataFrame | None, cat_cols: Sequence[str], label_col: str, **kw):
    """E5 + E6 for every outer fold at once: ``(train_enc, valid_enc, test_enc)``."""
    valid, tst = target_encode_apply(train, test, cat_cols, label_col, **kw)
    return target_encode_oof(train, cat_cols, label_col, **kw), valid, tst


__all__ = [
    "fit_dictionaries", "apply_dictionaries", "ordinal_encode", "category_encode",
    "target_encode", "target_encode_cv", "target_encode_oof", "target_encode_apply",
    "valid_key",
]
