"""Joining and averaging prediction tables.

Prediction tables are always keyed: OOF tables by ``id``, fold test
tables by ``(id, fold)`` (Q1-Q3).  Positional alignment of the reference
becomes an equi-join; duplicated or null keys are rejected by ``assert_unique`` and tables that
don't hold the same keys by ``assert_same_keys`` (``check=False`` leaves both out where the
caller has made sure).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assert_unique(df: DataFrame, keys: Sequence[str], name: str = "table") -> DataFrame:
    """Fail if any key occurs twice (one aggregate; only offending keys reach the driver)."""
    dup = df.groupBy(*keys).count().filter(F.col("count") > 1).limit(1).collect()
    if dup:
        raise ValueError(f"{name}: duplicated key {[dup[0][k] for k in keys]}")
    if df.filter(F.greatest(*[F.col(k).isNull() for k in keys]) if len(keys) > 1
                 else F.col(keys[0]).isNull()).limit(1).count():
        raise ValueError(f"{name}: null key")
    return df


def assert_same_keys(tables: Sequence[DataFrame], keys: Sequence[str], name: str = "tables") -> None:
    """Fail if a table lacks a key that another one has: one aggregate over the keys of all tables."""
    n = len(tables)
    every = tables[0].select(*keys)
    for t in tables[1:]:
        every = every.unionByName(t.select(*keys))
    odd = every.groupBy(*keys).count().filter(F.col("count") != n).limit(1).collect()
    if odd:
        raise ValueError(f"{name}: key {[odd[0][k] for k in keys]} is in {odd[0]['count']} rows of {n} tables")


def _checked(tables: Sequence[DataFrame], keys: Sequence[str], name: str, check: bool) -> None:
    if check:
        for t in tables:
            assert_unique(t, keys, name)
        if len(tables) > 1:
            assert_same_keys(tables, keys, name)


def join_oof(tables: Sequence[DataFrame], id_col: str = "id", label_col: str = "y", check: bool = True) -> DataFrame:
    """N-way inner join of OOF tables on ``id``; the label comes from the first."""
    _checked(tables, [id_col], "oof tables", check)
    out = tables[0]
    for t in tables[1:]:
        out = out.join(t.drop(label_col) if label_col in t.columns else t, id_col, "inner")
    return out


def align_fold_predictions(tables: Sequence[DataFrame], id_col: str = "id",
                           fold_col: str = "fold", check: bool = True) -> DataFrame:
    """Per-fold test predictions side by side, joined on ``(id, fold)``; every table must hold the same pairs."""
    _checked(tables, [id_col, fold_col], "fold tables", check)
    out = tables[0]
    for t in tables[1:]:
        out = out.join(t, [id_col, fold_col], "inner")
    return out


def stack_predictions(long_df: DataFrame, models: Sequence[str], id_col: str = "id",
                      model_col: str = "model", pred_col: str = "pred",
                      keys: Sequence[str] = (), check: bool = True) -> DataFrame:
    """Long ``(id, model, pred)`` -> wide stack matrix (one column per model)."""
    if check:
        assert_unique(long_df, [id_col, model_col, *keys], "predictions")
    return (long_df.groupBy(id_col, *keys).pivot(model_col, list(models))
                   .agg(F.first(pred_col)))


def mean_over_folds(df: DataFrame, pred_cols: Sequence[str], id_col: str = "id") -> DataFrame:
    """A5: average of the per-fold test predictions of every id."""
    return df.groupBy(id_col).agg(*[F.avg(c).alias(c) for c in pred_cols])


def mean_over_models(df: DataFrame, pred_cols: Sequence[str], out_col: str = "pred") -> DataFrame:
    """Row-wise mean of several model columns."""
    e = F.col(pred_cols[0]).cast("double")
    for c in pred_cols[1:]:
        e = e + F.col(c).cast("double")
    return df.withColumn(out_col, e / F.lit(float(len(pred_cols))))
