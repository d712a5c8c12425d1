"""Per-key statistics and their joins.

Every key column has one aggregate of its own that reads this column, the label and the
``by`` columns only: each column of a columnar table is read once, and no row is expanded
into one copy per column.  Partial aggregation runs map-side, so a hot key costs one
row per task, not one task holding a third of the data.  Each column's
statistics are then joined back once, carrying all of its measures.

Join strategy is left to AQE: a statistics table is the output of an
aggregate whose exact size is known when its shuffle finishes, so AQE
turns the join into a broadcast only when that size is under
``spark.sql.adaptive.autoBroadcastJoinThreshold`` and keeps a sort-merge
join (with skew splitting) for high-cardinality keys such as raw floats.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType


def valid_key(df: DataFrame, c: str) -> Column:
    """Keys that pandas would group: not null and, for floats, not NaN (Q16)."""
    t = df.schema[c].dataType
    cond = F.col(c).isNotNull()
    if isinstance(t, (DoubleType, FloatType)):
        cond = cond & ~F.isnan(F.col(c))
    return cond


def global_mean(df: DataFrame, label_col: str, by: Sequence[str] = (),
                out_col: str = "global_mean") -> DataFrame:
    """A1: mean label (of non-null labels) per group of ``by``."""
    return df.groupBy(*by).agg(F.avg(F.col(label_col).cast("double")).alias(out_col))


def multi_key_stats(df: DataFrame, key_cols: Sequence[str], aggs: dict[str, Column],
                    by: Sequence[str] = ()) -> dict[str, DataFrame]:
    """One aggregate per key column -> ``{key_col: DataFrame(by..., key_col, aggs...)}``.

    Null (and NaN) keys are dropped per column, as pandas ``groupby`` does.
    """
    named = [e.alias(n) for n, e in aggs.items()]
    return {c: df.filter(valid_key(df, c)).groupBy(*by, c).agg(*named) for c in key_cols}


def key_target_stats(df: DataFrame, key_cols: Sequence[str], label_col: str,
                     by: Sequence[str] = (), mean: bool = True, count: bool = True,
                     count_rows: bool = True) -> dict[str, DataFrame]:
    """A2-A4: per key value ``<col>_mean`` and ``<col>_count``.

    ``count_rows=True`` counts rows whatever the label (pandas ``size``);
    ``False`` counts non-null labels (pandas ``count``) (Q15).
    """
    y = F.col(label_col).cast("double")
    aggs = {"__mean": F.avg(y), "__count": F.count(F.lit(1)) if count_rows else F.count(y)}
    stats = multi_key_stats(df, key_cols, aggs, by)
    out = {}
    for c, st in stats.items():
        cols = [*by, c]
        if mean:
            cols.append(F.col("__mean").alias(f"{c}_mean"))
        if count:
            cols.append(F.col("__count").alias(f"{c}_count"))
        out[c] = st.select(*cols)
    return out


def join_key_stats(df: DataFrame, stats: dict[str, DataFrame], by: Sequence[str] = ()) -> DataFrame:
    """Left join each column's statistics on ``(by..., key)``; unseen -> null (Q13)."""
    for c, st in stats.items():
        df = df.join(st, [*by, c], "left")
    return df


def external_stats(ref: DataFrame, targets: Sequence[DataFrame], key_cols: Sequence[str],
                   label_col: str, mean: bool = True, count: bool = True) -> list[DataFrame]:
    """Statistics of an external labelled table, joined onto every target.

    Computed once, outside any fold loop (labels come from another dataset,
    so there is no fold leakage, Q14).
    """
    stats = key_target_stats(ref, key_cols, label_col, mean=mean, count=count, count_rows=True)
    return [join_key_stats(t, stats) for t in targets]


def external_target_mean(ref, targets, key_cols, label_col):
    """``<col>_mean`` only."""
    return external_stats(ref, targets, key_cols, label_col, mean=True, count=False)


def external_count(ref, targets, key_cols, label_col):
    """``<col>_count`` only (rows per key, null labels included)."""
    return external_stats(ref, targets, key_cols, label_col, mean=False, count=True)
