"""Fold assignment (K1-K4).

A row's fold is its position in the order ``(stratum, md5(id|seed), id)``
taken modulo ``k``.  Because consecutive positions cycle through the folds,
every fold differs in size by at most one, overall and inside every
stratum (stratified k-fold semantics), and the result depends only on the
ids, the labels and the seed -- not on partitioning or executor count.

The global position is computed without a single-partition sort:

* ``bucket`` = first ``bucket_digits`` hex digits of the hash, so the sort
  order is ``(stratum, bucket, hash, id)``;
* one aggregate counts rows per ``(stratum, bucket)``; a running sum over
  that small table (at most ``strata * 16**bucket_digits`` rows) gives the
  offset of each bucket;
* ``row_number`` inside ``(stratum, bucket)`` plus the offset is the exact
  global position.  Hash buckets are uniform, so no bucket is hot even when
  one label value holds most rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hash_hex


def _keyed(df: DataFrame, seed: int, id_col: str, strata: str | None, bucket_digits: int) -> DataFrame:
    """Adds the order of the rows: hash, stratum (a flag and a value, nulls first) and hash bucket."""
    keyed = df.withColumn("__h", hash_hex(F.col(id_col), F.lit(str(seed))))
    if strata:
        # (is-not-null flag, value): plain equi-join keys that still order nulls first
        t = df.schema[strata].dataType
        keyed = (keyed.withColumn("__sn", F.col(strata).isNotNull().cast("int"))
                      .withColumn("__s", F.coalesce(F.col(strata), F.lit(0).cast(t) if t.typeName() != "string"
                                                    else F.lit(""))))
    else:
        keyed = keyed.withColumn("__sn", F.lit(1)).withColumn("__s", F.lit(0))
    return keyed.withColumn("__b", F.substring("__h", 1, bucket_digits))


def _assign(df: DataFrame, k: int, seed: int, id_col: str, strata: str | None,
            by: Sequence[str], fold_col: str, bucket_digits: int) -> DataFrame:
    if k < 2:
        raise ValueError("k must be at least 2")
    by = list(by)
    keyed = _keyed(df, seed, id_col, strata, bucket_digits)
    grp = [*by, "__sn", "__s", "__b"]

    counts = keyed.groupBy(*grp).agg(F.count(F.lit(1)).alias("__n"))
    before = (Window.partitionBy(*by).orderBy("__sn", "__s", "__b")
              .rowsBetween(Window.unboundedPreceding, -1))
    offsets = (counts.withColumn("__off", F.coalesce(F.sum("__n").over(before), F.lit(0)))
                     .drop("__n"))
    # rows are hash-partitioned by grp for the window; joining on exactly grp
    # keeps that partitioning, so only the small offset table moves
    ranked = keyed.withColumn(
        "__r", F.row_number().over(Window.partitionBy(*grp).orderBy("__h", id_col)))
    out = ranked.join(offsets, on=grp, how="inner")
    fold = ((F.col("__off") + F.col("__r") - 1) % F.lit(k)).cast("int")
    return out.withColumn(fold_col, fold).drop("__h", "__sn", "__s", "__b", "__r", "__off")


def assign_kfold(df: DataFrame, k: int = 5, seed: int = 42, id_col: str = "id",
                 fold_col: str = "fold", by: Sequence[str] = (),
                 bucket_digits: int = 4) -> DataFrame:
    """K1: shuffled k-fold; fold sizes differ by at most one."""
    return _assign(df, k, seed, id_col, None, by, fold_col, bucket_digits)


def assign_stratified_kfold(df: DataFrame, label_col: str, k: int = 5, seed: int = 42,
                            id_col: str = "id", fold_col: str = "fold",
                            by: Sequence[str] = (), bucket_digits: int = 4) -> DataFrame:
    """K2: stratified k-fold: per class and overall sizes differ by at most one."""
    return _assign(df, k, seed, id_col, label_col, by, fold_col, bucket_digits)


def explode_outer_train(df: DataFrame, k: int, fold_col: str = "fold",
                        outer_col: str = "outer") -> DataFrame:
    """One copy of each row per outer fold it trains in (``fold <> outer``)."""
    return (df.withColumn(outer_col, F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
              .filter(F.col(fold_col) != F.col(outer_col)))


def assign_inner_folds(df: DataFrame, label_col: str | None, k_outer: int = 5,
                       k_inner: int = 5, seed: int = 1, id_col: str = "id",
                       fold_col: str = "fold", outer_col: str = "outer",
                       inner_col: str = "inner", bucket_digits: int = 4) -> DataFrame:
    """K3: re-split every outer-train part into ``k_inner`` (stratified) folds.

    Output: one row per ``(outer, row)`` with ``fold <> outer`` and its
    ``inner`` fold, ranked inside the outer-train part only.  One window over the rows
    gives all ranks, as running counts of ``fold <> outer``; the copies are made afterwards.
    """
    if k_inner < 2:
        raise ValueError("k must be at least 2")
    outers = range(k_outer)
    keyed = _keyed(df.filter(F.col(fold_col).isNotNull()), seed, id_col, label_col, bucket_digits)
    grp = ["__sn", "__s", "__b"]
    outside = [(F.col(fold_col) != o).cast("long") for o in outers]
    before = Window.orderBy(*grp).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (keyed.groupBy(*grp).agg(*[F.sum(c).alias(f"__n{o}") for o, c in zip(outers, outside)])
               .select(*grp, *[F.coalesce(F.sum(f"__n{o}").over(before), F.lit(0)).alias(f"__off{o}") for o in outers]))
    upto = Window.partitionBy(*grp).orderBy("__h", id_col).rowsBetween(Window.unboundedPreceding, 0)
    ranked = keyed.select("*", *[F.sum(c).over(upto).alias(f"__r{o}") for o, c in zip(outers, outside)])
    copies = F.array(*[F.struct(F.lit(o).alias("o"), ((F.col(f"__off{o}") + F.col(f"__r{o}") - 1) % k_inner).cast("int").alias("i"))
                       for o in outers])
    out = ranked.join(offsets, grp, "inner").withColumn(
        "__c", F.explode(F.filter(copies, lambda x: x.o != F.col(fold_col))))
    return out.select(*df.columns, F.col("__c.o").alias(outer_col), F.col("__c.i").alias(inner_col))


def train_valid_split(df: DataFrame, i: int, fold_col: str = "fold"):
    """K4: rows outside / inside fold ``i``."""
    return df.filter(F.col(fold_col) != i), df.filter(F.col(fold_col) == i)


def filter_fold(df: DataFrame, i: int, fold_col: str = "fold") -> DataFrame:
    """Rows of one fold (pushed down to the scan when ``fold`` is a partition column)."""
    return df.filter(F.col(fold_col) == i)
