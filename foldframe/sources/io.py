"""Sources and sinks.

Readers take an explicit schema in production (``schema=``); CSV type
inference is opt-in.  Writers keep the key columns so that every hand-off
between jobs is joined on keys, never on row order (Q1-Q3).  Fold test
predictions are written ``partitionBy("fold")`` so a later fold filter is
partition pruning.
"""

from __future__ import annotations

import hashlib
import warnings
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.blend import assert_unique


def _reader(spark: SparkSession, fmt: str, schema=None):
    r = spark.read.format(fmt)
    if fmt == "csv":
        r = r.option("header", "true")
        r = r.schema(schema) if schema is not None else r.option("inferSchema", "true")
    elif schema is not None:
        r = r.schema(schema)
    return r


def _fmt(path: str, fmt: str | None) -> str:
    if fmt:
        return fmt
    return "csv" if path.rstrip("/").endswith(".csv") else "parquet"


def read_table(spark: SparkSession, path: str, id_col: str = "id", fmt: str | None = None,
               schema=None, rename_id: str | None = None) -> DataFrame:
    """A train/test table with its key as an explicit column."""
    df = _reader(spark, _fmt(path, fmt), schema).load(path)
    if rename_id and rename_id in df.columns:
        df = df.withColumnRenamed(rename_id, id_col)
    if id_col not in df.columns:
        raise ValueError(f"{path} has no key column {id_col!r}")
    return df


def read_reference_table(spark: SparkSession, path: str, key_col: str | None = None,
                         id_col: str = "id", fmt: str | None = None, schema=None,
                         rename: Mapping[str, str] | None = None) -> DataFrame:
    """External labelled table; its own key (if any) renamed to ``id_col``."""
    df = _reader(spark, _fmt(path, fmt), schema).load(path)
    if key_col and key_col in df.columns:
        df = df.withColumnRenamed(key_col, id_col)
    for a, b in (rename or {}).items():
        df = df.withColumnRenamed(a, b)
    return df


def read_oof(spark: SparkSession, path: str, name: str, id_col: str = "id", label_col: str = "y",
             pred_col: str | None = None, keep_label: bool = True, fmt: str | None = None, schema=None) -> DataFrame:
    """S3: OOF table -> ``(id, <name>[, y])``."""
    df = _reader(spark, _fmt(path, fmt), schema).load(path)
    pred = pred_col or [c for c in df.columns if c not in (id_col, label_col, "fold")][0]
    cols = [F.col(id_col), F.col(pred).cast("double").alias(name)]
    if keep_label and label_col in df.columns:
        cols.append(F.col(label_col))
    return df.select(*cols)


def read_fold_predictions(spark: SparkSession, path: str, name: str, id_col: str = "id",
                          fold_col: str = "fold", pred_col: str | None = None,
                          fmt: str | None = None, schema=None) -> DataFrame:
    """Fold test table -> ``(id, fold, <name>)``."""
    df = _reader(spark, _fmt(path, fmt), schema).load(path)
    if id_col not in df.columns:
        raise ValueError("fold prediction tables must carry the id column (no positional alignment)")
    pred = pred_col or [c for c in df.columns if c not in (id_col, fold_col)][0]
    return df.select(F.col(id_col), F.col(fold_col).cast("int"), F.col(pred).cast("double").alias(name))


def write_oof(oof: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """OOF predictions ``(id, fold, pred, y)`` in one fold-keyed write."""
    w = oof.write.mode(mode)
    (w.option("header", "true").csv(path) if fmt == "csv" else w.format(fmt).save(path))


def write_fold_predictions(test_preds: DataFrame, path: str, fold_col: str = "fold",
                           fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Per-fold test scores, partitioned by fold."""
    w = test_preds.write.mode(mode).partitionBy(fold_col)
    (w.option("header", "true").csv(path) if fmt == "csv" else w.format(fmt).save(path))


# --------------------------------------------------------------------- co-partitioned prediction tables
def _bucket_table(path: str) -> str:
    return "bucketed_" + hashlib.md5(path.encode()).hexdigest()[:16]


def write_bucketed(df: DataFrame, path: str, keys: Sequence[str] = ("id",), buckets: int = 200) -> None:
    """S5/S6 for tables that are joined again and again: Parquet in ``buckets`` files hashed and sorted by ``keys``.

    The rows are shuffled once, here; joins and aggregates on ``keys`` over tables of equal ``buckets`` (J2, J3) then need no
    exchange.  Choose ``buckets`` so that a bucket's rows fit a task.
    """
    (df.repartition(buckets, *keys).write.mode("overwrite").format("parquet").option("path", path)
       .bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(_bucket_table(path)))


def read_bucketed(spark: SparkSession, path: str, keys: Sequence[str] = ("id",), buckets: int = 200) -> DataFrame:
    """A table of ``write_bucketed``, from any session: ``keys`` and ``buckets`` must be those it was written with.

    Turns ``spark.sql.unionOutputPartitioning`` off in the session: with it, Spark 4.1 takes a union of bucketed scans for
    partitioned by their keys, which it isn't, and groups such a union wrongly.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    name = _bucket_table(path)
    cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
    own = ", ".join(f"`{k}`" for k in keys)
    spark.sql(f"DROP TABLE IF EXISTS {name}")       # the catalog's entry; the files stay
    spark.sql(f"CREATE TABLE {name} ({cols}) USING parquet CLUSTERED BY ({own}) SORTED BY ({own}) INTO {int(buckets)} BUCKETS "
              f"LOCATION '{path}'")
    return spark.table(name)


def submission(template: DataFrame, preds: DataFrame, label_col: str, pred_col: str = "pred",
               id_col: str = "id", check: bool = True, strict: bool = False) -> DataFrame:
    """S7 (frame): the template's ids with the label column filled by the prediction.

    ``check``: both tables must hold each id once, and template ids without a prediction are reported
    as a warning, or with ``strict`` as an error.
    """
    if check:
        assert_unique(template, [id_col], "template")
        assert_unique(preds, [id_col], "predictions")
        lost = template.join(preds.select(id_col), id_col, "left_anti").agg(F.count(F.lit(1)), F.min(id_col)).first()
        if lost[0]:
            said = f"{lost[0]} ids of the template have no prediction, the first is {lost[1]}"
            if strict:
                raise ValueError(said)
            warnings.warn(said, stacklevel=2)
    return (template.select(id_col)
                    .join(preds.select(id_col, F.col(pred_col).alias(label_col)), id_col, "left"))


def write_submission(template: DataFrame, preds: DataFrame, path: str, label_col: str,
                     pred_col: str = "pred", id_col: str = "id", fmt: str = "csv",
                     mode: str = "overwrite") -> DataFrame:
    """Write the submission table; returns it."""
    sub = submission(template, preds, label_col, pred_col, id_col)
    w = sub.write.mode(mode)
    (w.option("header", "true").csv(path) if fmt == "csv" else w.format(fmt).save(path))
    return sub
