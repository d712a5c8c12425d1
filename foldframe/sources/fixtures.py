"""Learning tables derived from the shared test data (see FIXTURES.md).

Each fixture is a lazy DataFrame over the parquet tables; only the columns
it needs reach the scan.  The matching DuckDB text lives in
``foldframe.plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import hash_hex, std_normal
from ..operators.folds import assign_stratified_kfold


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def split_part(id_col) -> F.Column:
    """train / test / original by the first byte of md5('split|id')."""
    b = F.conv(F.substring(hash_hex(F.lit("split"), id_col), 1, 2), 16, 10).cast("int")
    return F.when(b < 128, "train").when(b < 192, "test").otherwise("original")


def fcls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-CLS: orders x customer, label y = (o_orderstatus = 'F')."""
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    c = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    j = o.join(c, o.o_custkey == c.c_custkey, "inner")
    return j.select(
        F.col("o_orderkey").alias("id"),
        "o_orderpriority", "c_mktsegment", "c_nationkey", "o_totalprice", "c_acctbal",
        F.col("o_orderstatus").alias("status"),
        (F.col("o_orderstatus") == "F").cast("int").alias("y"),
        split_part(F.col("o_orderkey")).alias("part"),
    )


def fsig(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-SIG: F-CLS plus a planted-signal label ``s`` and ``y_sig = s > 2``."""
    s = F.round(
        F.lit(0.8) * F.col("o_totalprice") / F.lit(1e5)
        + (F.col("c_mktsegment") == "BUILDING").cast("int").cast("double")
        - F.lit(0.0001) * F.col("c_acctbal")
        + std_normal(F.lit("sig"), F.col("id")), 9)
    return (fcls(spark, sf_dir).withColumn("s", s)
            .withColumn("y_sig", (F.col("s") > 2.0).cast("int")))


def _pred_cols(df: DataFrame, tag1, tag2) -> DataFrame:
    p1 = F.lit(0.4) + F.lit(0.2) * F.col("y") + F.lit(0.15) * std_normal(tag1, F.col("id"))
    p2 = F.lit(0.4) + F.lit(0.1) * F.col("y") + F.lit(0.20) * std_normal(tag2, F.col("id"))
    return (df.withColumn("p1", p1).withColumn("p2", p2)
              .withColumn("p3", F.round(F.col("p1"), 1)))


def fpred_oof(spark: SparkSession, sf_dir: str, k: int = 5, seed: int = 42) -> DataFrame:
    """F-PRED OOF side: ``id, fold, y, p1, p2, p3`` for every train id."""
    base = (fsig(spark, sf_dir).filter(F.col("part") == "train")
            .select("id", F.col("y_sig").alias("y")))
    base = assign_stratified_kfold(base, "y", k=k, seed=seed)
    return _pred_cols(base, F.lit("p1"), F.lit("p2")).select("id", "fold", "y", "p1", "p2", "p3")


def fpred_test(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    """F-PRED test side: one row per ``(id, fold)`` of the test ids."""
    base = (fsig(spark, sf_dir).filter(F.col("part") == "test")
            .select("id", F.col("y_sig").alias("y"))
            .withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))))
    tag1 = F.concat_ws("|", F.lit("p1"), F.col("fold").cast("string"))
    tag2 = F.concat_ws("|", F.lit("p2"), F.col("fold").cast("string"))
    return _pred_cols(base, tag1, tag2).select("id", "fold", "p1", "p2", "p3")


def freg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-REG: part, label p_retailprice."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), "p_brand", "p_type", "p_size", "p_retailprice")


def fevt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-EVT: events (numeric value, categorical event_type, user_id)."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), "value", "event_type", "user_id")


def fdoc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-DOC: labels x documents (unbalanced labels, near-empty cells)."""
    lab = table(spark, sf_dir, "labels")
    doc = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return lab.join(doc, "doc_id", "inner").withColumnRenamed("doc_id", "id")
