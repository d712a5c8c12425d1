"""Metrics (V1-V5, A7) as distributed aggregates.

ROC-AUC is exact (ties count half) and never sorts all scores in one task:

1. group rows by ``(by..., score)`` -> positives ``p`` and negatives ``q``
   per distinct score (map-side combine, so a hot score is one row);
2. order-preserving buckets from approximate quantiles of the distinct
   scores (``n_buckets`` cut points: the only driver round trip, bounded);
3. negatives per bucket -> running total over the small bucket table;
4. running sum of ``q`` inside each bucket (window on ``(by, bucket)``);
5. ``AUC = sum p * (2*Q_below + q) / (2 * P * N)``, summed exactly as
   DECIMAL(38,0) so the numerator cannot overflow at any scale.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_FACTOR = "decimal(20,0)"


def _score_buckets(g: DataFrame, score_col: str, n_buckets: int) -> DataFrame:
    probs = [i / n_buckets for i in range(1, n_buckets)]
    row = g.agg(F.percentile_approx(score_col, probs, 10 * n_buckets).alias("q")).first()
    cuts = sorted({float(x) for x in (row["q"] or []) if x is not None and x == x})
    splits = [float("-inf"), *cuts, float("inf")]
    if len(splits) < 3:
        return g.withColumn("__bk", F.lit(0.0))
    return Bucketizer(splits=splits, inputCol=score_col, outputCol="__bk",
                      handleInvalid="keep").transform(g)


def roc_auc(df: DataFrame, score_col: str, label_col: str = "y", by: Sequence[str] = (),
            out_col: str = "auc", n_buckets: int = 256) -> DataFrame:
    """V1/V3/V4: exact ROC-AUC per group of ``by`` (pooled when empty)."""
    by = list(by)
    y = F.col(label_col).cast("long")
    g = (df.filter(F.col(label_col).isNotNull() & F.col(score_col).isNotNull())
           .groupBy(*by, score_col)
           .agg(F.sum(y).alias("__p"), F.sum(F.lit(1) - y).alias("__q")))
    g = _score_buckets(g, score_col, n_buckets)

    bucket_neg = g.groupBy(*by, "__bk").agg(F.sum("__q").alias("__qb"))
    before_b = (Window.partitionBy(*by).orderBy("__bk")
                .rowsBetween(Window.unboundedPreceding, -1))
    bucket_off = (bucket_neg.withColumn("__off", F.coalesce(F.sum("__qb").over(before_b), F.lit(0)))
                            .drop("__qb"))
    before_s = (Window.partitionBy(*by, "__bk").orderBy(score_col)
                .rowsBetween(Window.unboundedPreceding, -1))
    inside = g.withColumn("__in", F.coalesce(F.sum("__q").over(before_s), F.lit(0)))
    # ``inside`` is hash-partitioned by (by, bucket) for its window; joining on
    # exactly those keys keeps that partitioning, so only the small offset
    # table (groups x n_buckets rows) moves -- or AQE broadcasts it.
    j = inside.join(bucket_off, [*by, "__bk"], "inner")
    below = F.col("__off") + F.col("__in")
    # exact integer arithmetic at any scale: both factors as DECIMAL(20,0)
    # (p * (2Q + q) can exceed a long beyond ~2e9 rows), summed as DECIMAL(38,0)
    term = F.col("__p").cast(_FACTOR) * (F.lit(2) * below + F.col("__q")).cast(_FACTOR)
    agg = j.groupBy(*by).agg(F.sum(term).alias("__num"), F.sum("__p").alias("__P"),
                             F.sum("__q").alias("__N"))
    # a group with a single class has no AUC: null, not a division by zero
    auc = F.when((F.col("__P") > 0) & (F.col("__N") > 0),
                 F.col("__num").cast("double")
                 / (F.lit(2.0) * F.col("__P").cast("double") * F.col("__N").cast("double")))
    return agg.select(*by, auc.alias(out_col))


def rmse(df: DataFrame, pred_col: str, label_col: str = "y", by: Sequence[str] = (),
         out_col: str = "rmse") -> DataFrame:
    """V2: root mean squared error per group."""
    d = F.col(label_col).cast("double") - F.col(pred_col).cast("double")
    return df.groupBy(*by).agg(F.sqrt(F.avg(d * d)).alias(out_col))


def fold_scores(df: DataFrame, pred_col: str, label_col: str = "y", metric: str = "auc",
                fold_col: str = "fold", model: str | None = None) -> DataFrame:
    """V3: one row per fold: ``(model, fold, metric, value)``."""
    if metric == "auc":
        s = roc_auc(df, pred_col, label_col, by=[fold_col], out_col="value")
    elif metric == "rmse":
        s = rmse(df, pred_col, label_col, by=[fold_col], out_col="value")
    else:
        raise ValueError(f"unknown metric {metric!r}")
    return s.select(F.lit(model or pred_col).alias("model"), F.col(fold_col).alias("fold"),
                    F.lit(metric).alias("metric"), "value")


def pooled_score(df: DataFrame, pred_col: str, label_col: str = "y", metric: str = "auc",
                 model: str | None = None) -> DataFrame:
    """V4: metric over all OOF rows at once."""
    if metric == "auc":
        s = roc_auc(df, pred_col, label_col, out_col="value")
    elif metric == "rmse":
        s = rmse(df, pred_col, label_col, out_col="value")
    else:
        raise ValueError(f"unknown metric {metric!r}")
    return s.select(F.lit(model or pred_col).alias("model"), F.lit(metric).alias("metric"), "value")


def mean_fold_score(scores: DataFrame, by: Sequence[str] = ("model", "metric")) -> DataFrame:
    """Mean of per-fold metric values."""
    return scores.groupBy(*by).agg(F.avg("value").alias("mean_value"))


def score_report(df: DataFrame, pred_cols: Sequence[str], label_col: str = "y",
                 metric: str = "auc") -> DataFrame:
    """V5: one ``(model, metric, value)`` row per prediction column."""
    parts = [pooled_score(df, c, label_col, metric, model=c) for c in pred_cols]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
