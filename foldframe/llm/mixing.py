"""Mixing sources to target weights along a training curriculum.

Every source has a weight that changes over the training run: its mean weight times a piecewise-linear
curve over [0, 1].  The integrals of the weights share out the token budget; a source stops at
``max_epochs`` times its own tokens and the excess is reshared by weight (``source_targets``).  A
source's cumulative token demand at time t is its target times the integral of its curve up to t.  Its
documents stand in a fixed pseudo-random order (MD5 of the id); the document that begins at token u of
this order gets the training position t at which the demand reaches u, the inverse of the integral,
and a second epoch begins where the first ends.  Sorting by position gives the training order.

Only DataFrame operations.  The order within a source is cut into 4096 ranges of the MD5, summed
first, so no task holds a whole source however large it is.

Results: null text has size 0 and takes nothing; null sources are one source, the last; documents of a
null id come first in their source; repeated rows are documents of their own; an empty table gives an
empty result; other columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldframe.llm.common import WORD, Scratch, sheltered, table

#: Weight curves of the weight slots at the knots; each integrates to 1, so mean weights stay.
KNOTS = (0.0, 0.5, 1.0)
CURVES = ((1.5, 1.0, 0.5), (0.5, 1.0, 1.5), (1.0, 1.0, 1.0))


def _areas(curve) -> list[float]:
    """Integral of a piecewise-linear curve up to each knot."""
    out = [0.0]
    for i in range(len(KNOTS) - 1):
        out.append(out[-1] + (curve[i] + curve[i + 1]) / 2 * (KNOTS[i + 1] - KNOTS[i]))
    return out


def _inverse(x: Column, curve) -> Column:
    """The time at which the integral of ``curve``, scaled to 1 at the end, reaches ``x``."""
    areas = _areas(curve)
    at = F.lit(1.0)
    for i in reversed(range(len(KNOTS) - 1)):
        width, a, b = KNOTS[i + 1] - KNOTS[i], curve[i], curve[i + 1]
        rest = x * F.lit(areas[-1]) - F.lit(areas[i])
        # rest = a s + (b - a) / (2 width) s^2, solved in the form that also holds for b = a
        s = 2 * rest / (F.lit(float(a)) + F.sqrt(F.greatest(F.lit(0.0), F.lit(float(a * a)) + 2 * F.lit((b - a) / width) * rest)))
        at = F.when(x * F.lit(areas[-1]) < F.lit(areas[i + 1]), F.lit(KNOTS[i]) + s).otherwise(at)
    return F.least(at, F.lit(1.0))


def source_targets(sizes: DataFrame, weights, budget: float, max_epochs: int) -> DataFrame:
    """(source, _n: tokens) -> adds _slot and _target.

    With sources in the order of cap / weight, the common level is the first at which what the
    sources before leave, shared by weight, keeps below the cap.  One row per source.
    """
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    curves = [_areas(c)[-1] for c in CURVES[:len(weights)]]
    every = Window.partitionBy()
    by_ratio = Window.orderBy("_ratio", "_place")
    s = sizes.withColumn("_place", F.row_number().over(in_order) - 1)
    s = s.withColumn("_slot", F.col("_place") % len(weights))
    s = s.withColumn("_w", F.element_at(F.array(*[F.lit(float(w * a)) for w, a in zip(weights, curves)]), F.col("_slot") + 1))
    s = s.withColumn("_cap", F.lit(float(max_epochs)) * F.col("_n")).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    s = s.withColumn("_all", F.sum("_n").over(every) * F.lit(float(budget)))
    s = s.withColumn("_before", F.coalesce(F.sum("_cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("_from", F.sum("_w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("_level", (F.col("_all") - F.col("_before")) / F.col("_from"))
    s = s.withColumn("_level", F.min_by(F.when(F.col("_level") <= F.col("_ratio"), F.col("_level")),
                                        F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_place"))).over(every))
    return s.withColumn("_target", F.least(F.col("_cap"), F.coalesce(F.col("_level") * F.col("_w"), F.col("_cap")))
                        ).drop("_place", "_w", "_cap", "_ratio", "_all", "_before", "_from", "_level")


def sized(docs: DataFrame, keep: list[str], id_col: str = "doc_id", text_col: str = "text",
          source_col: str = "source") -> DataFrame:
    """``keep`` and the columns that the mix works with: _size, _hash, _bucket, and _source with _null, neither of
    them null, so that a join and a window on them share one shuffle."""
    h = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return docs.select(*keep, F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("_size"),
                       h.alias("_hash"), F.substring(h, 1, 3).alias("_bucket"),
                       F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("_source"),
                       F.col(source_col).isNull().alias("_null"), F.col(id_col).alias("_id"))


def mix(base: DataFrame, weights=(3, 1, 2), budget: float = 1.5, max_epochs: int = 2, cut: bool = True) -> DataFrame:
    """Adds to the rows of ``sized``: _n and _target of the source, and _epochs, an array of (epoch,
    position, taken), one entry per time the document is taken.

    With ``cut`` the document in which a source's target is reached is taken up to it, so a source
    takes its target rounded down; without, a document is taken whole if its middle lies before the target.
    """
    scratch = Scratch(base.sparkSession, "mixing")
    own = ["_source", "_null"]
    parts = scratch.write(base.groupBy(*own, "_bucket").agg(F.sum("_size").alias("_n")), "parts")
    source = F.when(~F.col("_null"), F.col("_source"))
    targets = source_targets(parts.groupBy(*own).agg(F.sum("_n").alias("_n")).withColumn("source", source),
                             weights, budget, max_epochs).drop("source")
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*own).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))
    starts = scratch.write(parts.select(*own, "_bucket", before.alias("_start")).join(targets, own), "starts")
    rows = base.join(starts, [*own, "_bucket"])
    inside = Window.partitionBy(*own, "_bucket").orderBy("_hash", "_id", "_size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_at", F.col("_start") + F.coalesce(F.sum("_size").over(inside), F.lit(0)))

    def epoch(e: int) -> Column:
        at = F.col("_at") + F.col("_n") * e
        if cut:
            taken = F.greatest(F.lit(0), F.least(F.col("_size"), F.floor("_target") - at))
        else:
            first = F.lit(e == 0) | (F.col("_size") > 0)
            taken = F.when(first & (at + F.col("_size") / 2 <= F.col("_target")), F.col("_size"))
        x = F.when(F.col("_target") > 0, at / F.col("_target")).otherwise(0.0)
        position = F.element_at(F.array(*[_inverse(x, c) for c in CURVES[:len(weights)]]), F.col("_slot") + 1)
        return F.struct(F.lit(e).alias("epoch"), position.alias("position"), taken.cast("long").alias("taken"))

    taken = F.filter(F.array(*[epoch(e) for e in range(max_epochs)]), lambda x: x.taken > 0 if cut else x.taken.isNotNull())
    return rows.withColumn("_epochs", taken).drop("_start", "_at", "_slot")


def training_order(mixed: DataFrame) -> DataFrame:
    """One row per taken document and epoch, range-sorted by training position."""
    return (mixed.withColumn("_e", F.explode("_epochs")).withColumn("_position", F.col("_e.position"))
            .withColumn("_epoch", F.col("_e.epoch")).withColumn("_taken", F.col("_e.taken"))
            .drop("_e", "_epochs").orderBy("_position", "_hash", "_epoch"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` in training order: whole documents, each as often as the mix takes it."""
    names, docs = docs.columns, sheltered(docs, "doc_id", "text", "source")
    mixed = mix(sized(docs, [f"`{c}`" for c in docs.columns]), cut=False, **options)
    return training_order(mixed).select(*docs.columns).toDF(*names)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op3")
    base = scratch.write(sized(table(spark, sf_dir, "documents"), ["doc_id"]), "sized")
    return mix(base).select(
        "doc_id", F.col("_size").alias("size"), F.col("_n").alias("source_size"), F.col("_target").alias("target"),
        F.aggregate("_epochs", F.lit(0).cast("long"), lambda a, e: a + e.taken).alias("taken"),
        F.when(F.size("_epochs") > 0, F.col("_epochs")[0].position).alias("position"),
    ).orderBy(F.col("position").asc_nulls_last(), "doc_id")
