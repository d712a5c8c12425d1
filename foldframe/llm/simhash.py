"""SimHash near-duplicates by multi-index hashing.

A fingerprint has 64 bits; a bit is set if it is set in more than half of the XXH64 hashes (seed 42)
of the document's word shingles, repeats included.  Fingerprints within ``max_bits`` link.

Multi-index hashing: the 64 bits are cut into ``segments`` parts.  With ``max_bits = q * segments + a``
two linked fingerprints differ by at most ``q`` bits in one of the first ``a + 1`` parts or by at most
``q - 1`` in one of the others, so each part has a table, each fingerprint probes it with every value
of that small Hamming ball around its own part, and complete distances are verified.  Copies share a
fingerprint and enter the tables once.  A table entry that holds more than ``max_entry`` distinct
fingerprints (a large group of near copies) would make a quadratic number of candidates; its members
are cut again: their rest bits get balls of their own (``_centres``), which is exact for any
entry size.

Results: null text counts as empty; no words give fingerprint zero, linked like any other; repeated
ids keep one row per input row; a null id never becomes a component id unless the whole component
has none; an empty table gives an empty result; other columns of the input are not touched.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldframe.llm.common import Scratch, sheltered, table
from foldframe.llm.components import connected_components

_CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """SimHash of one text as a signed 64-bit integer; hashes are counted in chunks of bounded size."""
    words = [] if text is None else text.encode().lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        part = words[at:min(n, at + _CHUNK) + shingle - 1]
        grams = zip(*(part[i:] for i in range(shingle))) if len(part) >= shingle else [part]
        hashes = b"".join([xxhash.xxh64_digest(g, 42) for g in map(b" ".join, grams)])
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n).view(">i8")[0])


def fingerprints(text_col, shingle: int = 3):
    """Column of fingerprints (long) of a text column."""
    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")
    return run(text_col)


def _ball(width: int, radius: int) -> list[int]:
    """XOR masks of at most ``radius`` set bits."""
    return [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def link_fingerprints(distinct: DataFrame, max_bits: int, segments: int, max_entry: int,
                      scratch: Scratch) -> DataFrame:
    """Edges (u, v) over distinct 64-bit fingerprints (column ``fp``) that connect exactly what the
    links of at most ``max_bits`` differing bits connect."""
    if max_bits % 2:
        raise ValueError("max_bits must be even: entries of near copies are cut by balls of half of it")
    width, q, a = 64 // segments, max_bits // segments, max_bits % segments
    radii = [q if s <= a else q - 1 for s in range(segments)]
    part = [F.shiftrightunsigned("fp", width * s).bitwiseAND(F.lit((1 << width) - 1)) for s in range(segments)]
    entries = distinct.select("fp", F.explode(F.array(*[
        F.struct(F.lit(s).alias("seg"), part[s].alias("key")) for s in range(segments) if radii[s] >= 0])).alias("e")
    ).select("fp", "e.seg", "e.key")
    probes = distinct.select("fp", F.explode(F.array(*[
        F.struct(F.lit(s).alias("seg"), part[s].bitwiseXOR(F.lit(m).cast("long")).alias("key"))
        for s in range(segments) if radii[s] >= 0 for m in _ball(width, radii[s])])).alias("e")
    ).select("fp", "e.seg", "e.key")
    hot = scratch.write(entries.groupBy("seg", "key").count().where(F.col("count") > max_entry)
                        .select("seg", "key"), "hot")
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= max_bits
    # an entry that is hot is left to the centres below, with all that probe it
    cold = entries.join(hot, ["seg", "key"], "left_anti")
    pairs = (probes.withColumnRenamed("fp", "u").join(cold.withColumnRenamed("fp", "v"), ["seg", "key"])
             .where((F.col("u") > F.col("v")) & near).select("u", "v"))
    if hot.isEmpty():
        return pairs
    return pairs.unionByName(_centres(probes.join(hot, ["seg", "key"], "left_semi").select("fp").distinct(),
                                      max_bits // 2))


def _centres(members: DataFrame, radius: int) -> DataFrame:
    """Two fingerprints differ by at most ``2 * radius`` bits exactly if their balls of ``radius`` share a
    centre, and all members of a centre are that near to each other: each links to the smallest."""
    at = members.select("fp", F.explode(F.array(*[
        F.col("fp").bitwiseXOR(F.lit(_signed(m))) for m in _ball(64, radius)])).alias("centre"))
    least = at.groupBy("centre").agg(F.min("fp").alias("v"), F.count("*").alias("n")).where("n > 1")
    return at.join(least, "centre").where("fp <> v").select(F.col("fp").alias("u"), "v").distinct()


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                   max_bits: int = 2, segments: int = 2, max_entry: int = 1000, keep: dict[str, Column] | None = None) -> DataFrame:
    """One row per input row: ``id_col``, fp (long), root (a fingerprint that names the component),
    component_id (smallest id reachable by links) and the columns of ``keep``."""
    scratch = Scratch(docs.sparkSession, "simhash")
    keep = keep or {}
    fps = scratch.write(docs.select(F.col(id_col).alias("id"), fingerprints(F.col(text_col), shingle).alias("fp"),
                                    *(c.alias(k) for k, c in keep.items())), "fp")
    distinct = scratch.write(fps.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    comp = connected_components(link_fingerprints(distinct, max_bits, segments, max_entry, scratch), scratch)
    linked = distinct.join(comp, F.col("fp") == F.col("node"))
    least = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    of_fp = scratch.write(
        distinct.join(linked.join(least, "component").select("fp", "component", "component_id"), "fp", "left")
        .select("fp", F.coalesce("component", "fp").alias("root"), F.coalesce("component_id", "least").alias("component_id")), "of-fp")
    return fps.join(of_fp, "fp").select(F.col("id").alias(id_col), "fp", "root", "component_id", *keep)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each group, that of the smallest id (null ids after all others)."""
    key = F.sha2(F.concat_ws("\u0001", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), text_col), 256)
    names, docs = docs.columns, sheltered(docs, id_col, text_col)
    groups = simhash_groups(docs, id_col, text_col, keep={"_key": key}, **options)
    first = groups.groupBy("root").agg(F.min(F.struct(F.col(id_col).isNull(), id_col, "_key"))["_key"].alias("_key"))
    # repeated rows share a key; the rank within it needs no shuffle beyond the join's
    again = Window.partitionBy("_key").orderBy("_key")
    return (docs.withColumn("_key", key).join(first.select("_key").distinct(), "_key", "left_semi")
            .withColumn("_nth", F.row_number().over(again)).where("_nth = 1").select(*docs.columns).toDF(*names))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = simhash_groups(table(spark, sf_dir, "documents"))
    return g.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
