"""Ranked lexical search by bag deduplication.

For a set of items the documents are restricted to the items' vocabulary: a document becomes its bag
(term numbers and counts of vocabulary terms) and its length norm ``m``.  Nothing else of a document
enters a score, so documents of equal bag and ``m`` form a class: rows meet by XXH64 of both, and the
grouping compares the bytes behind the hash.  Each class is scored once; its size enters the document
frequencies.  The best classes of an item, equal scores by the class's smallest doc_id, are opened in
ascending doc_id.  A document among the best ``k`` lies in one of the best ``k`` classes of that order, because
every class before its own has a document before it; so the expansion drops nothing.

Items are taken in blocks of at most ``max_items`` items or ``max_postings`` term entries (a single item
of more is a block of its own); a block is what a task holds beside its batch, and the documents are read once a block.
Tasks keep the best ``k`` classes of each item, so what they pass on doesn't grow with the documents.

Terms are maximal matches of ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` (ASCII letters and digits, and
everything beyond ASCII), only A-Z lower-cased.

Results: null text has no terms, like the empty one; documents without a term of an item don't score
for it; an item without terms, or none of whose terms occur, has no rows; rows of equal item_id are one item with the
terms of all of them (null ids too); rows of equal doc_id are documents of their own, a null doc_id
comes after all others of its score; empty tables give an empty result; other columns aren't read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldframe.llm.common import Scratch, table

#: A-Z to a-z, other ASCII letters and digits and all bytes beyond ASCII kept, the rest blank.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_CELLS = 1 << 21    # (class, item) cells and postings that one step of scoring holds

BAGS = "doc_id long, n long, bag binary"
BEST = "item int, class long, first long, score long"


def terms(raw: bytes) -> list[bytes]:
    """Terms of a text in UTF-8."""
    return raw.translate(_FOLD).split()


def pack_bag(counts: dict[int, int]) -> bytes:
    """Term numbers in ascending order, then their counts, as 32-bit integers."""
    ids = sorted(counts)
    return np.array(ids + [counts[i] for i in ids], "<i4").tobytes()


def unpack_bags(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, count) of a binary column of bags."""
    parts = [np.frombuffer(b, "<i4").reshape(2, -1) for b in column.to_pylist()]
    if not parts:
        return (np.zeros(0, np.int64),) * 3
    row = np.repeat(np.arange(len(parts)), [p.shape[1] for p in parts])
    both = np.concatenate(parts, axis=1).astype(np.int64)
    return row, both[0], both[1]


def _item_blocks(items: DataFrame, max_items: int, max_postings: int) -> Iterator[list[tuple]]:
    """Lists of (item_id, distinct terms), read partition by partition."""
    rows = items.select(F.col("item_id").alias("i"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("t")
                        ).groupBy("i").agg(F.collect_list("t").alias("t"))
    block, held = [], 0
    for r in rows.toLocalIterator():
        found = sorted({t for raw in r["t"] for t in terms(bytes(raw))})
        if block and (len(block) >= max_items or held + len(found) > max_postings):
            yield block
            block, held = [], 0
        block.append((r["i"], found))
        held += len(found)
    if block:
        yield block


def _bags(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Number of terms and bag over the vocabulary of every document."""
    def run(batches):
        for b in batches:
            n, bags = [], []
            for raw in (x.as_py() for x in b.column("t")):
                found = terms(raw)
                counts = Counter(map(vocabulary.get, found))
                counts.pop(None, None)
                n.append(len(found))
                bags.append(pack_bag(counts))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(bags, pa.binary())],
                                             names=["doc_id", "n", "bag"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("t")).mapInArrow(run, BAGS)


def _document_frequencies(classes: DataFrame, n_terms: int) -> np.ndarray:
    """Documents that hold each vocabulary term: every task sums its classes' sizes."""
    def run(batches):
        df = np.zeros(n_terms, np.int64)
        for b in batches:
            row, term, _ = unpack_bags(b.column("bag"))
            np.add.at(df, term, b.column("size").to_numpy()[row])
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(df[at])], names=["term", "df"])
    df = np.zeros(n_terms, np.int64)
    for r in classes.select("bag", "size").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        df[r["term"]] = r["df"]
    return df


class _Best:
    """The best ``k`` classes of each item so far, by score, then smallest doc_id (null last)."""

    def __init__(self, k: int, n_items: int):
        self.k, self.floor = k, np.ones(n_items, np.int64)
        self.item, self.cls, self.first, self.void, self.score = (np.zeros(0, np.int64) for _ in range(5))

    def add(self, item, cls, first, void, score) -> None:
        item, cls, first, void, score = (np.concatenate(x) for x in (
            (self.item, item), (self.cls, cls), (self.first, first), (self.void, void), (self.score, score)))
        order = np.lexsort((cls, first, void, -score, item))
        it = item[order]
        start = np.searchsorted(it, it)
        place = np.arange(len(it)) - start
        keep = order[place < self.k]
        self.item, self.cls, self.first, self.void, self.score = item[keep], cls[keep], first[keep], void[keep], score[keep]
        full = order[place == self.k - 1]
        self.floor[item[full]] = score[full]


def _score_classes(classes: DataFrame, weights: np.ndarray, block: list[tuple], vocabulary: dict[bytes, int], k: int) -> DataFrame:
    """The best ``k`` classes of each item in every task."""
    n_items = len(block)
    pairs = sorted((vocabulary[t], i) for i, (_, found) in enumerate(block) for t in found)
    posting = np.array([i for _, i in pairs], np.int64)
    begin = np.searchsorted(np.array([t for t, _ in pairs], np.int64), np.arange(len(vocabulary) + 1))

    def run(batches):
        best = _Best(k, n_items)
        for b in batches:
            cls, m = b.column("class").to_numpy(), b.column("m").to_numpy()
            void = b.column("first").is_null().to_numpy(zero_copy_only=False).astype(np.int64)
            first = b.column("first").fill_null(0).to_numpy()
            row, term, tf = unpack_bags(b.column("bag"))
            share = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[row]))
            fan = begin[term + 1] - begin[term]
            ends = np.searchsorted(row, np.arange(len(cls) + 1))          # entries of each class
            cost = np.maximum(np.add.reduceat(np.append(fan, 0), ends[:-1]) * (ends[1:] > ends[:-1]), n_items)
            step = (np.cumsum(cost) - cost) // _CELLS
            for s in np.unique(step):
                rows = np.flatnonzero(step == s)
                lo, hi = ends[rows[0]], ends[rows[-1] + 1]
                f = fan[lo:hi]
                at = np.repeat(np.arange(lo, hi), f)
                nth = np.arange(len(at)) - np.repeat(np.cumsum(f) - f, f)
                cell = (row[at] - rows[0]) * n_items + posting[begin[term[at]] + nth]
                score = np.zeros(len(rows) * n_items, np.int64)
                np.add.at(score, cell, share[at])
                score = score.reshape(len(rows), n_items)
                r, i = np.nonzero(score >= best.floor)
                c = rows[r]
                best.add(i, cls[c], first[c], void[c], score[r, i])
        yield pa.RecordBatch.from_arrays(
            [pa.array(best.item.astype(np.int32)), pa.array(best.cls),
             pa.array(best.first, mask=best.void.astype(bool)), pa.array(best.score)], names=["item", "class", "first", "score"])
    return classes.select("class", "m", "first", "bag").mapInArrow(run, BEST)


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10, max_items: int = 4096,
                   max_postings: int = 200_000) -> DataFrame:
    """(item_id, rank, doc_id, score, class_size): the ``k`` best documents of each item with score above 0."""
    spark = docs.sparkSession
    s = Scratch(spark, "lexical")
    out = None
    for block in _item_blocks(items, max_items, max_postings):
        part = _rank_block(docs, block, items.schema["item_id"].dataType, k, s)
        if part is not None:
            out = part if out is None else out.unionByName(part)
    if out is not None:
        return out
    return items.limit(0).select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"),
                                 F.lit(0).cast("long").alias("score"), F.lit(0).cast("long").alias("class_size"))


def _rank_block(docs: DataFrame, block: list[tuple], id_type, k: int, s: Scratch) -> DataFrame | None:
    spark = docs.sparkSession
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, found in block for t in found}))}
    bags = s.write(_bags(docs, vocabulary), "bags")
    total = bags.agg(F.count(F.when(F.col("n") > 0, 1)).alias("n"), F.sum("n").alias("l")).first()
    if not total["n"] or not vocabulary:
        return None
    n_docs, n_terms = total["n"], total["l"]
    # the product is a decimal, so that it can't overflow before it is divided
    m = F.expr(f"10 + (CAST(90 * n AS DECIMAL(20, 0)) * CAST({n_docs} AS DECIMAL(18, 0))) div CAST({n_terms} AS DECIMAL(18, 0))")
    keyed = bags.where(F.length("bag") > 0).withColumn("m", m).withColumn("h", F.xxhash64("bag", "m"))
    classes = s.write(keyed.groupBy("h", "m", "bag").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("size"))
                      .withColumn("class", F.monotonically_increasing_id()), "classes")
    df = _document_frequencies(classes, len(vocabulary))
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    scored = _score_classes(classes, weights, block, vocabulary, k)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("first"), "class")
    best = s.write(scored.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k)
                   .select("item", "class", "score"), "best")
    # at most k * max_items classes: their hashes thin the documents before the bytes are compared
    chosen = s.write(classes.join(F.broadcast(best.select("class").distinct()), "class")
                     .select("class", "h", "m", "bag", F.col("size").alias("class_size")), "chosen")
    member = Window.partitionBy("class").orderBy(F.asc_nulls_last("doc_id"))
    opened = (keyed.join(F.broadcast(chosen.select("h").distinct()), "h", "left_semi").join(chosen, ["h", "m", "bag"])
              .select("class", "doc_id", "class_size").withColumn("nth", F.row_number().over(member)).where(F.col("nth") <= k))
    final = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "class")
    ranked = (opened.join(F.broadcast(best), "class").withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k))
    names = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(block)],
                                  f"item int, item_id {id_type.simpleString()}")
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score", "class_size")


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best of all documents for each benchmark item."""
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        "item_id", "rank", "doc_id", "score")
