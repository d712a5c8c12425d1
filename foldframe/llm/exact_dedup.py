"""Exact duplicates by an exchange of Golomb-coded fingerprints.

Texts are equal if they are identical once every character of ``[\\x20\\x09-\\x0D]`` is deleted.

1. Every task fingerprints its texts (the top ``bits`` bits of XXH64), sorts its rows by fingerprint inside the
   partition, numbers the distinct fingerprints and writes the rows; no text is shuffled.
2. Each partition sends its distinct fingerprints, sorted, cut by owner (equal ranges of fingerprints) and
   Golomb-coded with a power of two as divisor, with one bit each that tells whether it repeats inside the partition.
   A group of copies is one entry per partition, however many rows it has.
3. An owner merges what it got and answers with one bit per entry: set if the fingerprint occurs more than once.
   Answers travel as 64-bit words; words without a set bit are not sent.
4. Partitions pick out the suspects: the words of some partitions, at most ``block_words`` of them, are broadcast and joined
   with those partitions' rows; further partitions take further passes.  Rows without the bit are alone: done.
5. Only suspects' texts are shuffled, one per task and distinct text (map-side combine); grouping compares all
   bytes.  Different texts of one 64-bit hash (rare) get numbers of their own, so groups are exact.

Results: null counts as empty; all texts without other characters are equal; of equal texts the row of most
code points, then smallest doc_id (null last) stays, of rows equal in these any one; repeated ids are rows of their own;
an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldframe.llm.common import Scratch, table

_SPACES = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
_SEND = 1 << 20         # fingerprints a sender holds at a time

PRINTS = "doc_id long, chars long, sha binary, h long, fp long, norm binary"
ROWS = f"{PRINTS}, part int, place long"
MESSAGES = "owner long, part int, first long, n long, shift int, base long, unary binary, rest binary, again binary"
WORDS = "part int, word long, bits long"


# ------------------------------------------------------------------ Golomb code
def golomb_encode(sorted_values: np.ndarray, base: int, shift: int) -> tuple[bytes, bytes]:
    """Gaps of ascending integers from ``base`` on: quotients by 2**shift in unary, remainders in ``shift`` bits."""
    gaps = np.diff(sorted_values, prepend=base).astype(np.int64)
    ends = np.cumsum((gaps >> shift) + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1 if len(ends) else 0, np.uint8)
    unary[ends] = 1
    rest = ((gaps[:, None] >> np.arange(shift)) & 1).astype(np.uint8)
    return np.packbits(unary).tobytes(), np.packbits(rest).tobytes()


def golomb_decode(unary: bytes, rest: bytes, n: int, base: int, shift: int) -> np.ndarray:
    if n == 0:
        return np.zeros(0, np.int64)
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)))[:n]
    high = np.diff(ends, prepend=-1) - 1
    bits = np.unpackbits(np.frombuffer(rest, np.uint8))[: n * shift].reshape(n, shift).astype(np.int64)
    return base + np.cumsum((high.astype(np.int64) << shift) + (bits << np.arange(shift)).sum(axis=1))


def golomb_shift(n: int, width: int) -> int:
    """Divisor 2**shift near ln 2 times the mean gap of ``n`` values over ``width``."""
    return max(0, round(math.log2(max(1.0, math.log(2) * width / max(1, n)))))


def hash_text(norm: bytes) -> int:
    return xxhash.xxh64_intdigest(norm)


# ------------------------------------------------------------------ steps 1, 2
def _prints(docs: DataFrame, bits: int, hasher) -> DataFrame:
    def run(batches):
        for b in batches:
            norm = [raw.translate(None, _SPACES) for raw in (x.as_py() for x in b.column("t"))]
            h = np.array([hasher(x) for x in norm], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("chars"), pa.array([hashlib.sha256(x).digest() for x in norm], pa.binary()),
                 pa.array(h.view(np.int64)), pa.array((h >> np.uint64(64 - bits)).astype(np.int64)), pa.array(norm, pa.binary())],
                names=["doc_id", "chars", "sha", "h", "fp", "norm"])
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.length(text).cast("long").alias("chars"),
                       text.cast("binary").alias("t")).mapInArrow(run, PRINTS)


def _numbered(prints: DataFrame) -> DataFrame:
    """Rows sorted by fingerprint inside their partition, with the place of the fingerprint among its distinct ones."""
    def run(batches):
        part, place, last = TaskContext.get().partitionId(), -1, -1
        for b in batches:
            fp = b.column("fp").to_numpy()
            if not len(fp):
                continue
            new = np.diff(fp, prepend=last) != 0
            at = place + np.cumsum(new)
            place, last = int(at[-1]), int(fp[-1])
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(np.full(len(fp), part, np.int32)), pa.array(at.astype(np.int64))],
                names=[*b.schema.names, "part", "place"])
    return prints.sortWithinPartitions("fp").mapInArrow(run, ROWS)


def _messages(rows: DataFrame, bits: int, owners: int) -> DataFrame:
    width = -(-(1 << bits) // owners)

    def letters(part: int, place: np.ndarray, fp: np.ndarray):
        """One message per owner from rows of one partition in ascending places."""
        new = np.flatnonzero(np.diff(place, prepend=place[0] - 1))
        again = np.diff(np.append(new, len(place))) > 1
        fp, first = fp[new], int(place[0])
        who = fp // width
        for lo, hi in zip(*(x.tolist() for x in _runs(who))):
            o = int(who[lo])
            shift = golomb_shift(hi - lo, width)
            unary, rest = golomb_encode(fp[lo:hi], o * width, shift)
            yield (o, part, first + lo, hi - lo, shift, o * width, unary, rest, np.packbits(again[lo:hi]).tobytes())

    def run(batches):
        held, size, current = [], 0, None

        def flush():
            if not held:
                return None
            place, fp = (np.concatenate(x) for x in zip(*held))
            held.clear()
            out = list(zip(*letters(current, place, fp)))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, _MESSAGE_TYPES)], names=_MESSAGE_NAMES)

        for b in batches:
            part, place, fp = (b.column(c).to_numpy() for c in ("part", "place", "fp"))
            # a file holds one partition in order; a task may read several files, or slices of one
            for lo, hi in zip(*_runs(part, place)):
                joins = current == part[lo] and held and held[-1][0][-1] <= place[lo] <= held[-1][0][-1] + 1
                if not joins or size >= _SEND:
                    done = flush()
                    if done is not None:
                        yield done
                    size, current = 0, int(part[lo])
                held.append((place[lo:hi], fp[lo:hi]))
                size += hi - lo
        done = flush()
        if done is not None:
            yield done
    return rows.select("part", "place", "fp").mapInArrow(run, MESSAGES)


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of stretches of one first key in which the second (if given) grows by 0 or 1."""
    n = len(keys[0])
    cut = np.diff(keys[0]) != 0
    if len(keys) > 1:
        step = np.diff(keys[1])
        cut |= (step < 0) | (step > 1)
    starts = np.concatenate([[0], np.flatnonzero(cut) + 1]) if n else np.zeros(0, np.int64)
    return starts, np.append(starts[1:], n) if n else starts


_MESSAGE_NAMES = [c.split()[0] for c in MESSAGES.split(", ")]
_MESSAGE_TYPES = [{"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[c.split()[1]] for c in MESSAGES.split(", ")]


# ------------------------------------------------------------------ step 3
def answer(messages: pa.Table) -> pa.Table:
    """An owner's answers: words of 64 bits by (partition, place // 64), set where a fingerprint repeats."""
    fps, where, parts, again = [], [], [], []
    for r in messages.to_pylist():
        fps.append(golomb_decode(r["unary"], r["rest"], r["n"], r["base"], r["shift"]))
        where.append(r["first"] + np.arange(r["n"]))
        parts.append(np.full(r["n"], r["part"], np.int64))
        again.append(np.unpackbits(np.frombuffer(r["again"], np.uint8))[: r["n"]])
    fp, place, part, more = (np.concatenate(x) for x in (fps, where, parts, again))
    order = np.argsort(fp, kind="stable")
    same = np.diff(fp[order]) == 0
    hit = np.zeros(len(fp), bool)
    hit[order] = np.append(same, False) | np.insert(same, 0, False)
    hit |= more.astype(bool)
    place, part = place[hit], part[hit]
    order = np.lexsort((place, part))
    place, part = place[order], part[order]
    word = place >> 6
    starts = np.flatnonzero((np.diff(part, prepend=-1) != 0) | (np.diff(word, prepend=-1) != 0))
    bits = np.bitwise_or.reduceat(np.uint64(1) << (place & 63).astype(np.uint64), starts) if len(starts) else np.zeros(0, np.uint64)
    return pa.table({"part": pa.array(part[starts], pa.int32()), "word": pa.array(word[starts], pa.int64()),
                     "bits": pa.array(bits.view(np.int64))})


# ------------------------------------------------------------------ steps 4, 5
def _blocks(words: DataFrame, block_words: int) -> list[tuple[int, int]]:
    """Ranges of partitions with at most ``block_words`` words each (one count per partition reaches the driver)."""
    counts = sorted((r["part"], r["count"]) for r in words.groupBy("part").count().collect())
    blocks, held, lo = [], 0, 0
    for part, n in counts:
        if held and held + n > block_words:
            blocks.append((lo, part))
            held, lo = 0, part
        held += n
    return [*blocks, (lo, 1 << 31)]


def _flagged(rows: DataFrame, words: DataFrame, block_words: int) -> DataFrame:
    """``rows`` with ``suspect``: the answered bit of their fingerprint."""
    out = None
    for lo, hi in _blocks(words, block_words):
        here = F.col("part").between(lo, hi - 1)
        flags = F.broadcast(words.where(here))          # at most block_words rows of 20 bytes
        part = (rows.where(here).withColumn("word", F.shiftright("place", 6)).join(flags, ["part", "word"], "left")
                .withColumn("suspect", F.expr("coalesce(shiftrightunsigned(bits, CAST(place & 63 AS INT)) & 1, 0) = 1"))
                .drop("word", "bits"))
        out = part if out is None else out.unionByName(part)
    return out


def duplicate_groups(docs: DataFrame, bits: int | None = None, owners: int | None = None, block_words: int = 1 << 20,
                     hasher=hash_text) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row.

    ``bits``: width of a fingerprint, by default ten bits more than a number of all rows needs, so that about one row
    in a thousand is suspected wrongly; ``owners``: ranges of fingerprints, by default as many as shuffle partitions, or more
    where an owner would get over two million rows.
    """
    spark = docs.sparkSession
    s = Scratch(spark, "exact")
    n = docs.count()
    bits = bits or min(62, n.bit_length() + 10)
    owners = owners or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // (1 << 21)))
    rows = s.write(_numbered(_prints(docs, bits, hasher)).withColumn("row", F.monotonically_increasing_id()), "rows")
    words = s.write(_messages(rows, bits, owners).groupBy("owner").applyInArrow(answer, WORDS)
                    .groupBy("part", "word").agg(F.bit_or("bits").alias("bits")), "words")
    flagged = _flagged(rows, words, block_words)
    suspects = flagged.where("suspect")
    # one text per task and distinct text; hashes that stand for several texts
    texts = suspects.groupBy("h", "norm").agg(F.count(F.lit(1)).alias("rows"))
    several = s.write(texts.groupBy("h").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("h"), "several")
    thin = ["doc_id", "chars", "sha", "h", "row"]
    if several.isEmpty():
        members = suspects.select(*thin, F.lit(0).cast("long").alias("nth"))
    else:
        # each text of such a hash is known by its smallest row number
        known = s.write(suspects.join(several, "h", "left_semi").groupBy("h", "norm").agg(F.min("row").alias("nth")), "known")
        members = suspects.join(known, ["h", "norm"], "left").select(*thin, F.coalesce("nth", F.lit(0).cast("long")).alias("nth"))
    at = F.struct(F.col("doc_id").isNull().alias("void"), F.col("doc_id").alias("id"), F.col("row").alias("row"))
    first = members.groupBy("h", "nth", "chars").agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("size"))
    groups = s.write(first.groupBy("h", "nth").agg(F.max_by("first", "chars").alias("first"), F.sum("size").alias("group_size"))
                     .where("group_size > 1").select("h", "nth", F.col("first.id").alias("keep_id"), F.col("first.row").alias("keep_row"),
                                                     "group_size", F.lit(True).alias("grouped")), "groups")
    digest = F.lower(F.hex("sha")).alias("text_sha256")
    alone = flagged.where("NOT suspect").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
                                                F.lit(True).alias("kept"), digest)
    grouped = F.col("grouped").isNotNull()
    met = members.join(groups, ["h", "nth"], "left").select(
        "doc_id", F.when(grouped, F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("row") == F.col("keep_row"), F.lit(True)).alias("kept"), digest)
    return alone.unionByName(met)


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of equal texts over all documents."""
    return duplicate_groups(table(spark, sf_dir, "documents"))
