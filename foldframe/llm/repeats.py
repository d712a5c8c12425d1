"""Removal of byte passages that repeat anywhere in the corpus, by prefix-free parsing.

Every byte covered by a ``window``-byte string that starts anywhere else too is removed.

1. Texts that occur again as a whole are known by their SHA-256; of each distinct text one copy goes on.
2. All texts are cut into phrases at rolling-hash triggers (``prefix_free``).  The dictionary is counted over
   the corpus: a phrase found in one place only cannot lie in a repeated window.  The phrase hashes
   go to their bucket packed, after each task has put together what it holds, so a phrase that a
   third of all texts share is two entries a batch; pairs known to repeat don't go through the bucket.
3. What is left of a text, runs of windows without such a phrase, is cut where the smallest trigger hash of the window
   changes.  Equal windows have equal smallest hashes, so they meet in one group; equal runs
   are merged first.  A group beyond ``hot_bytes`` is cut again by three further hashes of each window, and equal
   pieces are merged.  Of groups still beyond it, such as the edges of a passage that many texts hold, every window
   is counted by its 128-bit hash, so that no task holds such a group.
4. The other groups are streamed in order; for about ``chunk`` bytes of them at a time the suffix arrays of dictionary and parse
   give the corpus order, in which equal windows are neighbours (``repeated_windows``).
5. The windows found go back to their texts, which lose the bytes they cover.

Other hashes only direct the work: windows are compared byte by byte, and a collision of phrase hashes costs time only.

Results: null text is empty; texts shorter than the window lose nothing, also if repeated; repeated rows
and ids are documents of their own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldframe.llm.common import Scratch, table
from foldframe.llm.prefix_free import GRAM, grams, mix, repeated_windows, sliding_min, triggers_of_many

_SALTS = (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0)


def _key(text: bytes) -> int:
    """First 8 bytes of the SHA-256, signed."""
    return int.from_bytes(hashlib.sha256(text).digest()[:8], "big", signed=True)


def _sql_key(sha: str):
    return F.conv(F.substring(sha, 1, 16), 16, -10).cast("long")


def _phrase_hashes(text: bytes, cuts: np.ndarray) -> np.ndarray:
    """Hashes of the complete phrases, from trigger to the end of the next trigger's window."""
    at = cuts.tolist()
    return np.frombuffer(b"".join([xxhash.xxh3_64_digest(text[a:b + GRAM]) for a, b in zip(at, at[1:])]), ">i8").astype(np.int64)


def _split(order_by: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    own = (order_by.view(np.uint64) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(own, kind="stable")
    return order, np.searchsorted(own[order], np.arange(buckets + 1))


def _several_texts(h: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Which of the pairs, sorted by (h, k), have a hash that occurs with another text as well."""
    new = np.append(True, h[1:] != h[:-1])
    group = np.cumsum(new) - 1
    ends = np.flatnonzero(np.append(new[1:], True))
    return (k[np.flatnonzero(new)] != k[ends])[group]


def _sorted_pairs(h: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((k, h))
    h, k = h[order], k[order]
    new = np.append(True, (h[1:] != h[:-1]) | (k[1:] != k[:-1])) if len(h) else np.empty(0, bool)
    return h[new], k[new]


def repeated_phrases(texts: DataFrame, buckets: int, scratch: Scratch) -> DataFrame:
    """(k, h): phrases of the texts (column t) that occur in another text or again in their own; pairs may come again."""
    names = ["bucket", "h", "k"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = [t.encode() for t in batch.column(0).to_pylist() if t]
            hs, ks, again = [], [], []
            for doc, cuts in zip(docs, triggers_of_many(docs)):
                h, n = np.unique(_phrase_hashes(doc, cuts), return_counts=True)
                hs.append(h)
                ks.append(np.full(len(h), _key(doc)))
                again.append(h[n > 1])
            if not hs:
                continue
            twice_k = np.repeat([k[0] if len(k) else 0 for k in ks], [len(a) for a in again])
            twice_h = np.concatenate(again)
            h, k = _sorted_pairs(np.concatenate(hs), np.concatenate(ks))
            several = _several_texts(h, k) if len(h) else np.empty(0, bool)
            # of a phrase that several texts of this batch share, the first and the last are enough for the others
            new = np.append(True, h[1:] != h[:-1]) if len(h) else several
            send = ~several | new | (np.append(new[1:], True) if len(h) else several)
            known_h, known_k = np.concatenate([h[several], twice_h]), np.concatenate([k[several], twice_k])
            order, cut = _split(h[send], buckets)
            sh, sk = h[send][order], k[send][order]
            use = [b for b in range(buckets) if cut[b] < cut[b + 1]]
            part = lambda a: [a[cut[b]:cut[b + 1]].tobytes() for b in use]
            # known pairs have no bucket
            yield pa.RecordBatch.from_arrays([pa.array([*use, None], pa.int32()), pa.array([*part(sh), known_h.tobytes()], pa.binary()),
                                              pa.array([*part(sk), known_k.tobytes()], pa.binary())], names=names)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(rows: list) -> pa.RecordBatch:
            h, k = _sorted_pairs(*(np.frombuffer(b"".join(r[i] for r in rows), np.int64) for i in range(2)))
            several = _several_texts(h, k) if len(h) else np.empty(0, bool)
            return pa.RecordBatch.from_arrays([pa.array(k[several]), pa.array(h[several])], names=["k", "h"])

        last, rows = None, []
        for batch in batches:
            for bucket, *r in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != last and rows:
                    yield found(rows)
                    rows = []
                last = bucket
                rows.append(r)
        if rows:
            yield found(rows)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x, np.int64)) for x in (k, h)], names=["k", "h"])

    packed = scratch.write(texts.mapInArrow(scan, "bucket int, h binary, k binary"), "packed")
    known = packed.where("bucket is null").select("h", "k").mapInArrow(unpack, "k long, h long")
    return packed.where("bucket is not null").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(
        match, "k long, h long").unionByName(known)


def _runs(text: bytes, first: int, end: int, window: int, salts=(), block: int = 1 << 20) -> Iterator[tuple[int, int, int, bool]]:
    """(key, first, end, again): the windows that start in [first, end), cut where the smallest hash changes;
    ``again`` if the run holds the smallest hash twice, without which it can't repeat a window itself.

    The trigger level doesn't matter here: the smallest hash is a trigger's wherever the window has one."""
    width = window - GRAM + 1
    for lo in range(first, end, block):
        hi = min(end, lo + block)
        x = grams(text[lo:hi + window - 1])[:hi - lo + width - 1]
        hashes = mix(x)
        least = sliding_min(hashes, width)
        change = least[1:] != least[:-1]
        key = least
        for salt in salts:
            own = sliding_min(mix(x, salt), width)
            change |= own[1:] != own[:-1]
            key = mix(key ^ own)
        at = np.flatnonzero(np.append(True, change))
        ends = np.append(at[1:], hi - lo)
        again = np.array([np.count_nonzero(hashes[a:b + width - 1] == least[a]) > 1 for a, b in zip(at.tolist(), ends.tolist())])
        yield from zip(key[at].view(np.int64).tolist(), (lo + at).tolist(), (lo + ends).tolist(), again.tolist())


def _candidates(n: int, cuts: np.ndarray, unique: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Ranges of window starts whose window holds no unique phrase."""
    if n < window:
        return []
    mark = np.zeros(n - window + 2, np.int32)
    a, b = cuts[:-1][unique], cuts[1:][unique] + GRAM
    lo, hi = np.maximum(b - window, 0), np.minimum(a + 1, n - window + 1)
    fits = lo < hi
    np.add.at(mark, lo[fits], 1)
    np.add.at(mark, hi[fits], -1)
    free = np.concatenate([[0], (np.cumsum(mark[:-1]) == 0).astype(np.int8), [0]])
    d = np.diff(free)
    return list(zip(np.flatnonzero(d == 1).tolist(), np.flatnonzero(d == -1).tolist()))


_RUN = "key long, sid binary, k long, start long, s binary, again boolean"


def _run_batch(rows: list) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["key", "sid", "k", "start", "s", "again"])


def candidate_runs(texts: DataFrame, window: int) -> DataFrame:
    """Runs of windows of the texts (k, t, hs: its repeated phrases)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = [(t or "").encode() for t in batch.column(1).to_pylist()]
            rows, size = [], 0
            for k, doc, hs, cuts in zip(batch.column(0).to_pylist(), docs, batch.column(2), triggers_of_many(docs)):
                known = np.asarray(hs.values) if hs.is_valid else np.empty(0, np.int64)
                unique = ~np.isin(_phrase_hashes(doc, cuts), known)
                for first, end in _candidates(len(doc), cuts, unique, window):
                    for key, a, b, again in _runs(doc, first, end, window):
                        s = doc[a:b + window - 1]
                        rows.append((key, xxhash.xxh3_128_digest(s), k, a, s, again))
                        size += len(s)
                if size > 1 << 23:
                    yield _run_batch(rows)
                    rows, size = [], 0
            if rows:
                yield _run_batch(rows)

    return texts.select("k", "t", "hs").mapInArrow(run, _RUN)


def _cut_hot(runs: DataFrame, window: int) -> DataFrame:
    """(sid, s) -> pieces (key, pid, sid, start, s, again) of the same windows under keys of four hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sid, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = []
                for key, a, b, again in _runs(s, 0, len(s) - window + 1, window, _SALTS):
                    piece = s[a:b + window - 1]
                    rows.append((key, xxhash.xxh3_128_digest(piece), sid, a, piece, again))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.bool_()]
    names = ["key", "pid", "sid", "start", "s", "again"]
    return runs.select("sid", "s").mapInArrow(run, "key long, pid binary, sid binary, start long, s binary, again boolean")


def _repeats_by_count(runs: DataFrame, window: int, scratch: Scratch) -> DataFrame:
    """(sid, a, b): ranges of window starts of the distinct runs (sid, s, n copies) whose window occurs again, by counting
    128-bit hashes.  The windows of runs of several copies only count: all of them repeat, which the caller knows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sid, s, n in zip(*(c.to_pylist() for c in batch.columns)):
                for lo in range(0, len(s) - window + 1, 1 << 16):
                    at = range(lo, min(len(s) - window + 1, lo + (1 << 16)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([xxhash.xxh3_128_digest(s[i:i + window]) for i in at], pa.binary()),
                         pa.array([sid if n == 1 else None] * len(at), pa.binary()), pa.array(at, pa.int64())], names=["w", "sid", "a"])

    windows = scratch.write(runs.select("sid", "s", "n").mapInArrow(run, "w binary, sid binary, a long"), "windows")
    again = windows.groupBy("w").agg(F.count("*").alias("n"), F.count("sid").alias("own")).where("n > 1 and own > 0").select("w")
    # written right after the join, so that Spark may split the rows of a frequent window
    counted = scratch.write(windows.where("sid is not null").join(again, "w").select("sid", "a"), "counted")
    scratch.drop(windows)

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Neighbouring starts as one range."""
        for batch in batches:
            sid, a = batch.column(0), batch.column(1).to_numpy()
            if not len(a):
                continue
            own = np.asarray(pa.compute.rank(sid, tiebreaker="dense"))
            new = np.append(True, (np.diff(own) != 0) | (np.diff(a) != 1))
            at = np.flatnonzero(new)
            yield pa.RecordBatch.from_arrays([sid.take(pa.array(at)), pa.array(a[at]), pa.array(a[np.append(at[1:], len(a)) - 1] + 1)],
                                             names=["sid", "a", "b"])

    return counted.repartition("sid").sortWithinPartitions("sid", "a").mapInArrow(ranges, "sid binary, a long, b long")


def _hot_repeats(runs: DataFrame, window: int, chunk: int, hot_bytes: int, scratch: Scratch) -> DataFrame:
    """(sid, a, b) of the runs (sid, s) of groups beyond ``hot_bytes``."""
    cut = scratch.write(_cut_hot(runs, window), "cut_hot")
    pieces = scratch.write(cut.groupBy("key", "pid", "s").agg(F.count("*").alias("n"), F.max("again").alias("again")), "pieces")
    groups = pieces.groupBy("key").agg(F.count("*").alias("m"), F.sum(F.octet_length("s")).alias("size"),
                                       F.max("again").alias("any_again")).where("m > 1 or any_again")
    own = scratch.write(pieces.join(groups, "key").select("key", F.col("pid").alias("sid"), "s", "size", "n"), "hot_groups")
    cold = own.where(F.col("size") <= hot_bytes).select("key", "sid", F.lit(0).cast("long").alias("start"), "s")
    found = _repeats_in_groups(cold.repartition("key").sortWithinPartitions("key"), window, chunk)
    found = found.unionByName(_repeats_by_count(own.where(F.col("size") > hot_bytes), window, scratch))
    whole = pieces.where("n > 1").select(F.col("pid").alias("sid"), F.lit(0).cast("long").alias("a"),
                                         (F.octet_length("s") - window + 1).cast("long").alias("b"))
    found = found.unionByName(whole).withColumnRenamed("sid", "pid")
    return cut.select("pid", "sid", "start").join(found, "pid").select(
        "sid", (F.col("start") + F.col("a")).alias("a"), (F.col("start") + F.col("b")).alias("b"))


def _repeats_in_groups(runs: DataFrame, window: int, chunk: int) -> DataFrame:
    """(sid, a, b): ranges of window starts of the runs (key, sid, start, s) that occur again."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size, last = 0, None

        def found() -> Iterator[pa.RecordBatch]:
            texts = dict.fromkeys(r[2] for r in rows)
            got = dict(zip(texts, repeated_windows(list(texts), window)))
            seen: dict[bytes, int] = {}
            for r in rows:
                seen[r[2]] = seen.get(r[2], 0) + 1
            out: list[list] = [[], [], []]
            for sid, start, s in rows:
                ranges = [(0, len(s) - window + 1)] if seen[s] > 1 else got[s].tolist()
                for a, b in ranges:
                    out[0].append(sid)
                    out[1].append(start + a)
                    out[2].append(start + b)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())],
                                             names=["sid", "a", "b"])

        own: list[tuple] = []       # rows of the key that is being read
        own_size = 0
        for batch in batches:
            for key, sid, start, s in zip(*(c.to_pylist() for c in batch.columns)):
                if key != last:
                    if rows and size + own_size > chunk:        # a key, of at most hot_bytes, is never cut
                        yield from found()
                        rows.clear()
                        size = 0
                    rows += own
                    size += own_size
                    own, own_size, last = [], 0, key
                own.append((sid, start, s))
                own_size += len(s)
        if rows and size + own_size > chunk:
            yield from found()
            rows.clear()
        rows += own
        if rows:
            yield from found()

    return runs.mapInArrow(run, "sid binary, a long, b long")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 200, chunk: int = 1 << 19,
                   hot_bytes: int = 1 << 19, bucket_bytes: int = 256 << 20) -> DataFrame:
    """One row per document: ``id_col``, n_bytes, n_removed, n_spans, kept_sha256."""
    spark = docs.sparkSession
    scratch, phrases, hot_groups = Scratch(spark, "repeats"), Scratch(spark, "repeats-phrases"), Scratch(spark, "repeats-hot")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("t"), F.sha2(text, 256).alias("sha")).withColumn("k", _sql_key("sha"))
    info = scratch.write(rows.select("id", "k", "sha", F.octet_length("t").cast("long").alias("n_bytes")), "info")
    total = info.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // bucket_bytes))
    known = repeated_phrases(rows.select("t"), buckets, phrases).groupBy("k").agg(F.collect_set("h").alias("hs"))
    # one copy of each text; copies meet in the map tasks first
    texts = rows.where(F.octet_length("t") >= window).groupBy("k").agg(F.any_value("t").alias("t")).join(known, "k", "left")
    runs = scratch.write(candidate_runs(texts, window), "runs")
    phrases.clear()
    distinct = scratch.write(runs.groupBy("key", "sid", "s").agg(F.count("*").alias("n"), F.max("again").alias("again")), "distinct")
    hot = distinct.groupBy("key").agg(F.count("*").alias("m"), F.sum(F.octet_length("s")).alias("size"), F.max("again").alias("any_again")).where("m > 1 or any_again")
    groups = distinct.join(hot, "key")  # no other run has windows equal to those of the rest
    cold = groups.where(F.col("size") <= hot_bytes).select("key", "sid", F.lit(0).cast("long").alias("start"), "s")
    found = _repeats_in_groups(cold.repartition("key").sortWithinPartitions("key"), window, chunk)
    found = found.unionByName(_hot_repeats(groups.where(F.col("size") > hot_bytes), window, chunk, hot_bytes, hot_groups))
    twice = distinct.where("n > 1").select("sid", F.lit(0).cast("long").alias("a"), (F.octet_length("s") - window + 1).cast("long").alias("b"))
    found = scratch.write(found.unionByName(twice), "found")
    hot_groups.clear()
    scratch.drop(distinct)
    spans = runs.select("sid", "k", "start").join(found, "sid").groupBy("k").agg(F.collect_set(F.struct(
        (F.col("start") + F.col("a")).alias("a"), (F.col("start") + F.col("b")).alias("b"))).alias("spans"))
    classes = info.groupBy("k").agg(F.count("*").alias("c"))
    once = scratch.write(spans.join(classes, "k").where("c = 1").select("k", "spans"), "spans")
    scratch.drop(runs, found)

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, t, spans_ in zip(*(c.to_pylist() for c in batch.columns)):
                doc, kept, at, removed, n = t.encode(), hashlib.sha256(), 0, 0, 0
                end = -1
                for a, b in sorted((s["a"], s["b"] + window - 1) for s in spans_):
                    if a > end:
                        n += 1
                    if b > end:
                        a = max(a, end)
                        kept.update(doc[at:a])
                        removed += b - a
                        at = end = b
                kept.update(doc[at:])
                out.append((k, removed, n, kept.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int64()] * 3 + [pa.string()])],
                                             names=["k", "removed", "spans_n", "kept"]) if out else pa.RecordBatch.from_pylist(
                [], pa.schema([("k", pa.int64()), ("removed", pa.int64()), ("spans_n", pa.int64()), ("kept", pa.string())]))

    cut_texts = scratch.write(rows.select("k", "t").join(once, "k").select("k", "t", "spans").mapInArrow(
        cut_out, "k long, removed long, spans_n long, kept string"), "cut")
    whole = (F.col("c") > 1) & (F.col("n_bytes") >= window)
    nothing = hashlib.sha256(b"").hexdigest()
    return info.join(classes, "k").join(cut_texts, "k", "left").select(
        F.col("id").alias(id_col), "n_bytes", F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("spans_n", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.lit(nothing)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"))


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
