"""Hidden Markov language model: Baum-Welch over the corpus, scaled forward scores of whole texts.

Tokens are lower-cased words (A-Z) and one end per text.  Word counts cover all training texts.  The
words whose count reaches ``min_count`` and the level at which at most ``head_words`` remain are the head; every state has a probability for each head
word, for the end and for the class of all other words, within which a word has its smoothed share of the
class's corpus count.  So model memory is bounded while no count is: other words are looked up in the
full count table by a join.

Training: from the head's shares of the corpus, moved apart by state, ``rounds`` of Baum-Welch over all training texts, cut
whole into segments of ``segment`` tokens; each task adds up its expected counts and Spark sums them
by word.  The texts' ids are written once and read by every round.  Scoring: the exact likelihood of each whole text by the scaled forward recursion, all texts of
a batch side by side, plus the shares of its other words.

Results: null text is the end alone; a null id counts as the empty string in the split; repeated rows
are scored each; without training texts the model knows the end and the class of other words, equally
likely; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldframe.llm.common import Scratch, table

ALPHA = 0.1


def words(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []


def held_out(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def word_counts(texts: DataFrame, scratch: Scratch, flush: int = 500_000) -> DataFrame:
    """Written table (word, c) over all texts (column ``t``); the end is the null word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(c: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c.keys()), pa.binary()), pa.array(list(c.values()), pa.int64())], names=["word", "c"])

        counts: Counter = Counter()
        ends = 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(words(text))
                ends += 1
                if len(counts) >= flush:
                    yield out(counts)
                    counts = Counter()
        if ends:
            yield out(counts)
            yield out({None: ends})

    return scratch.write(texts.mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")), "counts")


class Model:
    """start, later (of segments that don't begin a text), move: states x states, emit: (head + 2) x states."""

    def __init__(self, head: list[bytes], start, later, move, emit):
        self.head, self.start, self.later, self.move, self.emit = head, start, later, move, emit

    @property
    def other(self) -> int:
        return len(self.head)

    @property
    def end(self) -> int:
        return len(self.head) + 1


def encode(text: str | None, ids: dict[bytes, int], other: int) -> np.ndarray:
    found = words(text)
    out = np.fromiter((ids.get(w, other) for w in found), np.int32, len(found))
    return np.append(out, np.int32(other + 1))


def segments(seqs: list[np.ndarray], size: int) -> tuple[list[np.ndarray], np.ndarray]:
    """All tokens of the sequences in runs of at most ``size``, and whether a run begins its text."""
    cut = [s[at:at + size] for s in seqs for at in range(0, len(s), size)]
    return cut, np.array([at == 0 for s in seqs for at in range(0, len(s), size)], bool)


def _padded(cut: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order by falling length, lengths in it, ids by step)."""
    lens = np.array([len(c) for c in cut])
    order = np.argsort(-lens, kind="stable")
    lens = lens[order]
    grid = np.zeros((lens[0], len(cut)), np.int32)
    for j, i in enumerate(order):
        grid[:lens[j], j] = cut[i]
    return order, lens, grid


def expected_counts(model: Model, cut: list[np.ndarray], first: np.ndarray):
    """Expected (start, later, move, emit) counts and the log likelihood of segments."""
    k = len(model.start)
    order, lens, ids = _padded(cut)
    steps, n = ids.shape
    active = np.searchsorted(-lens, -np.arange(steps), side="left")  # segments longer than t
    f, c = np.zeros((steps, n, k)), np.ones((steps, n))
    e = model.emit[ids]
    x = np.where(first[order][:, None], model.start, model.later) * e[0]
    for t in range(steps):
        m = active[t]
        if t:
            x = (f[t - 1, :m] @ model.move) * e[t, :m]
        c[t, :m] = x.sum(axis=1)
        f[t, :m] = x / c[t, :m, None]
    move = np.zeros((k, k))
    back = np.ones((n, k))
    for t in range(steps - 2, -1, -1):
        m = active[t + 1]
        ahead = e[t + 1, :m] * back[:m] / c[t + 1, :m, None]
        move += f[t, :m].T @ ahead
        back[:m] = ahead @ model.move.T
        f[t, :m] *= back[:m]
    move *= model.move
    inside = np.arange(steps)[:, None] < lens
    flat, gamma = ids[inside], f[inside]
    emit = np.stack([np.bincount(flat, gamma[:, s], len(model.emit)) for s in range(k)], axis=1)
    return f[0][first[order]].sum(0), f[0][~first[order]].sum(0), move, emit, float(np.log(c).sum())


def maximise(head: list[bytes], base: np.ndarray, start, later, move, emit, smooth: float = 0.05) -> Model:
    """Parameters from expected counts; emissions are mixed with ``smooth`` parts of ``base``, the share of each symbol."""
    share = lambda x: (x + 0.1) / (x + 0.1).sum(axis=-1, keepdims=True)
    return Model(head, share(start), share(later), share(move), (1 - smooth) * emit / np.maximum(emit.sum(axis=0), 1e-300) + smooth * base[:, None])


def log_likelihood(model: Model, seqs: list[np.ndarray]) -> np.ndarray:
    """Natural log probability of each whole sequence by the scaled forward recursion."""
    out = np.zeros(len(seqs))
    order = sorted(range(len(seqs)), key=lambda i: -len(seqs[i]))
    lens = np.array([len(seqs[i]) for i in order])
    flat = np.concatenate([seqs[i] for i in order]) if seqs else np.empty(0, np.int32)
    at = np.cumsum(lens) - lens
    x = None
    total = np.zeros(len(seqs))
    for t in range(lens[0] if len(lens) else 0):
        m = int(np.searchsorted(-lens, -t, side="left"))
        e = model.emit[flat[at[:m] + t]]
        x = model.start * e if t == 0 else (x[:m] @ model.move) * e
        c = x.sum(axis=1)
        x = x / c[:, None]
        total[:m] += np.log(c)
    out[order] = total
    return out


class _Head:
    """Word -> id of the head, made once per Python worker and model."""
    made: tuple = (None, {})

    @classmethod
    def ids(cls, key: str, head: list[bytes]) -> dict[bytes, int]:
        if cls.made[0] != key:
            cls.made = (key, {w: i for i, w in enumerate(head)})
        return cls.made[1]


def encoded(texts: DataFrame, shared, key: str, scratch: Scratch) -> DataFrame:
    """Written table of the ids of every text (32-bit), read by the rounds."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _Head.ids(key, shared.value.head)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([encode(t, ids, len(ids)).tobytes() for t in batch.column(0).to_pylist()], pa.binary())], names=["ids"])

    return scratch.write(texts.mapInArrow(run, "ids binary"), "ids")


def _round(seqs: DataFrame, shared, segment: int, block: int = 2048) -> tuple:
    """Expected counts over all texts (``encoded``): each task's sums, added up by symbol."""
    k = len(shared.value.start)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        start, later, move, emit = np.zeros(k), np.zeros(k), np.zeros((k, k)), np.zeros((len(model.emit), k))
        for batch in batches:
            cut, first = segments([np.frombuffer(x, np.int32) for x in batch.column(0).to_pylist()], segment)
            for lo in range(0, len(cut), block):
                found = expected_counts(model, cut[lo:lo + block], first[lo:lo + block])
                start += found[0]
                later += found[1]
                move += found[2]
                emit += found[3]
        rows = np.flatnonzero(emit.any(axis=1))
        # start, later and move take the numbers below zero
        symbol = np.concatenate([rows, -1 - np.arange(k + 2)])
        value = np.concatenate([emit[rows], [start, later], move])
        yield pa.RecordBatch.from_arrays([pa.array(symbol, pa.int32()), *(pa.array(value[:, s]) for s in range(k))],
                                         names=["symbol", *(f"s{s}" for s in range(k))])

    cols = ", ".join(f"s{s} double" for s in range(k))
    found = seqs.mapInArrow(run, f"symbol int, {cols}").groupBy("symbol").agg(*(F.sum(f"s{s}").alias(f"s{s}") for s in range(k))).toArrow()
    symbol = found["symbol"].to_numpy()
    value = np.stack([found[f"s{s}"].to_numpy() for s in range(k)], axis=1)
    emit = np.zeros((len(shared.value.emit), k))
    emit[symbol[symbol >= 0]] = value[symbol >= 0]
    rest = {int(-1 - s): v for s, v in zip(symbol[symbol < 0], value[symbol < 0])}
    zero = np.zeros(k)
    return rest.get(0, zero), rest.get(1, zero), np.stack([rest.get(2 + s, zero) for s in range(k)]), emit


def train(texts: DataFrame, counts: DataFrame, stats: dict, scratch: Scratch, states: int = 6, head_words: int = 131_072, min_count: int = 5,
          rounds: int = 3, segment: int = 128, seed: int = 3) -> Model:
    """The model of all texts: every round goes over every segment of every text, the first from the corpus-wide shares of the
    symbols times a random factor by state."""
    spark = texts.sparkSession
    known = counts.where("word is not null")
    by_count = sorted(((r["c"], r["n"]) for r in known.groupBy("c").agg(F.count("*").alias("n")).collect()), reverse=True)
    level, held = None, 0
    for c, n in by_count:
        if c < min_count or held + n > head_words:
            break
        level, held = c, held + n
    rows = known.where(F.col("c") >= level).toArrow().sort_by([("c", "descending"), ("word", "ascending")]) if level else None
    head = rows["word"].to_pylist() if level else []
    head_counts = rows["c"].to_numpy() if level else np.empty(0, np.int64)
    base = np.concatenate([head_counts, [stats["tokens"] - stats["texts"] - head_counts.sum(), stats["texts"]]]).astype(float) + ALPHA
    base /= base.sum()
    rng = np.random.default_rng(seed)
    emit = base[:, None] * np.exp(0.5 * rng.standard_normal((len(base), states)))
    move = np.full((states, states), 0.1 / max(1, states - 1))
    np.fill_diagonal(move, 0.9)
    flat = np.full(states, 1 / states)
    stats["head_counts"] = head_counts
    model = Model(head, flat, flat, move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))
    if not stats["texts"]:
        return model
    key = scratch.tag + scratch.path("model")
    shared = spark.sparkContext.broadcast(model)
    seqs = encoded(texts, shared, key, scratch)
    for i in range(rounds):
        if i:
            shared.unpersist()
            shared = spark.sparkContext.broadcast(model)
        model = maximise(head, base, *_round(seqs, shared, segment))
    scratch.drop(seqs)
    shared.unpersist()
    model.key = key
    return model


def score_texts(docs: DataFrame, counts: DataFrame, stats: dict, model: Model, scratch: Scratch) -> DataFrame:
    """docs (id, held_out, t) -> (id, held_out, n_tokens, n_known, base_score, score)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    key = getattr(model, "key", scratch.path("model"))
    total = stats["tokens"] + ALPHA * (stats["distinct"] + 1)
    head_c = docs.sparkSession.sparkContext.broadcast(np.append(stats["head_counts"], [0, stats["texts"]]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        ids = _Head.ids(key, m.head)
        unit = np.log10((head_c.value + ALPHA) / total)
        unit[m.other] = 0.0
        seen = head_c.value > 0
        for batch in batches:
            texts = batch.column(3).to_pylist()
            seqs, rare = [], []
            for text in texts:
                found = words(text)
                seqs.append(np.append(np.fromiter((ids.get(w, m.other) for w in found), np.int32, len(found)), np.int32(m.end)))
                rare.append(Counter(w for w in found if w not in ids))
            score = log_likelihood(m, seqs) / np.log(10)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array([len(s) for s in seqs], pa.int64()), pa.array([int(seen[s].sum()) for s in seqs], pa.int64()),
                 pa.array([float(unit[s].sum()) for s in seqs]), pa.array(score),
                 pa.array([list(r.keys()) for r in rare], pa.list_(pa.binary())), pa.array([list(r.values()) for r in rare], pa.list_(pa.int32()))],
                names=["row", "id", "held_out", "n", "known", "base", "hmm", "rare", "times"])

    # written, so that every later read finds the same row numbers
    kind = docs.schema["id"].dataType.simpleString()
    scored = scratch.write(docs.select(F.monotonically_increasing_id().alias("row"), "id", "held_out", "t").mapInArrow(
        run, f"row long, id {kind}, held_out boolean, n long, known long, base double, hmm double, rare array<binary>, times array<int>"), "scored")
    tail = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    rare_total = stats["other_tokens"] + ALPHA * (stats["other_distinct"] + 1)
    c = F.coalesce("c", F.lit(0))
    tail = tail.join(counts.where("word is not null"), "word", "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log10((c + ALPHA) / F.lit(total))).alias("base_rest"),
        F.sum(F.col("times") * F.log10((c + ALPHA) / F.lit(rare_total))).alias("hmm_rest"),
        F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("known_rest"))
    return (scored.drop("rare", "times").join(tail, "row", "left")
            .withColumn("n_tokens", F.col("n")).withColumn("n_known", F.col("known") + F.coalesce("known_rest", F.lit(0)))
            .withColumn("base_score", F.col("base") + F.coalesce("base_rest", F.lit(0.0)))
            .withColumn("score", F.col("hmm") + F.coalesce("hmm_rest", F.lit(0.0)))
            .select("id", "held_out", "n_tokens", "n_known", "base_score", "score"))


def hmm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: ``id_col``, held_out, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    scratch = Scratch(docs.sparkSession, "hmm")
    rows = docs.select(F.col(id_col).alias("id"), held_out(F.col(id_col)).alias("held_out"),
                       F.col(text_col).alias("t"))
    texts = rows.where(~F.col("held_out")).select("t")
    counts = word_counts(texts, scratch)
    s = counts.agg(F.sum("c").alias("tokens"), F.count("*").alias("distinct"),
                   F.sum(F.when(F.col("word").isNull(), F.col("c"))).alias("texts")).first()
    stats = {"tokens": s["tokens"] or 0, "distinct": s["distinct"], "texts": s["texts"] or 0}
    model = train(texts, counts, stats, scratch, **options)
    stats["other_tokens"] = stats["tokens"] - stats["texts"] - int(stats["head_counts"].sum())
    stats["other_distinct"] = stats["distinct"] - (1 if stats["texts"] else 0) - len(model.head)
    return score_texts(rows, counts, stats, model, scratch).select(
        F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(stats["tokens"]).cast("long").alias("train_tokens"),
        "base_score", "score")


def op4_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_scores(table(spark, sf_dir, "documents"))
