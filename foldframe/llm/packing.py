"""Best-fit packing of tokenised documents by a configuration linear program.

Documents become token ids (plus one end id) and are cut only where longer than a sequence.  The
lengths' histogram, at most ``capacity`` numbers whatever the corpus, goes to the driver.  There the
configuration program (fewest sequences, each filled by a pattern of lengths, every length covered)
is solved by multiplicative weights: lengths that are covered less weigh more, a knapsack dynamic
program over the capacity prices the best patterns, and their counts grow by a step.  The counts are
rounded down, and the few pieces of each length that remain are fitted best-first, in groups of equal
bins, so that this too is bounded by the capacity and not by the number of pieces.

The plan says for each length which ranks go to which sequences.  Pieces get their rank within their
length from 1024 hash ranges per length and range counts, so no task holds all pieces of one length.

Results: null text is the end id alone; empty tables give empty results; a null id is a document like
any other; repeated rows are packed each; extra columns are not read.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldframe.llm.common import Scratch, table

_RANGES = 1024
#: Letters of ASCII (lower case) and Latin-1, then punctuation without the apostrophe: the tokenizer's normaliser only lower-cases
#: them and its splitter cuts them between the two and nowhere else.
_WORD = re.compile(rb"((?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([!-&(-/:-@\[-`{-~]*)")
_CHUNK = 1 << 20        # characters of texts that are looked up together


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


@lru_cache(maxsize=1)
def _byte_letters() -> dict[int, str]:
    """The letters that a byte-level vocabulary writes bytes with: printable Latin-1 ones stand for themselves, the
    others follow from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


class TokenIds:
    """Token ids of texts as little-endian 32-bit bytes.

    The tokenizer lower-cases, drops white space and never joins across it, so a text's ids are those of its
    lower-cased parts between ASCII white space.  The ids of short parts are remembered in two generations of at most
    ``memo_parts`` each; when the young one is full the old one goes.  With the defaults that is at most some 150 MB in a worker.
    """

    def __init__(self, path: str, memo_parts: int = 400_000, memo_bytes: int = 48):
        self.tokenizer, self.limit, self.short = _tokenizer(path), memo_parts, memo_bytes
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    @staticmethod
    def parts(text: str | None) -> list[bytes]:
        if not text:
            return []
        if "<|" in text:  # a special token in capitals is ordinary text
            return text.encode().split()
        return text.encode().lower().split()

    def _learn(self, parts: set[bytes]) -> dict[bytes, bytes]:
        """The ids of parts that the young generation lacks; it gets those of the short ones."""
        if len(self.young) + len(parts) > self.limit:
            self.old, self.young = self.young, {}
        letters, tokenize, old = _byte_letters(), self.tokenizer.model.tokenize, self.old
        found, other = {}, []
        for p in parts:
            ids = old.get(p)
            if ids is None:
                word = _WORD.fullmatch(p)
                if word is None:
                    other.append(p)
                    continue
                # a word goes to the model itself, which spares it the normaliser and the splitter
                stem, stop = word.groups()
                if not stem.isascii():
                    stem = stem.decode().lower().encode()
                tokens = tokenize(stem.decode("latin-1").translate(letters))
                if stop:
                    tokens += tokenize(stop.decode())
                ids = array("I", [t.id for t in tokens]).tobytes()
            found[p] = ids
        for p, e in zip(other, self.tokenizer.encode_batch_fast([p.decode() for p in other], add_special_tokens=False) if other else ()):
            found[p] = np.array(e.ids, "<u4").tobytes()
        if len(parts) <= self.limit:
            self.young.update((p, ids) for p, ids in found.items() if len(p) <= self.short)
        return found

    def _of_parts(self, texts: list[list[bytes]]) -> Iterator[bytes]:
        young = self.young
        rows = [list(map(young.get, parts)) for parts in texts]
        lack = {p for parts, ids in zip(texts, rows) if None in ids for p, x in zip(parts, ids) if x is None}
        found = self._learn(lack) if lack else {}
        for parts, ids in zip(texts, rows):
            yield b"".join([found[p] if x is None else x for p, x in zip(parts, ids)] if None in ids else ids)

    def __call__(self, texts: list[str | None]) -> Iterator[bytes]:
        held, size = [], 0
        for text in texts:
            held.append(self.parts(text))
            size += len(text or "")
            if size > _CHUNK:
                yield from self._of_parts(held)
                held, size = [], 0
        yield from self._of_parts(held)


@lru_cache(maxsize=2)
def _token_ids(path: str) -> TokenIds:
    """One per Python worker, so that later tasks find what earlier ones remembered."""
    return TokenIds(path)


def pieces(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece of every document."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = _token_ids(path)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, ids in zip(batch.column(0).to_pylist(), ids_of(batch.column(1).to_pylist())):
                ids += end
                n = len(ids) // 4
                for k, start in enumerate(range(0, n, capacity)):
                    part = ids[4 * start:4 * (start + capacity)]
                    for col, x in zip(out, (doc, k, start, len(part) // 4, zlib.crc32(part))):
                        col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], batch.schema.field(0).type), pa.array(out[1], pa.int32()),
                                              *(pa.array(c, pa.int64()) for c in out[2:])],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t")).mapInArrow(
        run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


Pattern = tuple[tuple[int, int], ...]  # (length, copies), longest first


def _price(y: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Knapsack over the capacity: best value of each fill and the last length in it (-1: none)."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c], last[c] = best[c - 1], -2  # one place left empty
        k = fits[c]
        if k:
            values = best[c - lengths[:k]] + y[:k]
            at = int(values.argmax())
            if values[at] > best[c]:
                best[c], last[c] = values[at], at
    return best, last


def _pattern(last: np.ndarray, lengths: np.ndarray, fill: int, first: int) -> dict[int, int]:
    found = {first: 1}
    while fill > 0:
        at = int(last[fill])
        if at < 0:
            fill -= 1
            continue
        found[at] = found.get(at, 0) + 1
        fill -= int(lengths[at])
    return found


def solve_configuration_lp(histogram: dict[int, int], capacity: int, rounds: int = 120, per_round: int = 24,
                           step: float = 0.25, eta: float = 3.0) -> list[tuple[Pattern, float]]:
    """Patterns and fractional counts whose cover of the lengths is as even as the rounds allow."""
    lengths = np.array(sorted(histogram), np.int64)
    need = np.array([histogram[x] for x in lengths.tolist()], float)
    cover = np.zeros(len(lengths))
    counts: dict[Pattern, float] = {}
    for _ in range(rounds):
        weight = np.exp(-eta * (cover - cover.min()))
        y = weight * lengths / need.clip(1) if len(lengths) == 1 else weight * lengths
        best, last = _price(y, lengths, capacity)
        value = y + best[capacity - lengths]
        for first in np.argsort(-value * (1 + weight), kind="stable")[:per_round]:
            if cover[first] > cover.min() + 1 + step:
                continue
            found = _pattern(last, lengths, capacity - int(lengths[first]), int(first))
            size = step * min(need[i] / a for i, a in found.items())
            for i, a in found.items():
                cover[i] += size * a / need[i]
            key = tuple((int(lengths[i]), a) for i, a in sorted(found.items(), reverse=True))
            counts[key] = counts.get(key, 0) + size
        if cover.min() >= 1 / step:
            break
    scale = 1 / max(1e-9, float((cover * need * lengths).sum() / (need * lengths).sum()))
    return [(p, x * scale) for p, x in counts.items()]


def best_fit(rest: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best fit of a histogram, longest first, in groups of equal bins."""
    groups: dict[int, list[tuple[Pattern, int]]] = {}
    rooms: list[int] = []

    def put(room: int, pattern: Pattern, n: int) -> None:
        if n:
            if not groups.get(room):
                groups[room] = []
                insort(rooms, room)
            groups[room].append((pattern, n))

    for length in sorted((x for x, n in rest.items() if n), reverse=True):
        n = rest[length]
        while n:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                k = capacity // length
                full, part = divmod(n, k)
                put(capacity - k * length, ((length, k),), full)
                if part:
                    put(capacity - part * length, ((length, part),), 1)
                break
            room = rooms[at]
            pattern, bins = groups[room].pop()
            if not groups[room]:
                rooms.pop(at)
            used = min(bins, n)
            put(room, pattern, bins - used)
            grown = (*pattern[:-1], (length, pattern[-1][1] + 1)) if pattern[-1][0] == length else (*pattern, (length, 1))
            put(room - length, grown, used)
            n -= used
    return [x for own in groups.values() for x in own]


def _round_down(program: list[tuple[Pattern, float]], rest: dict[int, int], capacity: int, share: float) -> list[tuple[Pattern, int]]:
    """Whole counts of ``share`` of a program's well-filled patterns, taken out of ``rest``."""
    out = []
    for pattern, x in sorted(program, key=lambda p: -p[1]):
        if sum(length * a for length, a in pattern) < 0.998 * capacity:
            continue  # better fitted with what is left
        n = min(int(x * share), *(rest[length] // a for length, a in pattern))
        if n > 0:
            out.append((pattern, n))
            for length, a in pattern:
                rest[length] -= n * a
    return out


def plan_sequences(histogram: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Whole counts of patterns that hold every piece of the histogram exactly once.

    Rounding down loses most where lengths are many and pieces few, so several shares of the program are rounded,
    the whole one with a second program for what is left; the plan of the fewest sequences is taken.
    """
    rest, full = dict(histogram), []
    if capacity in rest:
        full.append((((capacity, 1),), rest.pop(capacity)))
    if not rest:
        return full
    program, plans = solve_configuration_lp(rest, capacity), []
    for share in (1.0, 0.9, 0.5, 0.0):
        left = dict(rest)
        plan = _round_down(program, left, capacity, share)
        plans.append(plan + best_fit(left, capacity))
        todo = {x: n for x, n in left.items() if n}
        if share == 1.0 and todo:
            plan = plan + _round_down(solve_configuration_lp(todo, capacity), left, capacity, 1.0)
            plans.append(plan + best_fit(left, capacity))
    return full + min(plans, key=lambda p: sum(n for _, n in p))


def _slots(plan: list[tuple[Pattern, int]]):
    """Columns of the plan by (length, first rank): copies per sequence, first sequence, offset."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, n in plan:
        offset = 0
        for length, a in pattern:
            first = taken.get(length, 0)
            rows.append((length, first, a, sequence, offset))
            taken[length] = first + a * n
            offset += a * length
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(cut: DataFrame, capacity: int = 2048) -> DataFrame:
    """``pieces`` -> adds sequence_id and offset.  ``cut`` is read three times: give a written table."""
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = _slots(plan_sequences(histogram, capacity))
    key = (slots[:, 0] << 44) + slots[:, 1]

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        own = slots[np.searchsorted(key, (length.to_numpy(np.int64) << 44) + rank.to_numpy(np.int64), side="right") - 1]
        at = rank.to_numpy(np.int64) - own[:, 1]
        return pd.DataFrame({"sequence_id": own[:, 3] + at // own[:, 2],
                             "offset": own[:, 4] + at % own[:, 2] * own[:, 0]})

    rows = cut.withColumn("_range", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(_RANGES)))
    before = Window.partitionBy("length").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("length", "_range").agg(F.count("*").alias("_n")).select(
        "length", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy("length", "_range").orderBy("doc_id", "piece", "ids_crc32")
    ranked = rows.withColumn("_rank", F.row_number().over(inside) - 1).join(starts, ["length", "_range"])
    return ranked.withColumn("_p", place(F.col("length"), F.col("_rank") + F.col("_first"))).select(
        *cut.columns, F.col("_p.sequence_id").alias("sequence_id"), F.col("_p.offset").alias("offset"))


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = 2048, end_id: int = 0,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    scratch = Scratch(docs.sparkSession, "packing")
    cut = scratch.write(pieces(docs, path or default_tokenizer(), capacity, end_id, id_col, text_col), "pieces")
    return pack(cut, capacity)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
