"""Periodic runs of words by difference-cover longest common extensions on a harmonic grid.

A run is a stretch of consecutive words of smallest period ``q`` and of at least ``max(6, 4 * q)`` words that no
neighbouring word extends with the same period.

* **Harmonic grid.**  For each period ``q`` only the grid points 0, q, 2q, ... are looked at, n / q of them, n log n in
  all.  A stretch of at least 4q words holds three neighbouring grid points at which words q apart agree, so a grid
  point starts a candidate only if four words q apart are equal: no run is lost.
* **Extensions.**  From a candidate the stretch reaches as far as the suffixes at ``g`` and ``g + q`` agree, and backwards as
  the reversed ones do.  Only the suffixes at positions of a difference cover (modulo ``PERIOD``, |COVER| of each PERIOD words)
  are sorted.  For two positions some shift below PERIOD takes both into the cover: words up to the shift are
  compared, the rest is a minimum over the common prefixes of neighbouring sorted samples, from a sparse table.
* **Smallest periods.**  A stretch of 4q words that has a smaller period has one that divides q and is a maximal stretch
  of that period as well, so of stretches of one extent the smallest period is kept.

Texts are handled whole, in groups of about ``GROUP_WORDS`` words (a longer text alone), with a separator word of its own after
each, so that no extension leaves its text.  Documents don't depend on each other: no shuffle; a lost task is repeated.

Results: null text has no words; texts without runs have n_runs 0 and null for the best run; a document without id is not
altered by the rule on ``crc32(doc_id)``; repeated rows give equal rows; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldframe.llm.common import table

#: A perfect difference set: every shift modulo PERIOD is the difference of two members.
PERIOD, COVER = 31, (0, 1, 3, 8, 12, 18)
GROUP_WORDS = 200_000
_QUERIES = 1 << 18      # extensions asked for at a time

OUT = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, "
       "collapsed_sha256 string")


def _shifts() -> np.ndarray:
    """shift[i, d]: the least t with i + t and i + d + t both in the cover, modulo PERIOD."""
    inside = np.zeros(PERIOD, bool)
    inside[list(COVER)] = True
    t = np.arange(PERIOD)
    at = lambda i, d: int(np.argmax(inside[(i + t) % PERIOD] & inside[(i + d + t) % PERIOD]))
    return np.array([[at(i, d) for d in range(PERIOD)] for i in range(PERIOD)], np.int64)


_SHIFT = _shifts()


def _ranks(*columns: np.ndarray) -> np.ndarray:
    """Ranks from 1 of rows of two columns of ranks."""
    a, b = columns
    key = a.astype(np.int64) * (int(b.max(initial=0)) + 1) + b
    return np.unique(key, return_inverse=True)[1].astype(np.int64) + 1


class Extensions:
    """Longest common extensions of a sequence of positive integers, from sorted cover samples."""

    def __init__(self, words: np.ndarray):
        self.n = len(words)
        self.words = np.append(words, np.zeros(2 * PERIOD, words.dtype)).astype(np.int64)
        # samples by residue, then position: the next sample of a residue is PERIOD words on
        per = [np.arange(r, self.n, PERIOD) for r in COVER]
        self.base = np.full(PERIOD, -1, np.int64)
        self.base[list(COVER)] = np.cumsum([0] + [len(p) for p in per[:-1]])
        at = np.concatenate(per)
        left = np.concatenate([np.arange(len(p), 0, -1) for p in per])      # samples from here to the residue's end
        levels = [self._first(at)]
        # ranks by the first PERIOD * 2**l words, until all samples differ
        reach = 1
        while len(at) and levels[-1].max() < len(at):
            r = levels[-1]
            ahead = np.zeros(len(at), np.int64)
            far = left > reach
            ahead[far] = r[np.flatnonzero(far) + reach]
            levels.append(_ranks(r, ahead))
            reach *= 2
        self.rank = levels[-1] - 1
        order = np.empty(len(at), np.int64)
        order[self.rank] = np.arange(len(at))
        self.table = self._minima(self._neighbours(at, left, levels, order[:-1].copy(), order[1:].copy()))

    def _first(self, at: np.ndarray) -> np.ndarray:
        """Ranks of the samples by their first PERIOD words: neighbouring columns are merged pair by pair."""
        columns = [self.words[at + i] for i in range(PERIOD)]
        while len(columns) > 1:
            columns = [_ranks(*columns[i:i + 2]) if i + 1 < len(columns) else columns[i] for i in range(0, len(columns), 2)]
        return columns[0]

    def _neighbours(self, at, left, levels, x, y) -> np.ndarray:
        """Common prefixes of neighbouring samples: whole blocks by the ranks of each level, the last words one by one."""
        common = np.zeros(len(x), np.int64)
        ends = (np.zeros(len(x), bool), np.zeros(len(x), bool))
        for level in range(len(levels) - 1, -1, -1):
            size, r = 1 << level, levels[level]
            same = ~(ends[0] | ends[1]) & (r[x] == r[y])
            common[same] += size * PERIOD
            for k, v in enumerate((x, y)):
                stop = same & (left[v] <= size)         # the sequence is over: nothing further is common
                ends[k][stop] = True
                go = same & ~stop
                v[go] += size
        live = np.flatnonzero(~(ends[0] | ends[1]))
        for step in range(PERIOD):
            live = live[self.words[at[x[live]] + step] == self.words[at[y[live]] + step]]
            if not len(live):
                break
            common[live] += 1
        return common

    @staticmethod
    def _minima(common: np.ndarray) -> list[np.ndarray]:
        out = [common.astype(np.int32)]
        while 2 << (len(out) - 1) <= len(common):
            half, last = 1 << (len(out) - 1), out[-1]
            out.append(np.minimum(last[:-half], last[half:]))
        return out

    def lce(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of equal words from i and j on; i < j."""
        shift = _SHIFT[i % PERIOD, (j - i) % PERIOD]
        out = shift.copy()
        live = np.arange(len(i))
        for step in range(PERIOD):
            live = live[shift[live] > step]
            if not len(live):
                break
            same = self.words[i[live] + step] == self.words[j[live] + step]
            out[live[~same]] = step
            shift[live[~same]] = -1             # decided
            live = live[same]
        open_ = np.flatnonzero((shift >= 0) & (j + shift < self.n))
        a, b = (self.rank[self.base[p % PERIOD] + p // PERIOD] for p in (i[open_] + shift[open_], j[open_] + shift[open_]))
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp(hi - lo)[1] - 1
        for k in np.unique(level):
            at = level == k
            row = self.table[k]
            out[open_[at]] += np.minimum(row[lo[at]], row[hi[at] - (1 << int(k))])
        return out


def _candidates(seq: np.ndarray, lengths: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(period, grid point) where four words a period apart are equal, by period, then point.

    Texts lie in descending length, so a period looks only at the texts that are long enough for it.
    """
    ends = np.cumsum(lengths + 1)
    periods, points = [], []
    for q in range(1, int(lengths[0]) // 4 + 1):
        texts = int(np.searchsorted(-lengths, -max(4 * q, least), side="right"))
        grid = seq[: ends[texts - 1]: q]
        same = grid[:-1] == grid[1:]
        three = np.flatnonzero(same[:-2] & same[1:-1] & same[2:])
        if len(three):
            periods.append(np.full(len(three), q))
            points.append(three * q)
    if not periods:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(periods), np.concatenate(points)


def find_runs(texts: list[np.ndarray], exponent: int = 4, least: int = 6) -> list[np.ndarray]:
    """Runs (start, length, period) by start, then period, of each sequence of positive integers."""
    if exponent != 4:
        raise ValueError("the grid's filter is that of exponent 4")
    none = np.zeros((0, 3), np.int64)
    out = [none] * len(texts)
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    order = [i for i in order if len(texts[i]) >= least]
    if not order:
        return out
    lengths = np.array([len(texts[i]) for i in order], np.int64)
    top = max(int(texts[i].max()) for i in order)
    seq = np.concatenate([x for k, i in enumerate(order) for x in (texts[i], [top + 1 + k])]).astype(np.int64)
    period, point = _candidates(seq, lengths, least)
    if not len(period):
        return out
    # only texts with a candidate take part in the sort
    ends = np.cumsum(lengths + 1)
    begins = ends - lengths - 1
    owner = np.searchsorted(ends, point, side="right")
    inside = point + 3 * period < ends[owner] - 1
    period, point, owner = period[inside], point[inside], owner[inside]
    if not len(period):
        return out
    used = np.unique(owner)
    moved = np.cumsum(lengths[used] + 1) - lengths[used] - 1
    seq = np.concatenate([seq[begins[u]:ends[u]] for u in used])
    slot = np.searchsorted(used, owner)
    point = point - begins[owner] + moved[slot]
    ahead, back = Extensions(seq), Extensions(seq[::-1])
    starts, stops, qs = [], [], []
    n = len(seq)
    # neighbouring candidates of a period mostly lie in one stretch: only those beyond the last one found are asked about
    heads = np.concatenate([[0], np.flatnonzero((np.diff(period) != 0) | (np.diff(point) != period[1:])) + 1])
    tails = np.append(heads[1:], len(period))
    while len(heads):
        later_h, later_t = [], []
        for at in range(0, len(heads), _QUERIES):
            h, t = heads[at:at + _QUERIES], tails[at:at + _QUERIES]
            g, q = point[h], period[h]
            stop = g + q + ahead.lce(g, g + q)
            start = g + 1 - back.lce(n - 1 - g - q, n - 1 - g)
            starts.append(start)
            stops.append(stop)
            qs.append(q)
            # candidates g' of this stretch have g' + q < stop; the next one to ask about follows
            skip = np.maximum((stop - q - g + q - 1) // q, 1)
            h = h + skip
            more = h < t
            later_h.append(h[more])
            later_t.append(t[more])
        heads, tails = np.concatenate(later_h), np.concatenate(later_t)
    start, stop, q = np.concatenate(starts), np.concatenate(stops), np.concatenate(qs)
    good = stop - start >= np.maximum(exponent * q, least)
    start, stop, q = start[good], stop[good], q[good]
    by = np.lexsort((q, stop, start))
    start, stop, q = start[by], stop[by], q[by]
    fresh = np.ones(len(start), bool)
    fresh[1:] = (np.diff(start) != 0) | (np.diff(stop) != 0)        # the smallest period of each extent
    start, stop, q = start[fresh], stop[fresh], q[fresh]
    by = np.lexsort((q, start))
    start, stop, q = start[by], stop[by], q[by]
    text = np.searchsorted(moved, start, side="right") - 1
    for k in np.unique(text):
        here = text == k
        out[order[int(used[k])]] = np.stack([start[here] - moved[k], (stop - start)[here], q[here]], axis=1)
    return out


def altered(doc_id: int | None, n: int) -> np.ndarray | None:
    """Word numbers after the rule on crc32(doc_id), or None for an unaltered text."""
    if doc_id is None or n == 0:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i >= a, a + (i - a) % p, i)


def best_run(runs: np.ndarray) -> tuple[int, int, int] | None:
    """The run of greatest exact length / period; ties: smallest start, then period."""
    best = None
    for s, n, q in runs.tolist():       # by start, then period: the first of equals stays
        if best is None or n * best[2] > best[1] * q:
            best = (s, n, q)
    return best


def _row(doc_id, words: list[bytes], runs: np.ndarray) -> tuple:
    drop = np.zeros(len(words) + 1, np.int64)
    np.add.at(drop, runs[:, 0] + runs[:, 2], 1)
    np.add.at(drop, runs[:, 0] + runs[:, 1], -1)
    keep = np.flatnonzero(np.cumsum(drop[:-1]) == 0) if len(runs) else None
    kept = words if keep is None else [words[i] for i in keep.tolist()]
    best = best_run(runs)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs.tolist())
    s, n, q = best or (None, None, None)
    return (doc_id, len(runs), s, n, q, None if best is None else 1000 * n // q,
            hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest())


def _group(rows: list[tuple[int | None, list[bytes]]]) -> Iterator[tuple]:
    ids: dict[bytes, int] = {}
    number = lambda w: ids.setdefault(w, len(ids) + 1)
    texts = [np.fromiter(map(number, words), np.int64, len(words)) for _, words in rows]
    for (doc_id, words), runs in zip(rows, find_runs(texts)):
        yield _row(doc_id, words, runs)


_TYPES = [pa.int64()] * 6 + [pa.string()] * 2
_NAMES = [c.split()[0] for c in OUT.split(", ")]


def periodic_runs(docs: DataFrame, alter: bool = False) -> DataFrame:
    """Runs of each text's words: their number, the best one, digests of all runs and of the text without repeats.

    ``alter`` applies the rule on crc32(doc_id) first.
    """
    def run(batches):
        def done(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*_group(rows)), _TYPES)], names=_NAMES)

        rows, held = [], 0
        for b in batches:
            for doc_id, raw in zip(b.column("doc_id").to_pylist(), b.column("t")):
                words = raw.as_py().split()
                at = altered(doc_id, len(words)) if alter else None
                if at is not None:
                    words = [words[i] for i in at.tolist()]
                if rows and held + len(words) > GROUP_WORDS:
                    yield done(rows)
                    rows, held = [], 0
                rows.append((doc_id, words))
                held += len(words)
        if rows:
            yield done(rows)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("t")).mapInArrow(run, OUT)


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of all documents, altered by the rule on crc32(doc_id)."""
    return periodic_runs(table(spark, sf_dir, "documents"), alter=True)
