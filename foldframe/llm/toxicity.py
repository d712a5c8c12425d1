"""Toxicity scores of a factorization machine over hashed terms.

A text is its set of lower-cased terms, hashed into ``2**bits`` places.  The machine scores
``w0 + sum w_i + sum_{i<j} <v_i, v_j>`` over the present terms, so it learns pairs, such as an insult beside the mention of
a group, that additive weights miss; a logistic function gives the score.

Fitting: at most ``train_rows`` labelled rows (a documented bound; those first by MD5 of the id) are
turned into hashed terms by the executors and written.  Only terms of at
least ``min_rows`` training rows whose share of toxic rows differs from the overall share by
``min_z`` standard deviations get weights; the executors count them, and only the rows' terms that get weights
come to the driver, which fits them by AdaGrad.  The model, at most ``2**bits`` weights and factors, is shipped
to the scoring tasks; every text is scored whole.

Results: null text counts as empty and gets the score of the bias; null labels teach nothing; a
null id counts as the empty string in the split; of a labelled id with several texts one teaches; without training rows every score
is that of ``PRIOR``, so no text is predicted toxic; repeated rows are scored alike; an empty table gives an empty result; of other columns none is read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldframe.llm.common import Scratch, table

_TERM = re.compile(r"\w+")
BITS = 20
#: Words also count by their first letters, which finds inflected and compound forms.
PREFIXES = (5, 7)
#: Bias of a model that no row taught: few texts are toxic.
PRIOR = -5.0


def _places(word: str, bits: int) -> list[int]:
    forms = [word, *("^" + word[:n] for n in PREFIXES if len(word) > n)]
    return [zlib.crc32(f.encode()) & ((1 << bits) - 1) for f in forms]


def _words(text: str | None) -> set[str]:
    return set(_TERM.findall(text.lower())) if text else set()


def terms(text: str | None, bits: int = BITS) -> np.ndarray:
    """Distinct hashed terms of a whole text, ascending."""
    return np.array(sorted({p for w in _words(text) for p in _places(w, bits)}), np.int32)


@dataclass
class FactorizationMachine:
    bias: float
    ids: np.ndarray  # hashed terms that have weights, ascending
    w: np.ndarray
    v: np.ndarray

    def scorer(self, bits: int = BITS, memo_words: int = 50_000):
        """A function text -> score that remembers which weights a word has."""
        at = {int(x): i for i, x in enumerate(self.ids)}
        memo: dict[str, tuple] = {}

        def score(text: str | None) -> float:
            cells = set()
            for word in _words(text):
                own = memo.get(word)
                if own is None:
                    if len(memo) >= memo_words:
                        memo.clear()
                    own = memo[word] = tuple(at[p] for p in _places(word, bits) if p in at)
                if own:
                    cells.update(own)
            cells = sorted(cells)
            v = self.v[cells]
            z = self.bias + self.w[cells].sum() + 0.5 * float((v.sum(axis=0) ** 2 - (v ** 2).sum(axis=0)).sum())
            return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

        return score


def _telling(counts: np.ndarray, toxic: np.ndarray, n: int, share: float, min_rows: int, min_z: float) -> np.ndarray:
    """Which terms get weights, by their rows and toxic rows among ``n`` rows with a ``share`` of toxic ones."""
    spread = np.sqrt(counts * share * (1 - share) * (1 - counts / n)) + 1e-9
    return (counts >= min_rows) & (np.abs((toxic - counts * share) / spread) >= min_z)


def fit_fm(rows: list[np.ndarray], labels: np.ndarray, factors: int = 4, epochs: int = 25, rate: float = 0.3,
           l2_w: float = 0.002, l2_v: float = 0.005, min_rows: int = 5, min_z: float = 4.5, batch: int = 256,
           seed: int = 7, ids: np.ndarray | None = None) -> FactorizationMachine:
    """AdaGrad on the logistic loss of (rows of hashed terms, 0/1 labels).  ``ids``: the terms that get weights, ascending, if known."""
    n = len(rows)
    if n == 0:
        return FactorizationMachine(PRIOR, np.empty(0, np.int32), np.empty(0), np.empty((0, factors)))
    y = np.asarray(labels, float)
    sizes = np.array([len(r) for r in rows])
    flat = np.concatenate(rows)
    if ids is None:
        ids, inverse = np.unique(flat, return_inverse=True)
        counts, toxic = np.bincount(inverse, minlength=len(ids)), np.bincount(inverse, np.repeat(y, sizes), minlength=len(ids))
        ids = ids[_telling(counts, toxic, n, y.mean(), min_rows, min_z)]
    at = np.searchsorted(ids, flat)
    known = (at < len(ids)) & (ids[np.minimum(at, max(0, len(ids) - 1))] == flat) if len(ids) else np.zeros(len(flat), bool)
    owner = np.repeat(np.arange(n), sizes)[known]
    cells = at[known]
    ends = np.searchsorted(owner, np.arange(n + 1))
    rng = np.random.default_rng(seed)
    w, v = np.zeros(len(ids)), rng.normal(0, 0.01, (len(ids), factors))
    gw, gv, gb = np.full(len(ids), 1e-6), np.full((len(ids), factors), 1e-6), 1e-6
    rate_pos = float(np.clip(y.mean(), 1e-4, 1 - 1e-4))
    bias = float(np.log(rate_pos / (1 - rate_pos)))
    for _ in range(epochs):
        order = rng.permutation(n)
        for start in range(0, n, batch):
            rows_b = order[start:start + batch]
            lens = ends[rows_b + 1] - ends[rows_b]
            doc = np.repeat(np.arange(len(rows_b)), lens)
            c = cells[np.repeat(ends[rows_b] - np.cumsum(lens) + lens, lens) + np.arange(lens.sum())]
            vc = v[c]
            total = np.stack([np.bincount(doc, vc[:, f], len(rows_b)) for f in range(factors)], axis=1)
            square = np.bincount(doc, (vc ** 2).sum(axis=1), len(rows_b))
            z = bias + np.bincount(doc, w[c], len(rows_b)) + 0.5 * ((total ** 2).sum(axis=1) - square)
            d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows_b]) / len(rows_b)
            u, inv = np.unique(c, return_inverse=True)
            grad_w = np.bincount(inv, d[doc], len(u)) + l2_w * w[u] / len(rows_b)
            pull = d[doc][:, None] * (total[doc] - vc)
            grad_v = np.stack([np.bincount(inv, pull[:, f], len(u)) for f in range(factors)], axis=1) + l2_v * v[u] / len(rows_b)
            gw[u] += grad_w ** 2
            gv[u] += grad_v ** 2
            w[u] -= rate * grad_w / np.sqrt(gw[u])
            v[u] -= 0.3 * rate * grad_v / np.sqrt(gv[u])
            g = float(d.sum())
            gb += g * g
            bias -= rate * g / np.sqrt(gb)
    return FactorizationMachine(bias, ids, w, v)


def labelled_terms(docs: DataFrame, labels: DataFrame, train_rows: int, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "toxic") -> DataFrame:
    """``i, y, h``: id, label and hashed terms (32-bit integers) of at most ``train_rows`` labelled documents of the training split."""
    own = labels.select(F.col(id_col).alias("i"), F.col(label_col).alias("y")).where("y is not null and i is not null")
    own = own.where(~held_out(F.col("i"))).groupBy("i").agg(F.max("y").alias("y"))
    own = own.orderBy(F.md5(F.col("i").cast("string")), "i").limit(train_rows)  # at most train_rows are broadcast

    @F.pandas_udf("binary")
    def hashed(texts: pd.Series) -> pd.Series:
        return pd.Series([terms(t).tobytes() for t in texts])

    return docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).join(F.broadcast(own), "i").select(
        "i", "y", hashed("t").alias("h")).groupBy("i", "y").agg(F.max("h").alias("h"))


def _collected(rows: DataFrame) -> tuple[list[np.ndarray], np.ndarray]:
    found = rows.toArrow().sort_by([("i", "ascending"), ("h", "ascending")])
    return [np.frombuffer(h, np.int32) for h in found["h"].to_pylist()], np.array(found["y"].to_pylist(), float)


def training_rows(docs: DataFrame, labels: DataFrame, train_rows: int, **columns) -> tuple[list[np.ndarray], np.ndarray]:
    """All hashed terms and labels of at most ``train_rows`` labelled documents of the training split."""
    return _collected(labelled_terms(docs, labels, train_rows, **columns))


def telling_terms(rows: DataFrame, min_rows: int, min_z: float, bits: int = BITS) -> np.ndarray:
    """The terms of ``labelled_terms`` that get weights, ascending; at most ``2**bits`` sums reach the driver."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, toxic = np.zeros((1 << bits) + 1, np.int64), np.zeros((1 << bits) + 1)       # the last: all rows
        for b in batches:
            for y, h in zip(b.column(0).to_pylist(), b.column(1)):
                at = np.append(np.frombuffer(h.as_buffer(), np.int32), 1 << bits)
                n[at] += 1
                toxic[at] += y
        at = np.flatnonzero(n)
        for lo in range(0, len(at), 1 << 16):
            part = at[lo:lo + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(n[part]), pa.array(toxic[part])], names=["t", "n", "s"])

    sums = rows.select(F.col("y").cast("double"), "h").mapInArrow(count, "t int, n long, s double").groupBy("t").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s")).where(f"n >= {int(min_rows)} OR t = {1 << bits}").toArrow().sort_by("t")
    t, n, s = (sums[c].to_numpy() for c in ("t", "n", "s"))
    if not len(t):
        return np.empty(0, np.int32)
    return t[:-1][_telling(n[:-1], s[:-1], n[-1], s[-1] / n[-1], min_rows, min_z)]


def held_out(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def toxicity_score(model: FactorizationMachine, text: Column) -> Column:
    @F.pandas_udf("double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score = model.scorer()
        for texts in parts:
            yield pd.Series([score(t) for t in texts], dtype="float64")

    return run(text)


def fit_toxicity(docs: DataFrame, labels: DataFrame, train_rows: int = 20_000, min_rows: int = 5, min_z: float = 4.5,
                 **options) -> FactorizationMachine:
    scratch = Scratch(docs.sparkSession, "toxicity")
    rows = scratch.write(labelled_terms(docs, labels, train_rows), "terms")     # read by the counts and by the fit
    ids = telling_terms(rows, min_rows, min_z)

    @F.pandas_udf("binary")
    def kept(terms_: pd.Series) -> pd.Series:
        return pd.Series([(t := np.frombuffer(h, np.int32))[np.isin(t, ids)].tobytes() for h in terms_], dtype=object)

    found = _collected(rows.select("i", "y", kept("h").alias("h")))
    scratch.clear()
    return fit_fm(*found, ids=ids, **options)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), toxicity_score(model, F.col("text")).alias("score")
                       ).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more."""
    return docs.where(toxicity_score(fit_toxicity(docs, labels, **options), F.col(text_col)) < threshold)
