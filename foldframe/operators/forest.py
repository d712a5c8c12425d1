"""Tree ensembles as data (T12): node arrays, a node table, and a scorer over binned features.

A fitted model is a list of trees over bins.  ``Nodes`` holds the trees of one model as flat arrays (feature, threshold,
category bits, children, value); a batch of rows walks down all trees at once, one array step per level, so
the cost is rows x trees x depth whatever the number of trees, and no expression grows with the model.  ``Forest`` is the
same as a DataFrame, a row per node: it can be saved, loaded and queried like any table.  The arrays travel to the tasks with
the scoring function; their size is trees x leaves x 40 bytes plus one bit per category and categorical split.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Codes:
    """A set of category codes as bits: a side of a column of a million values takes 125 KB.  Iterates in ascending order."""

    def __init__(self, bits: bytes = b""):
        self.bits = bytes(bits).rstrip(b"\0")

    @classmethod
    def of(cls, codes: Iterable[int]) -> Codes:
        at = np.fromiter(codes, np.int64)
        own = np.zeros(int(at.max(initial=-1)) + 1, bool)
        own[at] = True
        return cls(np.packbits(own, bitorder="little").tobytes())

    @classmethod
    def of_parts(cls, parts: Iterable[tuple[int, bytes]]) -> Codes:
        """From pieces of the bits and the byte each begins at."""
        parts = [(at, bytes(b)) for at, b in parts]
        out = bytearray(max((at + len(b) for at, b in parts), default=0))
        for at, b in parts:
            out[at:at + len(b)] = b
        return cls(bytes(out))

    def __iter__(self) -> Iterator[int]:
        return iter(np.flatnonzero(np.unpackbits(np.frombuffer(self.bits, np.uint8), bitorder="little")).tolist())

    def __contains__(self, code: int) -> bool:
        return 0 <= code < 8 * len(self.bits) and bool(self.bits[code >> 3] >> (code & 7) & 1)

    def __len__(self) -> int:
        return int.from_bytes(self.bits, "little").bit_count()

    def __eq__(self, other) -> bool:
        return isinstance(other, Codes) and self.bits == other.bits

    def __hash__(self) -> int:
        return hash(self.bits)

    def __repr__(self) -> str:
        return f"Codes({len(self)} codes)"


@dataclass
class Split:
    feature: int
    categorical: bool
    threshold: int = 0                  # numeric: bin <= threshold goes left
    left: Codes | tuple[int, ...] = ()  # categorical: codes going left
    gain: float = 0.0
    missing_left: bool = False          # numeric: the side of missing values, chosen by gain


@dataclass
class Tree:
    """Splits and leaf values by heap id: the root is 1, the children of n are 2n and 2n + 1."""

    splits: dict[int, Split] = field(default_factory=dict)
    leaves: dict[int, float] = field(default_factory=dict)


@dataclass
class Binning:
    features: list[str]
    categorical: list[bool]
    cuts: list[list[float]]             # numeric cut points (empty for categorical)
    n_bins: list[int]                   # bins including the missing bin (last)

    def bin_col(self, i: int) -> str:
        return f"__bin{i}"

    @property
    def bin_cols(self) -> list[str]:
        return [self.bin_col(i) for i in range(len(self.features))]

    def missing_bin(self, i: int) -> int:
        return self.n_bins[i] - 1


def apply_bins(df: DataFrame, binning: Binning) -> DataFrame:
    """Adds ``__bin<i>`` integer columns; missing/unknown -> last bin."""
    num = [i for i, c in enumerate(binning.categorical) if not c]
    if num:
        tmp = [f"__raw{i}" for i in num]
        df = df.select("*", *[F.col(binning.features[i]).cast("double").alias(t)
                              for i, t in zip(num, tmp)])
        bz = Bucketizer(splitsArray=[[float("-inf"), *binning.cuts[i], float("inf")] for i in num],
                        inputCols=tmp, outputCols=[f"__bk{i}" for i in num], handleInvalid="keep")
        df = bz.transform(df).drop(*tmp)
    for i, f in enumerate(binning.features):
        miss = F.lit(binning.missing_bin(i))
        if binning.categorical[i]:
            v = F.col(f).cast("int")
            b = F.when(v.isNull() | (v < 0) | (v >= miss), miss).otherwise(v)
        else:
            v = F.col(f"__bk{i}")
            b = F.when(v.isNull() | (v >= miss), miss).otherwise(v.cast("int"))
        df = df.withColumn(binning.bin_col(i), b.cast("int"))
    return df.drop(*[f"__bk{i}" for i in num])


class Nodes:
    """Trees of one model as arrays.  Leaves point to themselves, so every row may take ``depth`` steps."""

    def __init__(self, trees: Sequence[Tree], binning: Binning):
        self.missing = np.array([binning.missing_bin(i) for i in range(len(binning.features))] or [0], np.int64)
        feature, threshold, lost, cats, left, right, value, heap, roots, bits = [], [], [], [], [], [], [], [], [], []
        used, self.depth = 0, 0
        for tree in trees:
            ids = sorted(_reachable(tree))
            at = {n: len(heap) + i for i, n in enumerate(ids)}
            roots.append(at[1])
            for n in ids:
                s = tree.splits.get(n)
                heap.append(n)
                feature.append(s.feature if s else 0)
                threshold.append(s.threshold if s and not s.categorical else -1)
                lost.append(bool(s and s.missing_left))
                left.append(at[2 * n] if s else at[n])
                right.append(at[2 * n + 1] if s else at[n])
                value.append(0.0 if s else tree.leaves.get(n, 0.0))
                cats.append(-1)
                if s:
                    self.depth = max(self.depth, n.bit_length())
                if s and s.categorical:
                    cats[-1] = 8 * used
                    own = s.left if isinstance(s.left, Codes) else Codes.of(s.left)
                    own = own.bits.ljust(-(-binning.n_bins[s.feature] // 8), b"\0")
                    bits.append(own)
                    used += len(own)
        self.feature, self.left, self.right, self.roots = (np.array(x, np.int32) for x in (feature, left, right, roots))
        self.threshold, self.cats, self.heap = (np.array(x, np.int64) for x in (threshold, cats, heap))
        self.lost, self.value = np.array(lost, bool), np.array(value, float)
        self.bits = np.frombuffer(b"".join(bits), np.uint8)

    def descend(self, bins: np.ndarray) -> np.ndarray:
        """(rows, trees): the leaf each row of ``bins`` (rows, features) reaches."""
        at = np.repeat(self.roots[None, :], len(bins), axis=0)
        rows = np.arange(len(bins))[:, None]
        for _ in range(self.depth):
            f = self.feature[at]
            b = bins[rows, f]
            goes = (b <= self.threshold[at]) | (self.lost[at] & (b == self.missing[f]))
            if len(self.bits):
                c = self.cats[at]
                own = c >= 0
                place = c[own] + b[own]
                goes[own] = self.bits[place >> 3] >> (place & 7) & 1
            at = np.where(goes, self.left[at], self.right[at])
        return at

    def score(self, bins: np.ndarray, cells: int = 1 << 19) -> np.ndarray:
        """Sum of the leaf values, for as many rows at a time as make ``cells`` (row, tree) pairs."""
        out = np.zeros(len(bins))
        if not len(self.roots):
            return out
        step = max(1, cells // len(self.roots))
        for lo in range(0, len(bins), step):
            out[lo:lo + step] = self.value[self.descend(bins[lo:lo + step])].sum(axis=1)
        return out


def _reachable(tree: Tree) -> list[int]:
    out, todo = [], [1]
    while todo:
        n = todo.pop()
        out.append(n)
        if n in tree.splits:
            todo += [2 * n, 2 * n + 1]
    return out


NODES = ("model int, tree int, node long, feature string, bin int, threshold double, missing_left boolean, "
         "left_codes array<int>, value double")
FEATURES = "pos int, feature string, categorical boolean, cuts array<double>, n_bins int"
MODELS = "model int, base double, objective string"


@dataclass
class Forest:
    """Fitted ensembles: bins, and for each model a start value and its trees."""

    binning: Binning
    objective: str
    base: list[float]
    trees: list[list[Tree]]

    # ------------------------------------------------------------------ as tables
    def nodes(self, spark: SparkSession) -> DataFrame:
        """A row per node: ``value`` of leaves; ``feature`` and ``bin`` (``threshold``: smaller values go left) or
        ``left_codes`` of splits."""
        rows = []
        b = self.binning
        for m, trees in enumerate(self.trees):
            for t, tree in enumerate(trees):
                for n in sorted(_reachable(tree)):
                    s = tree.splits.get(n)
                    if s is None:
                        rows.append((m, t, n, None, None, None, None, None, float(tree.leaves.get(n, 0.0))))
                    elif s.categorical:
                        rows.append((m, t, n, b.features[s.feature], None, None, False, [int(x) for x in s.left], None))
                    else:
                        cuts = b.cuts[s.feature]
                        rows.append((m, t, n, b.features[s.feature], s.threshold,
                                     float(cuts[s.threshold]) if s.threshold < len(cuts) else None, s.missing_left, None, None))
        return spark.createDataFrame(rows, NODES)

    def save(self, spark: SparkSession, path: str) -> None:
        """Three Parquet tables below ``path``: nodes, features, models."""
        b = self.binning
        self.nodes(spark).coalesce(1).write.parquet(f"{path}/nodes")
        spark.createDataFrame([(i, f, b.categorical[i], [float(x) for x in b.cuts[i]], b.n_bins[i]) for i, f in enumerate(b.features)],
                              FEATURES).coalesce(1).write.parquet(f"{path}/features")
        spark.createDataFrame([(m, float(x), self.objective) for m, x in enumerate(self.base)], MODELS
                              ).coalesce(1).write.parquet(f"{path}/models")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Forest:
        """The saved model; its nodes, a number that training bounds, come to the driver."""
        return cls.from_tables(*(spark.read.parquet(f"{path}/{t}") for t in ("nodes", "features", "models")))

    @classmethod
    def from_tables(cls, nodes: DataFrame, features: DataFrame, models: DataFrame) -> Forest:
        fs = sorted(features.collect(), key=lambda r: r["pos"])
        binning = Binning([r["feature"] for r in fs], [r["categorical"] for r in fs], [list(r["cuts"]) for r in fs],
                          [r["n_bins"] for r in fs])
        ms = sorted(models.collect(), key=lambda r: r["model"])
        pos = {f: i for i, f in enumerate(binning.features)}
        trees: list[dict[int, Tree]] = [{} for _ in ms]
        for r in nodes.toLocalIterator():
            tree = trees[r["model"]].setdefault(r["tree"], Tree())
            if r["feature"] is None:
                tree.leaves[r["node"]] = r["value"]
            else:
                i = pos[r["feature"]]
                tree.splits[r["node"]] = (Split(i, True, left=tuple(r["left_codes"])) if binning.categorical[i]
                                          else Split(i, False, r["bin"], missing_left=r["missing_left"]))
        return cls(binning, ms[0]["objective"] if ms else "squared", [r["base"] for r in ms],
                   [[t[i] for i in sorted(t)] for t in trees])

    # ------------------------------------------------------------------ scoring
    def margin(self, model: int) -> Column:
        """Start value plus all trees of ``model`` over ``__bin`` columns."""
        nodes, base = Nodes(self.trees[model], self.binning), float(self.base[model])

        @F.pandas_udf("double")
        def run(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for cols in parts:
                cols = cols if isinstance(cols, tuple) else (cols,)         # one feature comes as it is
                bins = np.column_stack([c.to_numpy(np.int64) for c in cols])
                yield pd.Series(base + nodes.score(bins))
        return run(*[F.col(c) for c in self.binning.bin_cols])

    def prediction(self, model: int) -> Column:
        z = self.margin(model)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z)) if self.objective == "logistic" else z

    def score(self, df: DataFrame, model: int = 0, out_col: str = "pred") -> DataFrame:
        """``df`` (batch or stream, raw features) with the prediction of ``model``."""
        binned = apply_bins(df, self.binning)
        return binned.withColumn(out_col, self.prediction(model)).drop(*self.binning.bin_cols)
