"""Gradient-boosted trees as Spark jobs.

Data-parallel histogram boosting of several models at once:

* **T5 bins** -- exact, rank-defined cut points of all features (``max_bins`` per feature), bins by a JVM
  ``Bucketizer``; missing values get their own last bin and go to the side with the larger gain.
* **Cells** -- rows of equal bins are the same to every tree, so they are added up once: a cell has, for each model, number and
  mean label of the rows it learns from and of those it is judged by (of these also the sum of squared deviations), which give
  gradients, hessians and losses exactly.  There are at most ``product of bins`` of them (times the owners of replicated rows) however
  many rows; where they would be more than half the rows, each row is its own cell.
  Under row sampling the sampled rows of each tree are added up in one pass.
* **Histograms** -- the cross-validation models (``fold <> o``) and a full refit train *together*: one pass over the
  cached cells sums gradient, hessian and count of all models and all nodes asked for.  A task walks its cells down the
  trees grown since the last refresh (arrays, see ``forest.Nodes``), adds them up in arrays and emits a row per filled cell,
  so what is shuffled is bounded by tasks x models x nodes x features x bins, never by rows.  Where both children of a
  split are asked for, only the rows of the smaller one are added; the sibling is the parent's histogram, kept for the
  tree, minus that.
* **T6 split search** -- running sums over the histogram table on the executors (``splits.best_splits``); only the splits
  reach the driver.  Soft threshold ``T(G)=sign(G)max(|G|-alpha,0)``, gain
  ``1/2[T(GL)^2/(HL+lambda) + T(GR)^2/(HR+lambda) - T(G)^2/(H+lambda)] - gamma``, leaf ``-T(G)/(H+lambda)`` times the rate.
* **T1/T2 growth** -- depth-wise; leaf-wise under ``max_leaves``: best first, a pass evaluates the children of all
  splits that the queue would take so far, until none of them is unknown, which gives the splits of one-by-one growth in about as
  many passes as the tree is deep; symmetric: one split for all nodes of a level.
* **T7 categorical splits** -- categories ordered by ``G/(H+lambda)`` inside each node, the best prefix goes left.
* **T3 early stopping** -- on the model's validation rows, or on an inner hold-out of its training rows
  (``validation_fraction``), chosen by a hash; best-iteration scores are kept.
* **T4 sampling** -- rows by a hash of (seed, tree, model, id), features per tree.
* Margins of cells live in one cached table, written to the shared folder every ``checkpoint_every`` trees; the copy before is
  deleted, so a lost executor recomputes at most that many trees' margins.  ``BoostResult.close`` releases what is left.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import delete_path, materialise, scratch_path
from .forest import Binning, Codes, Forest, Nodes, Split, Tree, apply_bins
from .splits import best_level_splits, best_splits, dlit

__all__ = ["Binning", "BoostParams", "BoostResult", "Forest", "ModelSpec", "Split", "Tree", "apply_bins", "best_splits", "cv_specs",
           "fit_bins", "fit_boosted", "fold_test_predictions", "gradient_histogram", "oof_predictions", "quantile_bin", "quantile_cuts"]

#: Heap ids of nodes are 64-bit integers.
DEEPEST = 60
#: A task of a pass has about that many cells at least: its start costs as much as some ten thousand.
TASK_CELLS = 1 << 14
#: A task keeps sums of that many (model, node, feature, bin) at most; it sends those of wider features batch by batch.
HELD_CELLS = 1 << 21


@dataclass
class BoostParams:
    objective: str = "squared"          # "squared" (T1) | "logistic" (T2)
    n_trees: int = 100
    learning_rate: float = 0.1
    max_depth: int = 4                  # at most DEEPEST; smaller than 1: no limit but that
    max_leaves: int | None = None       # leaf-wise growth: at most that many leaves, best split first
    symmetric: bool = False             # one split for all nodes of a level; min_child_* don't apply
    reg_alpha: float = 0.0
    reg_lambda: float = 1.0
    gamma: float = 0.0
    min_child_weight: float = 1e-3
    min_child_samples: int = 1
    subsample: float = 1.0
    colsample_bytree: float = 1.0
    max_bins: int = 64
    early_stopping: int | None = None
    validation_fraction: float = 0.0    # share of a model's training rows held out for early stopping
    seed: int = 42
    # passes that add up at least so many (row, feature) cells keep their histograms, and of two children only the smaller is
    # added up, the sibling by subtraction; below that the kept table and its join cost more than the cells they spare
    subtract_from: int = 20_000_000
    # trees between refreshes of the cached margins, which are then written to the shared folder
    checkpoint_every: int = 10

    @property
    def depth_limit(self) -> int:
        return self.max_depth if 0 < self.max_depth <= DEEPEST else DEEPEST


# --------------------------------------------------------------------------- T5
def quantile_cuts(df: DataFrame, cols: Sequence[str], max_bins: int) -> list[list[float]]:
    """Exact cut points: value ``v`` is a cut if some ``i * n / max_bins``, 0 < i < max_bins, lies in (rows
    below v, rows up to v].

    The distinct values of all columns, counted with map-side combine, are sorted by ranges; ranks are running
    counts inside a range plus the counts of the ranges before.  At most ``columns * max_bins`` rows reach the driver.
    """
    if not cols:
        return []
    cells = F.array(*[F.struct(F.lit(i).alias("feat"), F.col(c).cast("double").alias("v")) for i, c in enumerate(cols)])
    counts = (df.select(F.explode(cells).alias("e")).select("e.*").where("v IS NOT NULL AND NOT isnan(v)")
              .groupBy("feat", "v").agg(F.count(F.lit(1)).alias("n")))
    # written, so that both reads below see the same ranges
    counts = materialise(counts.repartitionByRange("feat", "v").withColumn("part", F.spark_partition_id()), "cuts")
    parts = counts.groupBy("feat", "part").agg(F.sum("n").alias("pn"))
    one = Window.partitionBy("feat")
    parts = parts.select("feat", "part", F.coalesce(F.sum("pn").over(
        one.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("off"), F.sum("pn").over(one).alias("total"))
    upto = Window.partitionBy("feat", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("r", F.sum("n").over(upto)).join(parts, ["feat", "part"])
    step = lambda c: F.expr(f"CAST(({c}) * {max_bins} AS BIGINT) div total")
    rows = ranked.where(F.least(step("off + r"), F.lit(max_bins - 1)) > step("off + r - n")).select("feat", "v").collect()
    return [sorted(r["v"] for r in rows if r["feat"] == i) for i in range(len(cols))]


def fit_bins(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = (),
             max_bins: int = 64) -> Binning:
    """Exact quantile cut points of every numeric feature; category counts of the others."""
    numeric, categorical = list(numeric), list(categorical)
    cuts = quantile_cuts(df, numeric, max_bins)
    top = df.agg(*[F.max(F.col(c)).alias(f"k{i}") for i, c in enumerate(categorical)]).first() if categorical else None
    sizes = [len(c) + 2 for c in cuts] + [int(top[f"k{i}"] or 0) + 2 for i in range(len(categorical))]
    return Binning([*numeric, *categorical], [False] * len(numeric) + [True] * len(categorical),
                   cuts + [[] for _ in categorical], sizes)


def quantile_bin(df: DataFrame, cols: Sequence[str], max_bins: int = 64) -> DataFrame:
    """T5 as a user operator: ``<col>_bin`` for each column."""
    b = fit_bins(df, cols, (), max_bins)
    out = apply_bins(df, b)
    for i, c in enumerate(cols):
        out = out.withColumnRenamed(b.bin_col(i), f"{c}_bin")
    return out

# --------------------------------------------------------------------------- models
@dataclass
class ModelSpec:
    name: str
    train: Column                       # rows the model learns from
    valid: Column | None = None         # rows for early stopping / OOF


@dataclass
class BoostResult:
    params: BoostParams
    binning: Binning
    specs: list[ModelSpec]
    base: list[float]
    trees: list[list[Tree]]
    best_iter: list[int]
    valid_loss: list[list[float]]
    state: DataFrame                    # rows with __F<m> (last) and __B<m> (best) margins
    owned: bool = False                 # one margin pair (__F, __B) per row, of its owner model
    held: list = field(default_factory=list)   # cached tables and scratch folders under ``state``
    rows: Callable[[Column], DataFrame] | None = None   # the rows of ``state`` that a condition keeps; no others are scored

    def close(self) -> None:
        """Release what ``state`` reads; call it when its predictions have been written."""
        for x in self.held:
            x.unpersist() if isinstance(x, DataFrame) else delete_path(self.state.sparkSession, x)
        self.held = []

    def margin_col(self, m: int) -> str:
        return "__B" if self.owned else f"__B{m}"

    def prediction(self, m: int) -> Column:
        """Best-iteration prediction of model ``m`` (probability for logistic) over ``state``."""
        z = F.col(self.margin_col(m))
        if self.params.objective == "logistic":
            return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
        return z

    def forest(self) -> Forest:
        """The models (best iterations) as data, for other rows and for streams."""
        return Forest(self.binning, self.params.objective, list(self.base),
                      [t[:b] for t, b in zip(self.trees, self.best_iter)])


def tree_features(p: BoostParams, n: int, tree: int, model: int) -> list[int]:
    """T4: the features a tree may split on, whatever other models are still growing."""
    if p.colsample_bytree >= 1.0:
        return list(range(n))
    kk = max(1, int(round(n * p.colsample_bytree)))
    return sorted(np.random.RandomState([p.seed, tree, model]).choice(n, kk, replace=False).tolist())


def bag_sql(seed: int, tree: int | str, model: int, id_col: str, share: float) -> str:
    """T4: whether a row's number in [0, 1) for that tree and model (``tree`` "hold": the inner hold-out, T3) is below ``share``.

    The number is the first 8 hexadecimal digits of an MD5 over 2**32; digits of one length compare as text.
    """
    least = min(max(math.ceil(share * 2.0 ** 32), 0), 1 << 32)
    return (f"(md5(concat('bag|{seed}|{tree}|{model}', coalesce(concat('|', CAST(`{id_col}` AS STRING)), ''))) < "
            f"'{'g' if least >> 32 else format(least, '08x')}')")


def leaf_weight(G: float, H: float, p: BoostParams) -> float:
    soft = np.sign(G) * max(abs(G) - p.reg_alpha, 0.0)
    return float(-soft / (H + p.reg_lambda)) if H + p.reg_lambda else 0.0


def gradients(objective: str, z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if objective == "squared":
        return z - y, np.ones(len(z))
    if objective == "logistic":
        with np.errstate(over="ignore"):
            pr = 1.0 / (1.0 + np.exp(-z))
        return pr - y, pr * (1.0 - pr)
    raise ValueError(f"unknown objective {objective!r}")


def row_loss(objective: str, z: np.ndarray, y: np.ndarray) -> np.ndarray:
    if objective == "squared":
        return (z - y) ** 2
    return np.maximum(z, 0.0) + np.log1p(np.exp(-np.abs(z))) - y * z       # log(1 + e^z) - y z


# --------------------------------------------------------------------------- histograms
HIST = "model int, node long, feat int, bin int, G double, H double, C long"


def gradient_histogram(df: DataFrame, g: str, h: str, by: Sequence[str], binning: Binning) -> DataFrame:
    """Sums of gradient and hessian (SQL text) and rows per ``(*by, feat, bin)`` of a binned table, in DataFrame operations."""
    cells = ", ".join(f"named_struct('feat', {i}, 'bin', {binning.bin_col(i)})" for i in range(len(binning.features)))
    flat = df.selectExpr(*by, f"{g} AS __g", f"{h} AS __h", f"explode(array({cells})) AS e")
    return flat.groupBy(*by, F.col("e.feat").alias("feat"), F.col("e.bin").alias("bin")).agg(
        F.sum("__g").alias("G"), F.sum("__h").alias("H"), F.count(F.lit(1)).alias("C"))


@dataclass
class _Ask:
    """What one model wants from a pass."""

    model: int
    margin: str                          # margin column of the last refresh
    grown: Nodes                         # trees since then
    flag: str                            # column of the cells it learns from,
    count: str                           # of their rows
    label: str                           # and of the mean label of these
    judge: tuple[str, str, str, str]     # the same for cells it is judged by, and what their labels differ from the mean
    tree: Nodes | None = None            # the tree that grows
    nodes: list[int] = field(default_factory=list)      # whose rows are added up
    sibling: list[int] = field(default_factory=list)    # node to subtract them from, or 0
    feats: list[int] = field(default_factory=list)
    loss: bool = False


def _histogram_task(asks: list[_Ask], bin_cols: list[str], n_bins: list[int], objective: str, dense: bool, cells: int):
    """Function over Arrow batches: a row per filled cell and, for losses, ``node = feat = bin = -1`` (sum, rows, rows).

    Cells are summed in arrays over the task's batches, of the narrowest features first, while at most ``cells`` are needed; of
    the other features each batch's filled cells are emitted.
    """
    held, need = set(), 0
    for size, i, f in sorted((len(a.nodes) * n_bins[f], i, f) for i, a in enumerate(asks) for f in a.feats):
        need += size
        if need <= cells:
            held.add((i, f))

    def emit(ask: _Ask, feat: int, key, G, H, C):
        nb = n_bins[feat]
        slot, b = key // nb, key % nb
        node, other = np.array(ask.nodes, np.int64)[slot], np.array(ask.sibling, np.int64)[slot]
        sub = other > 0
        join = lambda a, x: np.concatenate([a, x])
        return pa.RecordBatch.from_arrays([
            pa.array(np.full(len(key) + sub.sum(), ask.model, np.int32)), pa.array(join(node, other[sub])),
            pa.array(np.full(len(key) + sub.sum(), feat, np.int32)), pa.array(join(b, b[sub]).astype(np.int32)),
            pa.array(join(G, -G[sub])), pa.array(join(H, -H[sub])), pa.array(join(C, -C[sub]).astype(np.int64))], names=HIST_NAMES)

    def run(batches):
        sums = {(i, f): [np.zeros(len(asks[i].nodes) * n_bins[f]) for _ in range(3)] for i, f in sorted(held)}
        losses = {i: [0.0, 0] for i, a in enumerate(asks) if a.loss}
        slot_of = []
        for a in asks:
            at = {n: i for i, n in enumerate(a.nodes)}
            slot_of.append(np.array([at.get(int(n), -1) for n in a.tree.heap], np.int64) if a.nodes else None)
        for b in batches:
            col = lambda c: b.column(c).to_numpy(zero_copy_only=False)
            bins = np.column_stack([col(c) for c in bin_cols])
            for i, a in enumerate(asks):
                for learns, flag, n_col, y_col in ((True, a.flag, a.count, a.label), (False, *a.judge[:3])):
                    if not (a.nodes if learns else a.loss):
                        continue
                    rows = np.flatnonzero(col(flag))
                    if not len(rows):
                        continue
                    x = bins[rows]
                    if learns:
                        slot = slot_of[i][a.tree.descend(x)[:, 0]]
                        here = slot >= 0
                        rows, x, slot = rows[here], x[here], slot[here]
                    z, y, n = col(a.margin)[rows] + a.grown.score(x), col(y_col)[rows], col(n_col)[rows].astype(float)
                    if not learns:
                        losses[i][0] += float((n * row_loss(objective, z, y)).sum())
                        if objective == "squared":          # what the labels of a cell differ from their mean
                            losses[i][0] += float(col(a.judge[3])[rows].sum())
                        losses[i][1] += int(n.sum())
                        continue
                    g, h = (n * x for x in gradients(objective, z, y))
                    for f in a.feats:
                        key = slot * n_bins[f] + x[:, f]
                        if (i, f) in held:
                            size = len(a.nodes) * n_bins[f]
                            for total, w in zip(sums[i, f], (g, h, n)):
                                total += np.bincount(key, w, size)
                        else:
                            u, inv = np.unique(key, return_inverse=True)
                            yield emit(a, f, u, *(np.bincount(inv, w, len(u)) for w in (g, h, n)))
        for (i, f), (G, H, C) in sums.items():
            at = np.arange(len(C)) if dense else np.flatnonzero(C)
            if len(at):
                yield emit(asks[i], f, at, G[at], H[at], C[at])
        if dense:      # zeros, so that every bin of every node has a row
            for i, a in enumerate(asks):
                for f in a.feats:
                    at = np.arange(len(a.nodes) * n_bins[f] if (i, f) not in held else 0)
                    if len(at):
                        yield emit(a, f, at, np.zeros(len(at)), np.zeros(len(at)), np.zeros(len(at)))
        for i, (total, n) in losses.items():
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(
                    (asks[i].model, -1, -1, -1, total, float(n), n), HIST_TYPES)], names=HIST_NAMES)
    return run


HIST_NAMES = [c.split()[0] for c in HIST.split(", ")]
HIST_TYPES = [{"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}[c.split()[1]] for c in HIST.split(", ")]


# --------------------------------------------------------------------------- growth
class Growth:
    """One growing tree: which nodes must be evaluated next, and the tree that the answers give."""

    def __init__(self, p: BoostParams):
        self.p, self.known, self.size = p, {}, {1: None}

    def _may_split(self, n: int) -> bool:
        if n.bit_length() > self.p.depth_limit:
            return False
        if self.p.symmetric or self.size[n] is None:
            return True
        _, h, c = self.size[n]
        return c >= 2 * max(1, self.p.min_child_samples) and h >= 2 * self.p.min_child_weight

    def learn(self, r) -> None:
        n = r["node"]
        self.known[n] = r
        self.size[n] = (r["G"], r["H"], r["C"])
        if r["feat"] is not None:
            self.size[2 * n] = (r["GL"], r["HL"], r["CL"])
            self.size[2 * n + 1] = (r["GR"], r["HR"], r["CR"])

    def select(self) -> tuple[list[int], list[int]]:
        """(nodes split, nodes to evaluate): the queue as far as it is known."""
        most = (self.p.max_leaves or (1 << 62)) - 1 if not self.p.symmetric else 1 << 62
        if 1 not in self.known:
            return [], [1]
        queue, taken, unknown = [], [], []

        def offer(n):
            if self._may_split(n):
                if n not in self.known:
                    unknown.append(n)
                elif self.known[n]["feat"] is not None:
                    heapq.heappush(queue, (-round(self.known[n]["gain"], 8), n))
        offer(1)
        while queue and len(taken) < most:
            _, n = heapq.heappop(queue)
            taken.append(n)
            if len(taken) < most:
                offer(2 * n)
                offer(2 * n + 1)
        return taken, unknown

    def tree(self, binning: Binning, rate: float = 1.0) -> Tree:
        t = Tree()
        taken, _ = self.select()
        for n in taken:
            r = self.known[n]
            f = r["feat"]
            cat = binning.categorical[f]
            left = (Codes.of if self.p.symmetric else Codes.of_parts)(r["left"]) if cat else ()
            t.splits[n] = Split(f, cat, int(r["bin"]), left, float(r["gain"]), bool(r["miss_left"]))
        for n in [1, *(c for s in taken for c in (2 * s, 2 * s + 1))]:
            if n not in t.splits and self.size[n] is not None:
                t.leaves[n] = leaf_weight(self.size[n][0], self.size[n][1], self.p) * rate
        return t


def _pass(view: DataFrame, asks: list[_Ask], kept: list[DataFrame], binning: Binning, p: BoostParams, persist: bool):
    """One pass: (answers, losses by model, histogram table)."""
    task = _histogram_task(asks, binning.bin_cols, binning.n_bins, p.objective, p.symmetric, HELD_CELLS)
    spark = view.sparkSession
    part = view.mapInArrow(task, HIST)
    rows, tables = "SELECT * FROM {part}", {"part": part}
    pairs = ", ".join(f"({a.model}, {n // 2}L, {o}L)" for a in asks for n, o in zip(a.nodes, a.sibling) if o)
    if pairs:       # parents' rows under the sibling's number; the task sends the smaller child's with minus
        wanted = f"(VALUES {pairs})"        # three numbers per split of this pass
        tables |= {f"kept{i}": k for i, k in enumerate(kept)}
        rows += "".join(f""" UNION ALL SELECT /*+ BROADCAST(w) */ k.model, w.sibling, feat, bin, G, H, C FROM {{kept{i}}} k
  JOIN {wanted} w(model, node, sibling) ON k.model = w.model AND k.node = w.node""" for i in range(len(kept)))
    hist = spark.sql(f"""SELECT model, node, feat, bin, sum(G) AS G, sum(H) AS H, sum(C) AS C
FROM (SELECT /*+ REPARTITION(model, node, feat) */ * FROM ({rows})) GROUP BY model, node, feat, bin {'' if p.symmetric else 'HAVING sum(C) > 0'}""", **tables)
    if persist:
        hist = hist.persist(StorageLevel.MEMORY_AND_DISK)
    rows = (best_level_splits if p.symmetric else best_splits)(hist, binning, p).collect()
    return [r for r in rows if r["node"] > 0], {r["model"]: (r["G"], r["H"]) for r in rows if r["node"] == -1}, hist


# --------------------------------------------------------------------------- trainer
def fit_boosted(df: DataFrame, features: Sequence[str], label_col: str, specs: Sequence[ModelSpec],
                params: BoostParams, categorical: Sequence[str] = (), id_col: str = "id",
                binning: Binning | None = None, keep_cols: Sequence[str] = (),
                disjoint: bool = False, owner: Column | None = None) -> BoostResult:
    """Train ``len(specs)`` boosted models over the rows of ``df`` in the same passes.

    ``df`` holds every row any model trains on, validates on or must score (e.g. train rows with a ``fold`` column plus
    test rows).  ``owner``: the one model whose margin a row needs (e.g. the outer fold of a replicated row); then each
    row keeps a single margin pair instead of one per model.  ``disjoint`` is implied by it and changes nothing else.  Passes per
    tree: one per level; the validation losses of the tree before ride along in the first.
    """
    p = params
    specs = list(specs)
    M = len(specs)
    numeric = [f for f in features if f not in set(categorical)]
    cats = [f for f in features if f in set(categorical)]
    fresh = binning is None
    if fresh:
        # the input is read by the bin fit and by the first state: compute it once
        df = df.persist(StorageLevel.MEMORY_AND_DISK)
        fit_rows = df.filter(specs[0].train) if M == 1 else df.filter(
            F.greatest(*[s.train.cast("int") for s in specs]) == 1)
        binning = fit_bins(fit_rows, numeric, cats, p.max_bins)
    nf = len(binning.features)
    y = F.col(label_col).cast("double")

    inner = p.validation_fraction > 0.0
    flags = []
    for m, s in enumerate(specs):
        learns, judged = F.coalesce(s.train, F.lit(False)), F.coalesce(s.valid, F.lit(False)) if s.valid is not None else F.lit(False)
        held = F.expr(bag_sql(p.seed, "hold", m, id_col, p.validation_fraction))
        flags += [(learns & ~held if inner else learns).alias(f"__T{m}"), (learns & held if inner else judged).alias(f"__S{m}"),
                  judged.alias(f"__V{m}")]
    base_df = apply_bins(df, binning).select(
        id_col, *keep_cols, y.alias("__y"), *[F.col(c) for c in binning.bin_cols], *flags,
        *([owner.cast("int").alias("__own")] if owner is not None else []))
    owned = owner is not None
    # rows of a value of the widest feature lie together where tasks can't keep its sums: a pass then sends a row per value, not
    # per row; the id cuts a value of many rows
    wide = binning.bin_col(max(range(nf), key=lambda i: binning.n_bins[i])) if M * max(binning.n_bins, default=0) > HELD_CELLS else None
    if wide:
        base_df = base_df.repartitionByRange(wide, id_col).sortWithinPartitions(wide)
    base_df = base_df.persist(StorageLevel.MEMORY_AND_DISK)

    keys = [*binning.bin_cols, *(["__own"] if owned else [])]
    used = F.expr(" OR ".join(f"__{x}{m}" for x in "TS" for m in range(M)))
    # base score per model (label mean on its training rows), number of cells: one aggregate
    row = base_df.agg(*[F.sum(F.when(F.col(f"__T{m}"), F.col("__y"))).alias(f"s{m}") for m in range(M)],
                      *[F.sum(F.col(f"__T{m}").cast("long")).alias(f"n{m}") for m in range(M)],
                      F.approx_count_distinct(F.when(used, F.xxhash64(*keys))).alias("cells"), F.count(F.when(used, 1)).alias("used"),
                      F.count(F.lit(1)).alias("rows")).first()
    base = []
    for m in range(M):
        mean = float(row[f"s{m}"] or 0.0) / max(int(row[f"n{m}"] or 0), 1)
        if p.objective == "logistic":
            mean = min(max(mean, 1e-12), 1 - 1e-12)
            base.append(float(np.log(mean / (1 - mean))))
        else:
            base.append(mean)
    train_rows = sum(int(row[f"n{m}"] or 0) for m in range(M))
    if fresh:
        df.unpersist()                 # base_df (filled by the aggregate above) replaces it
    if owned:
        init = "CASE __own " + " ".join(f"WHEN {m} THEN {dlit(base[m])}" for m in range(M)) + " END"
        margins = [f"{init} AS __F", f"{init} AS __B"]
    else:
        margins = [f"{dlit(base[m])} AS __{x}{m}" for x in "FB" for m in range(M)]
    # anchor: a cached table of cells with each model's margin after anc[m] trees; later trees are walked through by the tasks
    label = f"coalesce(__y, {dlit(float('nan'))})"
    grouped = 2 * int(row["cells"]) <= int(row["used"])
    tasks = -(-int(row["cells"] if grouped else row["rows"]) // TASK_CELLS) or 1
    shrink = int(row["cells"]) / int(row["used"]) if grouped else 1.0
    if grouped:
        # first rows that the same models use, then each model's cells of them: the rows are shuffled with few columns
        roles = [f"__{x}{m}" for x in "TS" for m in range(M)]
        parts = base_df.where(used).groupBy(*keys, *roles).agg(
            F.count(F.lit(1)).alias("__n"), F.expr(f"avg({label})").alias("__y"), F.expr(f"count(1) * var_pop({label})").alias("__q"))
        near = float(row["s0"] or 0.0) / max(int(row["n0"] or 0), 1)
        near = dlit(near if np.isfinite(near) else 0.0)     # squares are taken of labels less a number among them
        sums = []
        for m in range(M):
            for flag, n, mean in ((f"__T{m}", f"__n{m}", f"__y{m}"), (f"__S{m}", f"__w{m}", f"__v{m}")):
                sums += [F.expr(f"coalesce(sum(__n) FILTER (WHERE {flag}), 0L)").alias(n),
                         F.expr(f"{near} + (sum(__n * (__y - {near})) FILTER (WHERE {flag})) / (sum(__n) FILTER (WHERE {flag}))").alias(mean)]
            sums.append(F.expr(f"sum(__q + __n * (__y - {near}) * (__y - {near})) FILTER (WHERE __S{m})").alias(f"__q{m}"))
        cells_df = parts.groupBy(*keys).agg(*sums).selectExpr(
            *keys, *[f"__n{m} > 0 AS __T{m}" for m in range(M)], *[f"__w{m} > 0 AS __S{m}" for m in range(M)],
            *[f"__{x}{m}" for x in "nywv" for m in range(M)],
            *[f"greatest(__q{m} - __w{m} * (__v{m} - {near}) * (__v{m} - {near}), 0.0D) AS __q{m}" for m in range(M)])
        cells_df = cells_df.repartitionByRange(tasks, wide, *keys).sortWithinPartitions(wide) if wide else cells_df.repartition(tasks)
        anchor = anchor_src = cells_df.selectExpr("*", *margins).persist(StorageLevel.MEMORY_AND_DISK)
    else:
        anchor_src = base_df
        anchor = base_df.coalesce(tasks).selectExpr("*", "1L AS __n", "0.0D AS __q", *margins)
    anc = [0] * M
    every = max(1, p.checkpoint_every)
    written = None                     # folder of the last refresh

    trees: list[list[Tree]] = [[] for _ in range(M)]
    active = [True] * M
    best_iter = [0] * M
    best_loss = [np.inf] * M
    losses: list[list[float]] = [[] for _ in range(M)]
    has_valid = [s.valid is not None or inner for s in specs]

    def fcol(m: int) -> str:
        return "__F" if owned else f"__F{m}"

    def current(df: DataFrame, after: list[int]) -> DataFrame:
        """``df``, whose margins are those after so many trees, with last and best margins."""
        last = [Nodes(trees[m][after[m]:], binning) for m in range(M)]
        best = [None if best_iter[m] < after[m] else last[m] if best_iter[m] == len(trees[m])
                else Nodes(trees[m][after[m]:best_iter[m]], binning) for m in range(M)]
        bin_cols, schema = binning.bin_cols, df.schema

        def run(batches):
            for b in batches:
                col = lambda c: b.column(c).to_numpy(zero_copy_only=False)
                bins, new = np.column_stack([col(c) for c in bin_cols]), {}
                if owned:
                    own, f, best_f = col("__own"), col("__F").astype(float), col("__B").astype(float)
                    for m in range(M):
                        rows = np.flatnonzero(own == m)
                        if len(rows):
                            now = f[rows] + last[m].score(bins[rows])
                            if best[m] is not None:
                                best_f[rows] = now if best[m] is last[m] else f[rows] + best[m].score(bins[rows])
                            f[rows] = now
                    new = {"__F": f, "__B": best_f}
                else:
                    for m in range(M):
                        f = col(f"__F{m}")
                        new[f"__F{m}"] = f + last[m].score(bins)
                        if best[m] is not None:
                            new[f"__B{m}"] = new[f"__F{m}"] if best[m] is last[m] else f + best[m].score(bins)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(new[n]) if n in new else c for n, c in zip(b.schema.names, b.columns)], names=b.schema.names)
        return df.mapInArrow(run, schema)

    def sampled(t: int, models: Sequence[int]) -> DataFrame:
        """T4: the cells with number and mean label of the rows that tree ``t`` of each model learns from."""
        flags = base_df.where(used).selectExpr(*keys, f"{label} AS __y", *[bag(t, m) for m in models])
        own = flags.groupBy(*keys).agg(*[F.expr(f"count_if(__G{m})").alias(f"__n{m}_") for m in models],
                                       *[F.expr(f"avg(CASE WHEN __G{m} THEN __y END)").alias(f"__y{m}_") for m in models])
        own = own.select(*[F.col(c).alias(f"{c}_") for c in keys], *[f"__{x}{m}_" for x in "ny" for m in models])
        same = [F.col(c).eqNullSafe(F.col(f"{c}_")) if c == "__own" else F.col(c) == F.col(f"{c}_") for c in keys]
        return anchor.join(own, same, "left").selectExpr(*anchor.columns, *[f"__{x}{m}_" for x in "ny" for m in models],
                                                         *[f"coalesce(__n{m}_, 0L) > 0 AS __G{m}" for m in models])

    def bag(t: int, m: int) -> str:
        return f"__T{m} AND {bag_sql(p.seed, t, m, id_col, p.subsample)} AS __G{m}"

    t = 0
    while True:
        live = [m for m in range(M) if active[m]]
        growing = t < p.n_trees and bool(live)
        grow = {m: Growth(p) for m in live} if growing else {}
        feats_of = {m: tree_features(p, nf, t, m) for m in grow}
        judged = [m for m in live if has_valid[m]]
        flag, tree_src = {m: f"__T{m}" for m in live}, None
        of = {m: (f"__n{m}", f"__y{m}") if grouped else ("__n", "__y") for m in live}
        judge = {m: (f"__S{m}", f"__w{m}", f"__v{m}", f"__q{m}") if grouped else (f"__S{m}", "__n", "__y", "__q") for m in live}
        if p.subsample < 1.0 and grow:
            flag = {m: f"__G{m}" for m in live}
            if grouped:
                of = {m: (f"__n{m}_", f"__y{m}_") for m in live}
                tree_src = sampled(t, live)
            else:
                tree_src = anchor.selectExpr("*", *[bag(t, m) for m in live])
            tree_src = tree_src.persist(StorageLevel.MEMORY_AND_DISK)
        since = {m: Nodes(trees[m][anc[m]:], binning) for m in live}
        kept: list[DataFrame | None] = []
        at: dict[tuple[int, int], int] = {}
        first = True
        while True:
            asks = []
            for m, g in grow.items():
                _, unknown = g.select()
                ask = _Ask(m, fcol(m), since[m], flag[m], *of[m], judge[m], loss=first and m in judged)
                if unknown:
                    ask.tree, ask.feats = Nodes([g.tree(binning)], binning), feats_of[m]
                    todo = set(unknown)
                    for n in unknown:
                        other = n ^ 1
                        if n == 1 or other not in todo or kept[at[m, n // 2]] is None:
                            ask.nodes.append(n)
                            ask.sibling.append(0)
                        elif (g.size[n][2], n) < (g.size[other][2], other):       # the smaller of two
                            ask.nodes.append(n)
                            ask.sibling.append(other)
                if unknown or ask.loss:
                    asks.append(ask)
            if first and not grow:
                asks = [_Ask(m, fcol(m), since[m], flag[m], *of[m], judge[m], loss=True) for m in judged]
            if not asks:
                break
            need = {a.margin for a in asks} | {c for a in asks if a.nodes for c in (a.flag, a.count, a.label)}
            need |= {c for a in asks if a.loss for c in a.judge}
            view = (tree_src or anchor).select(*binning.bin_cols, *sorted(need))
            # parents' tables, by round; a round whose children can't be split needs no keeping
            rounds = sorted({at[a.model, n // 2] for a in asks for n, o in zip(a.nodes, a.sibling) if o})
            work = [g.size[n] for m, g in grow.items() for n in g.select()[1]]
            rows = None if None in work else sum(c for _, _, c in work)
            cells = shrink * (train_rows if rows is None else rows) * max((len(f) for f in feats_of.values()), default=0)
            further = cells >= p.subtract_from and any(n.bit_length() < p.depth_limit for a in asks for n in a.nodes)
            answers, told, hist = _pass(view, asks, [kept[i] for i in rounds], binning, p, persist=further)
            at |= {(r["model"], r["node"]): len(kept) for r in answers}
            kept.append(hist if further else None)
            for r in answers:
                if r["model"] in grow:
                    grow[r["model"]].learn(r)
            if first:
                first = False
                for m in live:          # bookkeeping for the t trees built so far
                    if has_valid[m]:
                        total, n = told.get(m, (0.0, 0.0))
                        loss = total / n if n else np.inf
                        losses[m].append(loss)
                        if loss < best_loss[m] - 1e-15:
                            best_loss[m], best_iter[m] = loss, len(trees[m])
                        elif p.early_stopping and len(trees[m]) - best_iter[m] >= p.early_stopping:
                            active[m] = False
                            grow.pop(m, None)
                    else:
                        best_iter[m] = len(trees[m])
                # a model without training rows keeps its start value
                for m in [m for m, g in grow.items() if 1 not in g.known]:
                    active[m] = False
                    del grow[m]
            if not grow:
                break
        for k in (*kept, tree_src):
            if k is not None:
                k.unpersist()
        if not grow:
            break
        for m, g in grow.items():
            trees[m].append(g.tree(binning, p.learning_rate))
        t += 1
        if t % every == 0:
            # the margins go to the shared folder; the refresh before is deleted once this one is complete
            folder = scratch_path(df.sparkSession, "boost")
            nxt = current(anchor, anc)
            schema = nxt.schema
            nxt.write.parquet(folder)
            anchor_src.unpersist()
            if written:
                delete_path(df.sparkSession, written)
            written = folder
            anchor = anchor_src = df.sparkSession.read.schema(schema).parquet(folder).persist(StorageLevel.MEMORY_AND_DISK)
            anc = [len(trees[m]) for m in range(M)]
    for m in range(M):
        if not has_valid[m]:           # a refit keeps all its trees
            best_iter[m] = len(trees[m])
    if grouped:
        anchor_src.unpersist()
        if written:
            delete_path(df.sparkSession, written)
        src, after, held = base_df.selectExpr("*", *margins), [0] * M, [base_df]
    else:
        src, after, held = anchor, anc, [anchor_src, *([written] if written else [])]

    def rows_where(where: Column) -> DataFrame:
        return current(src.where(where), after).drop("__n", "__q")
    return BoostResult(p, binning, specs, base, trees, best_iter, losses, rows_where(F.lit(True)), owned, held, rows_where)


# --------------------------------------------------------------------------- CV conveniences (K5-K7)
def cv_specs(k: int, fold_col: str = "fold", role_col: str | None = None, refit: bool = False):
    """One spec per outer fold (train ``fold <> o``, validate ``fold = o``) and an optional refit."""
    is_train = F.col(role_col) == "train" if role_col else F.lit(True)
    specs = [ModelSpec(f"fold{o}", is_train & (F.col(fold_col) != o), is_train & (F.col(fold_col) == o))
             for o in range(k)]
    if refit:
        specs.append(ModelSpec("all", is_train, None))
    return specs


def oof_expr(res: BoostResult, k: int) -> Column:
    """The prediction of the fold model that did not see the row; null for rows of no fold."""
    e = F.when(F.col("__V0"), res.prediction(0))
    for o in range(1, k):
        e = e.when(F.col(f"__V{o}"), res.prediction(o))
    return e


def oof_predictions(res: BoostResult, k: int, fold_col: str = "fold", id_col: str = "id",
                    pred_col: str = "pred") -> DataFrame:
    """K5: each train row scored by the model that did not see its fold."""
    out = res.rows(F.greatest(*[F.col(f"__V{o}").cast("int") for o in range(k)]) == 1)
    extra = [fold_col] if fold_col in out.columns else []
    return out.select(id_col, *extra, F.col("__y").alias("y"), oof_expr(res, k).alias(pred_col))


def fold_test_predictions(res: BoostResult, k: int, test_flag: Column, id_col: str = "id",
                          pred_col: str = "pred") -> DataFrame:
    """K6: every fold model scores every test row -> ``(id, fold, pred)``."""
    st = res.rows(test_flag)
    arr = F.array(*[F.struct(F.lit(o).alias("fold"), res.prediction(o).alias(pred_col)) for o in range(k)])
    return st.select(id_col, F.explode(arr).alias("e")).select(id_col, "e.fold", f"e.{pred_col}")
