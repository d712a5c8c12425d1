"""Approximate nearest neighbours over balanced posting lists.

Fit: at most ``fit_rows`` vectors (a documented bound, first by hash of the id) go to the driver, which splits them into
halves of equal size until ``lists`` leaves remain and moves the leaf means by a few size-penalised
k-means steps.  The centroids, at most ``max_lists``, get a neighbour graph and are shipped to the tasks.

Index: every vector is put into the list of its nearest centroid and, near a boundary, into further lists
whose centroid is at most ``copy_ratio`` times as far, up to ``copies``.  Lists longer than
``max_list`` are cut into pieces by hash; all pieces of a list are searched.

Search: a query walks the graph from fixed entry points and expands whatever lies within ``probe_ratio`` times its nearest
centroid; those lists are searched.  Where they hold no more than ``spare * k`` vectors, the ratio starts from the nearest
list with which there are more.  Distances
are exact, in double precision, from the original vectors: matrix products preselect, with a margin beyond their error.

Results: vectors that are null, zero or hold null or non-finite components, rows without id, and vectors whose
length is not the most frequent one take no part; rows that share the query's id are its own; ties go to the
smaller id; repeated rows count once per id; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldframe.llm.common import Scratch, table
from foldframe.llm.vectors import valid_rows


def _square(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a ** 2).sum(1)[:, None] - 2 * a @ b.T + (b ** 2).sum(1), 0)


@dataclass
class CentroidGraph:
    centroids: np.ndarray
    near: np.ndarray  # neighbours of each centroid
    entries: np.ndarray

    def search(self, x: np.ndarray, ratio: float) -> np.ndarray:
        """Distances to the centroids met, infinite elsewhere: a walk that expands all within ``ratio`` times the best."""
        n, lists = len(x), len(self.centroids)
        d = np.full((n, lists), np.inf)
        own = (self.centroids ** 2).sum(1)
        d[:, self.entries] = np.sqrt(_square(x, self.centroids[self.entries]))
        open_ = np.isfinite(d)
        while True:
            best = d.min(axis=1, keepdims=True)
            rows, nodes = np.nonzero(open_ & (d <= np.maximum(ratio, 1) * best))
            if not len(rows):
                return d
            open_[rows, nodes] = False
            cells = np.unique((rows[:, None] * lists + self.near[nodes]).ravel())
            cells = cells[np.isinf(d.ravel()[cells])]
            if len(cells):
                r, c = cells // lists, cells % lists
                square = (x[r] ** 2).sum(1) - 2 * np.einsum("ij,ij->i", x[r], self.centroids[c]) + own[c]
                d[r, c] = np.sqrt(np.maximum(square, 0))
                open_[r, c] = True


def fit_centroids(sample: np.ndarray, lists: int, degree: int = 16, steps: int = 5, seed: int = 5) -> CentroidGraph:
    """Balanced leaves of the sample, refined; their graph of ``degree`` nearest centroids and back links."""
    rng = np.random.default_rng(seed)
    parts = [np.arange(len(sample))]
    while len(parts) < lists:
        parts.sort(key=len)
        part = parts.pop()
        x = sample[part]
        a, b = x[rng.integers(len(x))], x[rng.integers(len(x))]
        for _ in range(4):
            side = (_square(x, np.stack([a, b])) @ np.array([1, -1.0])) > 0
            if side.all() or not side.any():
                break
            a, b = x[~side].mean(0), x[side].mean(0)
        order = np.argsort(x @ (b - a), kind="stable")
        parts += [part[order[:len(part) // 2]], part[order[len(part) // 2:]]]
    c = np.stack([sample[p].mean(0) for p in parts])
    sizes = np.array([len(p) for p in parts], float)
    for _ in range(steps):
        d = _square(sample, c)
        at = (d * (1 + 0.1 * (sizes / sizes.mean() - 1))).argmin(1)
        sizes = np.bincount(at, minlength=len(c)).astype(float)
        for j in np.flatnonzero(sizes):
            c[j] = sample[at == j].mean(0)
    d = _square(c, c)
    k = min(degree, len(c))
    near = np.argsort(d, axis=1, kind="stable")[:, :k]
    entries = np.unique(np.linspace(0, len(c) - 1, min(len(c), 16)).astype(int))
    return CentroidGraph(c, near, entries)


def _batches_of(run_matrix, names_types):
    """mapInArrow body over (id, vector) rows of the index's dimension."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for rows, x in valid_rows(batch.column(1)):
                for lo in range(0, len(rows), 2048):
                    out = run_matrix(np.asarray(ids.take(pa.array(rows[lo:lo + 2048]))), x[lo:lo + 2048])
                    if out is not None:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(out, names_types)],
                                                         names=[n for n, _ in names_types])
    return run


def _post(vectors: DataFrame, graph: CentroidGraph, dim: int, copies: int, copy_ratio: float) -> DataFrame:
    """(list, nth, id, vec): nth 0 is the nearest list."""
    def assign(ids, x):
        if x.shape[1] != dim:
            return None
        d = graph.search(x.astype(np.float64), copy_ratio)
        order = np.argsort(d, axis=1, kind="stable")[:, :copies]
        far = np.take_along_axis(d, order, 1)
        rows, nth = np.nonzero(far <= copy_ratio * far[:, :1])
        raw = [v.tobytes() for v in x]
        return order[rows, nth], nth, ids[rows], [raw[i] for i in rows]

    return vectors.mapInArrow(_batches_of(assign, [("list", pa.int32()), ("nth", pa.int32()), ("id", pa.int64()), ("vec", pa.binary())]),
                              "list int, nth int, id long, vec binary")


def _probe(queries: DataFrame, graph: CentroidGraph, dim: int, primary: np.ndarray, k: int, probe_ratio: float, spare: int) -> DataFrame:
    """(list, id, vec): the lists that each query searches."""
    def choose(ids, x):
        if x.shape[1] != dim:
            return None
        x64 = x.astype(np.float64)
        d = graph.search(x64, probe_ratio)
        take = d <= probe_ratio * d.min(axis=1, keepdims=True)
        for i in np.flatnonzero(take @ primary <= spare * k):
            # too few vectors there: the ratio then starts from the list with which there are enough
            all_d = np.sqrt(_square(x64[i:i + 1], graph.centroids)[0])
            order = np.argsort(all_d, kind="stable")
            enough = min(int(np.searchsorted(np.cumsum(primary[order]), spare * k + 1)), len(order) - 1)
            take[i] |= all_d <= probe_ratio * all_d[order[enough]]
        rows, lists = np.nonzero(take)
        raw = [v.tobytes() for v in x]
        return lists, ids[rows], [raw[i] for i in rows]

    return queries.mapInArrow(_batches_of(choose, [("list", pa.int32()), ("id", pa.int64()), ("vec", pa.binary())]),
                              "list int, id long, vec binary")


def _nearest(q_ids, q, p_ids, p, k):
    """(query, id, distance) of each query's k nearest of one piece, ties to the smaller id."""
    out = []
    p2 = (p ** 2).sum(1)
    for lo in range(0, len(q), 256):
        part = q[lo:lo + 256]
        rough = (part ** 2).sum(1)[:, None] - 2 * part @ p.T + p2
        margin = 1e-9 * ((part ** 2).sum(1) + p2.max())
        for i in range(len(part)):
            row = np.where(p_ids == q_ids[lo + i], np.inf, rough[i])
            limit = np.partition(row, k - 1)[k - 1] if len(row) > k else np.inf
            cand = np.flatnonzero((row <= limit + margin[i]) & np.isfinite(row))
            exact = np.sqrt(((p[cand] - part[i]) ** 2).sum(axis=1))
            top = np.lexsort((p_ids[cand], exact))[:k]
            out.append((np.full(len(top), q_ids[lo + i]), p_ids[cand][top], exact[top]))
    return out


def _search(rows: DataFrame, dtype: str, k: int) -> DataFrame:
    """Rows (list, piece, kind 0 posting / 1 query, id, vec), sorted so within partitions."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, ids, vecs = None, [], []
        held = None

        for batch in batches:
            pdf = batch.to_pandas()
            if not len(pdf):
                continue
            key = pdf["list"].to_numpy(np.int64) * (1 << 24) + pdf["piece"].to_numpy(np.int64)
            kind = pdf["kind"].to_numpy()
            cuts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (kind[1:] != kind[:-1]), True])
            found = []
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if key[lo] != name:
                    name, ids, vecs, held = key[lo], [], [], None
                own = pdf["id"].to_numpy(np.int64)[lo:hi]
                x = np.frombuffer(b"".join(pdf["vec"].iloc[lo:hi]), dtype).reshape(hi - lo, -1).astype(np.float64)
                if kind[lo] == 0:
                    ids.append(own)
                    vecs.append(x)
                elif ids:
                    if held is None:
                        held = np.concatenate(ids), np.concatenate(vecs)
                    found += _nearest(own, x, *held, k)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], names=["query_id", "vec_id", "score"])

    return rows.mapInArrow(run, "query_id long, vec_id long, score double")


def nearest_neighbours(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding",
                       fit_rows: int = 20_000, list_size: int = 200, max_lists: int = 4096, max_list: int = 4096, copies: int = 4,
                       copy_ratio: float = 1.15, probe_ratio: float = 1.2,
                       spare: int = 4) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` nearest found of each row with ``is_query``."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "ann")
    dtype = "<f4" if "float" in vectors.schema[vec_col].dataType.simpleString() else "<f8"
    vec = F.col(vec_col) if dtype == "<f4" else F.col(vec_col).cast("array<double>")
    rows = vectors.withColumn("_q", F.coalesce(is_query, F.lit(False))).select(
        F.col(id_col).cast("long").alias("id"), vec.alias("v"), "_q").where("id is not null and v is not null")
    shape = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if shape is None:
        return empty
    dim = shape["dim"]
    rows = rows.where(F.size("v") == dim)
    sample = rows.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(fit_rows).toArrow()
    usable = list(valid_rows(sample["v"]))
    if not usable:
        return empty
    fit = usable[0][1].astype(np.float64)
    lists = int(max(1, min(max_lists, len(fit), round(shape["count"] / list_size))))
    graph = fit_centroids(fit, lists)
    posts = scratch.write(_post(rows.select("id", "v"), graph, dim, copies, copy_ratio), "posts")
    counts = posts.groupBy("list").agg(F.count("*").alias("n"), F.sum((F.col("nth") == 0).cast("long")).alias("own")).collect()  # a row per list
    primary = np.zeros(lists, np.int64)
    pieces = np.ones(lists, np.int64)
    for r in counts:
        primary[r["list"]], pieces[r["list"]] = r["own"], -(-r["n"] // max_list)
    n_pieces = F.element_at(F.lit([int(p) for p in pieces]), F.col("list") + 1)
    probes = _probe(rows.where("_q").select("id", "v"), graph, dim, primary, k, probe_ratio, spare)
    both = posts.select("list", F.pmod(F.xxhash64("id"), n_pieces).cast("int").alias("piece"), F.lit(0).alias("kind"), "id", "vec").unionByName(
        probes.select("list", F.explode(F.sequence(F.lit(0), (n_pieces - 1).cast("int"))).alias("piece"), F.lit(1).alias("kind"), "id", "vec"))
    found = _search(both.repartition("list", "piece").sortWithinPartitions("list", "piece", "kind"), dtype, k)
    # a vector of several lists is found once in each
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return once.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
