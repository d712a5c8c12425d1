"""Embedding near-duplicates and nearest neighbours against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldframe.llm import ann
from foldframe.llm.embedding_dedup import near_duplicate_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, n string, codes string, `list` string"


def table(spark, rows):
    return spark.createDataFrame([(i, v if v is None else [None if x is None else float(x) for x in v], lab, "x", "y", "z")
                                  for i, v, lab in rows], SCHEMA)


def planted(rng, dim=16):
    rows, n = [], 0
    for label in (0, 1, None):
        for _ in range(12):
            centre = rng.standard_normal(dim)
            for k in range(rng.integers(1, 12)):
                v = centre + (0 if k % 3 == 0 else rng.standard_normal(dim) * rng.choice([0.02, 0.1, 0.25]))
                rows.append((n * 7 % 1009, v.astype("f4"), label))
                n += 1
    bad = [None, [], [0.0] * dim, [float("nan")] + [1.0] * (dim - 1), [float("inf")] + [1.0] * (dim - 1), [None] + [1.0] * (dim - 1), [1.0, 2.0]]
    return rows + [(5000 + i, v, 0) for i, v in enumerate(bad)]


def usable(v, dim):
    return v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v) and any(v)


@pytest.mark.parametrize("block", [4, 1024])
def test_links_and_components(spark, block):
    rows = planted(np.random.default_rng(4))
    got = {r.vec_id: r for r in near_duplicate_vectors(table(spark, rows), bits=6, tables=40, block=block).collect()}
    assert len(got) == len(rows)
    root = {i: i for i, _, _ in rows}
    links = dict.fromkeys(root, 0)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    good = [(i, np.asarray(v, "f8"), lab) for i, v, lab in rows if usable(v, 16) and lab is not None]
    for n, (i, v, lab) in enumerate(good):
        for j, u, other in good[:n]:
            if lab == other and v @ u / np.linalg.norm(v) / np.linalg.norm(u) >= 0.93:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert {i: r.n_links for i, r in got.items()} == links
    assert {i: r.component_id for i, r in got.items()} == {i: find(i) for i in root}
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_repeats_nulls_and_empty(spark):
    df = table(spark, [(1, [1, 0], 0), (1, [1, 0], 0), (2, [2, 0], 0), (3, [1, 0], None), (None, [1, 0], 0), (4, [0, 1], 0)])
    got = sorted((r.vec_id or 0, r.n_links, r.component_id) for r in near_duplicate_vectors(df).collect())
    assert got == [(0, 0, None), (1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3), (4, 0, 4)]
    assert near_duplicate_vectors(df.limit(0)).count() == 0
    assert ann.nearest_neighbours(df.limit(0), F.lit(True)).count() == 0


def brute(rows, queries, dim, k):
    good = [(i, np.asarray(v, "f8")) for i, v, _ in rows if usable(v, dim)]
    out = {}
    for i, v in good:
        if i in queries:
            d = sorted((float(np.sqrt(((u - v) ** 2).sum())), j) for j, u in good if j != i)
            out[i] = d[:k]
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(6)
    rows = planted(rng)
    rows += [(6000 + i, rows[0][1], 1) for i in range(30)]  # one very common vector
    queries = {i for i, _, _ in rows if i % 5 == 0}
    df = table(spark, rows)
    for options, least in (({"list_size": 10**6}, 1.0), ({"list_size": 12, "max_list": 20}, 0.9)):
        got = {}
        for r in ann.nearest_neighbours(df, F.col("vec_id") % 5 == 0, **options).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.score, r.vec_id))
        want = brute(rows, queries, 16, 10)
        assert got.keys() == want.keys() and all(len(x) == 10 for x in got.values())
        hits = sum(len(set(got[q]) & set(want[q])) for q in want)
        assert hits >= least * sum(map(len, want.values()))


def test_few_candidates(spark):
    df = table(spark, [(0, [1, 0], 0), (1, [0, 1], 0), (2, [1, 0], 0), (3, [0, 0], 0)])
    got = [tuple(r) for r in ann.nearest_neighbours(df, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 2, 0.0), (0, 2, 1, 2 ** 0.5)]
