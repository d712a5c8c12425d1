"""SimHash groups against all pairs, hot entries included."""

import numpy as np
import pytest
from odd import empty_documents, odd_documents
from pyspark.sql import functions as F

from foldframe.llm.common import Scratch, table
from foldframe.llm.components import connected_components
from foldframe.llm.simhash import fingerprint, link_fingerprints, op10_simhash, simhash_groups


def brute(ids, fps, max_bits=2):
    u = np.array(fps, dtype=np.int64).view(np.uint64)
    root = {i: i for i in range(len(u))}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(u)):
        near = np.flatnonzero(np.bitwise_count(u[i] ^ u[i + 1:]) <= max_bits) + i + 1
        for j in near:
            root[find(j)] = find(i)
    least = {}
    for i, x in enumerate(ids):
        r = find(i)
        if x is not None:
            least[r] = min(least.get(r, x), x)
    return [least.get(find(i)) for i in range(len(u))]


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op10_simhash(spark, sf).collect()}
    docs = table(spark, sf, "documents").select("doc_id", "text").collect()
    fps = [fingerprint(d.text) for d in docs]
    want = brute([d.doc_id for d in docs], fps)
    assert got == {d.doc_id: (f"{f & (2**64 - 1):016x}", c) for d, f, c in zip(docs, fps, want)}


@pytest.mark.parametrize("max_entry", [1, 1000])
@pytest.mark.parametrize("max_bits,segments", [(2, 2)])
def test_links_of_near_fingerprints(spark, max_entry, max_bits, segments):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 12)
    fps = sorted({int(b) ^ sum(1 << int(x) for x in rng.choice(63, rng.integers(0, 5), replace=False))
                  for b in base for _ in range(12)})
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    s = Scratch(spark, "t")
    comp = {r.node: r.component for r in connected_components(
        link_fingerprints(df, max_bits, segments, max_entry, s), s).collect()}
    assert [comp.get(f, f) for f in fps] == brute(fps, fps, max_bits)


def test_odd_rows(spark):
    docs = odd_documents(spark)
    rows = simhash_groups(docs).collect()
    assert len(rows) == docs.count()
    by = {r.doc_id: r for r in rows}
    assert by[1].fp == by[2].fp == by[3].fp == by[12].fp == 0 and by[12].component_id == 1
    assert by[8].component_id == 7 and by[5].component_id == 4
    assert simhash_groups(empty_documents(spark)).count() == 0


def test_chain_becomes_one_component(spark):
    e = spark.range(300).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    got = connected_components(e, Scratch(spark, "t")).select("component").distinct().collect()
    assert [r.component for r in got] == [0]
