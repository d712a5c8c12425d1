"""Periodic runs against all stretches of all periods."""

import hashlib
import zlib

import numpy as np
import pytest
from odd import empty_documents, odd_documents
from pyspark.sql import functions as F

from foldframe.llm.common import table
from foldframe.llm.runs import Extensions, find_runs, op12_runs, periodic_runs


def brute_runs(words):
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            s, e = i, j + q
            small = next(p for p in range(1, q + 1) if all(words[x] == words[x + p] for x in range(s, e - p)))
            if e - s >= max(6, 4 * q) and small == q:
                out.append((s, e - s, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text, alter):
    w = (text or "").encode().split()
    n = len(w)
    h = zlib.crc32(str(doc_id).encode())
    if alter and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            sha("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()),
            sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))


@pytest.mark.parametrize("seed", range(6))
def test_extensions(seed):
    rng = np.random.default_rng(seed)
    seq = rng.integers(1, 1 + [1, 2, 3, 50][seed % 4], [5, 40, 400, 700, 31, 62][seed])
    e = Extensions(seq)
    i, j = np.meshgrid(np.arange(len(seq)), np.arange(len(seq)))
    i, j = i[i < j], j[i < j]
    want = []
    for a, b in zip(i.tolist(), j.tolist()):
        k = 0
        while b + k < len(seq) and seq[a + k] == seq[b + k]:
            k += 1
        want.append(k)
    assert e.lce(i, j).tolist() == want


@pytest.mark.parametrize("seed", range(8))
def test_runs_of_groups(seed):
    rng = np.random.default_rng(seed)
    texts = []
    for _ in range(60):
        x = []
        while len(x) < rng.integers(0, 160):
            unit = rng.integers(1, rng.integers(2, 5), rng.integers(1, 9)).tolist()
            x += (unit * int(rng.integers(1, 9)))[: int(rng.integers(1, 60))]
        texts.append(np.array(x, np.int64))
    texts += [np.ones(300, np.int64), np.zeros(0, np.int64), np.array([1, 1, 1, 1, 1]), np.tile([1, 2, 1, 1, 2], 40)]
    got = [[tuple(r) for r in x.tolist()] for x in find_runs(texts)]
    assert got == [brute_runs(t.tolist()) for t in texts]
    assert any(got)


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents").select("doc_id", "text").where(F.length("text") < 12000).collect()
    got = {r.doc_id: tuple(r) for r in op12_runs(spark, sf).collect()}
    assert len(got) == table(spark, sf, "documents").count()
    assert [got[d.doc_id] for d in docs] == [brute_row(d.doc_id, d.text, True) for d in docs]
    assert any(r[1] for r in got.values())


def test_odd_rows(spark):
    docs = odd_documents(spark)
    key = lambda r: (r[0] is None, r[0] or 0, r[6], r[7])
    got = sorted((tuple(r) for r in periodic_runs(docs).collect()), key=key)
    short = [d for d in docs.collect() if len(d.text or "") < 10000]
    want = sorted((brute_row(d.doc_id, d.text, False) for d in short), key=key)
    assert [r for r in got if r[0] not in (7, 8)] == want and len(got) == docs.count()
    assert periodic_runs(empty_documents(spark)).count() == 0


def test_long_periodic_text(spark):
    """One text of 600,000 words in two stretches."""
    text = " ".join(["a", "b", "c"] * 100_000 + ["x"] * 300_000)
    r = periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r.n_runs, r.start, r.length, r.period) == (2, 300_000, 300_000, 1)
    assert r.collapsed_sha256 == hashlib.sha256(b"a b c x").hexdigest()
