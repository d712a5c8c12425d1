"""Repeated windows and the removal of repeated passages against counting."""

import hashlib
import random
from collections import Counter

import pytest
from odd import empty_documents, odd_documents
from pyspark.sql import functions as F

from foldframe.llm import repeats
from foldframe.llm.common import table
from foldframe.llm.prefix_free import repeated_windows
from foldframe.llm.repeats import op6_repeats, remove_repeats


def odd_strings(rng, n):
    base = [bytes(rng.choice(b"abcdefgh \x00") for _ in range(rng.randint(0, 600))) for _ in range(4)]
    base += [b"a" * 500, b"ab" * 300, b"\x00" * 300]
    return list(dict.fromkeys(b"".join(b[rng.randint(0, len(b) // 2):][:rng.randint(0, 500)]
                                       for b in rng.choices(base, k=rng.randint(1, 4))) for _ in range(n)))


@pytest.mark.parametrize("window", [200, 20])
def test_corpus_order_finds_all_repeats(window):
    rng = random.Random(window)
    for _ in range(6):
        strings = odd_strings(rng, 12)
        c = Counter(s[i:i + window] for s in strings for i in range(len(s) - window + 1))
        want = [[i for i in range(len(s) - window + 1) if c[s[i:i + window]] > 1] for s in strings]
        assert [[i for a, b in r for i in range(a, b)] for r in repeated_windows(strings, window)] == want


def expected(docs, window):
    c = Counter(s[i:i + window] for _, s in docs for i in range(len(s) - window + 1))
    out = []
    for d, s in docs:
        hit = bytearray(len(s))
        for i in range(len(s) - window + 1):
            if c[s[i:i + window]] > 1:
                hit[i:i + window] = b"\1" * window
        spans = sum(1 for i, h in enumerate(hit) if h and (i == 0 or not hit[i - 1]))
        kept = bytes(x for x, h in zip(s, hit) if not h)
        out.append((d, len(s), sum(hit), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_query_equals_counting(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(d.doc_id, (d.text or "").encode()) for d in table(spark, sf, "documents").collect()]
    assert sorted(map(tuple, op6_repeats(spark, sf).collect()), key=str) == expected(docs, 200)


@pytest.mark.parametrize("hot_bytes", [1 << 21, 300])
def test_odd_and_hot(spark, hot_bytes):
    rng = random.Random(3)
    passage = "".join(rng.choice("abcdefghij klmnop") for _ in range(260))
    texts = ["".join(rng.choice("qrstuvwxyz ") for _ in range(rng.randint(0, 300))) + passage[rng.randint(0, 40):]
             + "".join(rng.choice("QRSTUVWXYZ ") for _ in range(rng.randint(0, 300))) for _ in range(40)]
    docs = odd_documents(spark)
    docs = docs.unionByName(spark.createDataFrame([(100 + i, t, *["x"] * 2, 0, *["x"] * 7) for i, t in enumerate(texts)], docs.schema))
    got = sorted(map(tuple, remove_repeats(docs, hot_bytes=hot_bytes, chunk=2000).collect()), key=str)
    assert got == expected([(d.doc_id, (d.text or "").encode()) for d in docs.collect()], 200)


def test_no_task_holds_a_group_beyond_hot_bytes(spark, monkeypatch):
    """One passage in many texts, each with other text around it: its edges are distinct runs under one key."""
    rng = random.Random(5)
    passage = "".join(rng.choice("abcdefghij klmnop") for _ in range(230))
    other = lambda: "".join(rng.choice("qrstuvwxyz QRSTUVWXYZ") for _ in range(150))
    texts = [(i, other() + passage + other()) for i in range(120)]

    sizes = []

    def watched(runs, *rest, real=repeats._repeats_in_groups):
        sizes.extend(r.n for r in runs.groupBy("key").agg(F.sum(F.octet_length("s")).alias("n")).collect())
        return real(runs, *rest)

    monkeypatch.setattr(repeats, "_repeats_in_groups", watched)
    got = sorted(map(tuple, remove_repeats(spark.createDataFrame(texts, "doc_id long, text string"), hot_bytes=1500, chunk=1).collect()), key=str)
    assert got == expected([(i, t.encode()) for i, t in texts], 200)
    assert max(sizes, default=0) <= 1500


def test_empty(spark):
    assert remove_repeats(empty_documents(spark)).count() == 0
