"""Ranked search against scores of all documents."""

import math
import re
from collections import Counter

import pytest
from odd import empty_documents, odd_documents

from foldframe.llm.lexical import rank_documents, terms

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return PATTERN.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=10):
    bags = [(i, Counter(plain_terms(t))) for i, t in docs]
    bags = [(i, c, sum(c.values())) for i, c in bags if c]
    n, length = len(bags), sum(x for _, _, x in bags)
    df = Counter(t for _, c, _ in bags for t in c)
    out = []
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(plain_terms(t))
    for item, found in wanted.items():
        rows = []
        for doc, c, size in bags:
            m = 10 + 90 * size * n // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                    for t in found if t in c)
            if s > 0:
                rows.append((-s, doc is None, doc or 0, doc))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(rows)[:k])]
    return sorted(out, key=str)


def test_terms_are_those_of_the_pattern():
    for text in ("A-b_C d9 ÀÉ\u0085x  y\x7fz Zürich, 你好 KK", "", " ", "İI"):
        assert [t.decode() for t in terms(text.encode())] == plain_terms(text)


@pytest.mark.parametrize("max_items,max_postings", [(4096, 200_000), (2, 200_000), (4096, 3)])
def test_ranks_with_ties_copies_and_blocks(spark, max_items, max_postings):
    docs = [(i, ["red fox", "Red fox fox", "blue dog", "the red dog", "nothing"][i % 5]) for i in range(70)]
    docs += [(None, "red fox"), (3, "red fox"), (3, "red fox"), (99, None), (98, ""), (-5, "fox red")]
    items = [(1, "red fox"), (2, "DOG!"), (3, "unknown words"), (4, None), (None, "blue"), (5, "the"), (5, "fox"), (6, "red red red")]
    got = rank_documents(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"),
                         max_items=max_items, max_postings=max_postings)
    assert sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in got.collect()), key=str) == brute(docs, items)


def test_classes_are_scored_once(spark):
    docs = spark.createDataFrame([(i, f"red fox unrelated{i}") for i in range(40)], "doc_id long, text string")
    got = rank_documents(docs, spark.createDataFrame([(1, "red fox")], "item_id long, text string")).collect()
    assert sorted(r.doc_id for r in got) == list(range(10)) and {r.class_size for r in got} == {40}


def test_odd_rows(spark):
    items = spark.createDataFrame([(1, "one two"), (2, "idiot"), (3, "ünï 你好"), (4, "word5 token7")], "item_id long, text string")
    docs = odd_documents(spark)
    got = sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in rank_documents(docs, items).collect()), key=str)
    assert got == brute([(d.doc_id, d.text) for d in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert rank_documents(empty_documents(spark), items).count() == 0
    assert rank_documents(docs, items.limit(0)).columns == ["item_id", "rank", "doc_id", "score", "class_size"]
