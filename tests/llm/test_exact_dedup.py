"""Exact duplicates: the code, the exchange with few owners, weak hashes, odd rows."""

import hashlib

import numpy as np
import pytest
from odd import empty_documents, odd_documents

from foldframe.llm.exact_dedup import duplicate_groups, golomb_decode, golomb_encode, golomb_shift

SPACES = str.maketrans("", "", " \t\n\x0b\x0c\r")


def brute(docs):
    groups = {}
    for doc_id, text in docs:
        groups.setdefault((text or "").translate(SPACES), []).append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    out = []
    for norm, rows in groups.items():
        rows.sort()
        out += [(r[3], rows[0][3], len(rows), i == 0, hashlib.sha256(norm.encode()).hexdigest()) for i, r in enumerate(rows)]
    return sorted(out, key=str)


def found(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()), key=str)


@pytest.mark.parametrize("n,width", [(0, 100), (1, 1 << 50), (1000, 1 << 40), (500, 500), (3000, 1 << 13)])
def test_golomb_round_trip(n, width):
    rng = np.random.default_rng(n)
    values = np.unique(rng.integers(0, width, n)) + 77
    shift = golomb_shift(len(values), width)
    unary, rest = golomb_encode(values, 77, shift)
    assert golomb_decode(unary, rest, len(values), 77, shift).tolist() == values.tolist()
    if n == 1000:
        assert len(unary) + len(rest) < 1000 * 33 / 8       # about log2(width / n) + 1.5 bits each


def _docs():
    docs = [(i, f"text {i % 37}" + " " * (i % 5)) for i in range(300)] + [(1000 + i, "hot  copy") for i in range(200)]
    return docs + [(None, "hot copy "), (7, "alone"), (7, "a\tl o\nne"), (8, None), (9, " \r\n"), (9, " \r\n"), (10, "a lone")]


weak = lambda norm: (sum(norm) % 5) << 61  # noqa: E731  five hashes only; sent to the workers by value


@pytest.mark.parametrize("options", [{}, {"bits": 3}, {"owners": 1}, {"owners": 50, "bits": 40}, {"block_words": 1},
                                     {"hasher": weak}, {"hasher": weak, "block_words": 1, "bits": 5}])
def test_groups(spark, options):
    docs = _docs()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    assert found(duplicate_groups(df, **options)) == brute(docs)


def test_odd_rows(spark):
    docs = odd_documents(spark)
    assert found(duplicate_groups(docs)) == brute([(d.doc_id, d.text) for d in docs.collect()])
    assert duplicate_groups(empty_documents(spark)).count() == 0
