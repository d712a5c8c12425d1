"""The hidden Markov model against enumeration and plain recursions."""

import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from odd import empty_documents, odd_documents
from pyspark.sql import functions as F

from foldframe.llm import hmm
from foldframe.llm.common import table


def small_model(states=3, head=4, seed=0):
    rng = np.random.default_rng(seed)
    share = lambda *s: (lambda x: x / x.sum(axis=-1, keepdims=True))(rng.random(s) + 0.1)
    return hmm.Model([b"%d" % i for i in range(head)], share(states), share(states), share(states, states), share(states, head + 2).T)


def test_forward_sums_over_all_paths():
    m = small_model()
    seqs = [np.array(s) for s in ([0, 3, 5], [5], [1, 1, 2, 4, 5])]
    want = []
    for s in seqs:
        p = 0.0
        for path in itertools.product(range(3), repeat=len(s)):
            q = m.start[path[0]] * m.emit[s[0], path[0]]
            for t in range(1, len(s)):
                q *= m.move[path[t - 1], path[t]] * m.emit[s[t], path[t]]
            p += q
        want.append(math.log(p))
    assert hmm.log_likelihood(m, seqs) == pytest.approx(want)


def test_expected_counts_and_growing_likelihood():
    m = small_model()
    cut = [np.array(s) for s in ([0, 1, 5], [2, 3, 3, 4, 5], [5])]
    start, later, move, emit, ll = hmm.expected_counts(m, cut, np.array([True, False, True]))
    assert start.sum() == pytest.approx(2) and later.sum() == pytest.approx(1) and move.sum() == pytest.approx(6)
    assert emit.sum(axis=1) == pytest.approx(np.bincount(np.concatenate(cut), minlength=6))
    rng = np.random.default_rng(1)
    cut = [np.append(rng.integers(0, 2, 20) + 2 * (i % 2), 5) for i in range(40)]
    first, base, lls = np.ones(40, bool), np.full(6, 1 / 6), []
    for _ in range(15):
        found = hmm.expected_counts(m, cut, first)
        lls.append(found[4])
        m = hmm.maximise(m.head, base, found[0], found[0], found[2], found[3], smooth=0.0)
    assert all(b > a - 1.0 for a, b in zip(lls, lls[1:])) and lls[-1] > lls[0] + 50


def test_query_counts_and_held_out_gain(spark):
    sf = "/root/testdata/sf0.01"
    rows = hmm.op4_hmm(spark, sf).collect()
    docs = {d.doc_id: hmm.words(d.text) for d in table(spark, sf, "documents").select("doc_id", "text").collect()}
    held = {i for i in docs if zlib.crc32(str(i).encode()) % 10 == 0}
    c = Counter(w for i, ws in docs.items() if i not in held for w in ws)
    c[None] = len(docs) - len(held)
    n, v = sum(c.values()), len(c)
    for r in rows:
        toks = [*docs[r.doc_id], None]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (r.doc_id in held, len(toks), sum(c[t] > 0 for t in toks), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in toks))
        assert r.score < 0
    own = [r for r in rows if r.held_out]
    assert sum(r.score for r in own) > sum(r.base_score for r in own)


def test_small_head_is_exact_in_counts(spark):
    docs = spark.createDataFrame([(i, "a b c a d" if i % 2 else "e f e g a") for i in range(40)], "doc_id long, text string")
    full = {r.doc_id: r for r in hmm.hmm_scores(docs, states=2, rounds=1).collect()}
    few = {r.doc_id: r for r in hmm.hmm_scores(docs, states=2, rounds=1, head_words=1, min_count=1).collect()}
    assert all(few[i].base_score == pytest.approx(full[i].base_score) and few[i].n_known == full[i].n_known for i in full)


def test_odd_rows(spark):
    docs = odd_documents(spark)
    rows = hmm.hmm_scores(docs, states=2, rounds=1).collect()
    assert len(rows) == docs.count() and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (1, 2, 3, 12)} == {1}
    assert hmm.hmm_scores(empty_documents(spark)).count() == 0
    alone = docs.where(F.col("doc_id").isNull())  # nothing to train on
    assert math.isfinite(hmm.hmm_scores(alone).first()["score"])


def test_every_text_shapes_the_model_alike(spark, monkeypatch):
    """All that Baum-Welch sees, on the driver or in tasks, are whole texts' segments: no round runs on a part of them."""
    docs = spark.createDataFrame([(i, " ".join("abcdefgh"[(i + j) % (5 + i % 3)] for j in range(20 + i % 7))) for i in range(60)], "t long, x string")
    texts = docs.select(F.col("x").alias("t"))
    counts = hmm.word_counts(texts, hmm.Scratch(spark, "hmm-test"))
    own, seen = hmm.expected_counts, []
    monkeypatch.setattr(hmm, "expected_counts", lambda *a: (seen.append(len(a[1])), own(*a))[1])
    stats = {"tokens": counts.agg(F.sum("c")).first()[0], "texts": 60, "distinct": counts.count()}
    model = hmm.train(texts, counts, stats, hmm.Scratch(spark, "hmm-test"), states=2, rounds=2)
    assert not seen                     # nothing is fitted on the driver
    ids = {w: i for i, w in enumerate(model.head)}
    cut, first = hmm.segments([hmm.encode(r.t, ids, len(ids)) for r in texts.collect()], 128)
    base = np.concatenate([stats["head_counts"], [stats["tokens"] - 60 - stats["head_counts"].sum(), 60]]) + hmm.ALPHA
    base = base / base.sum()
    emit = base[:, None] * np.exp(0.5 * np.random.default_rng(3).standard_normal((len(base), 2)))
    want = hmm.Model(model.head, np.full(2, 0.5), np.full(2, 0.5), np.array([[0.9, 0.1], [0.1, 0.9]]), emit / emit.sum(axis=0))
    for _ in range(2):
        want = hmm.maximise(model.head, base, *own(want, cut, first)[:4])
    assert np.allclose(model.emit, want.emit) and np.allclose(model.move, want.move) and np.allclose(model.start, want.start)
