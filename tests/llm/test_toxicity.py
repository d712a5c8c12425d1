"""Factorization machine: pairs, held-out accuracy, odd rows."""

import zlib

import numpy as np
from odd import empty_documents, odd_documents
from pyspark.sql import functions as F

from foldframe.llm import toxicity
from foldframe.llm.common import table


def test_scores_equal_the_pair_sum():
    rng = np.random.default_rng(0)
    ids = np.unique(np.concatenate([toxicity.terms(w) for w in ("idiot", "clowns", "the")]))
    m = toxicity.FactorizationMachine(-0.3, ids, rng.normal(size=len(ids)), rng.normal(size=(len(ids), 3)))
    present = [i for i, x in enumerate(ids) if x in set(toxicity.terms("Idiot! clowns"))]
    z = -0.3 + m.w[present].sum() + sum(m.v[i] @ m.v[j] for n, i in enumerate(present) for j in present[:n])
    assert abs(m.scorer()("Idiot! clowns unseen") - 1 / (1 + np.exp(-z))) < 1e-12


def test_learns_a_pair_that_single_words_do_not_show():
    rng = np.random.default_rng(2)
    texts, labels = [], []
    for _ in range(3000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        texts.append(" ".join(["aaa"] * a + ["bbb"] * b + [f"w{rng.integers(50)}"]))
        labels.append(int(a and b))
    m = toxicity.fit_fm([toxicity.terms(t) for t in texts], np.array(labels), epochs=60)
    s = m.scorer()
    assert s("aaa bbb w1") > 0.9 > 0.1 > max(s("aaa w1"), s("bbb w1"), s("w1"))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in toxicity.op7_toxicity(spark, sf).collect()}
    labels = {r.doc_id: r.toxic for r in table(spark, sf, "labels").collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    own = [(got[i].score, y) for i, y in labels.items() if got[i].held_out]
    pos, neg = [s for s, y in own if y], [s for s, y in own if not y]
    auc = np.mean([[(p > n) + 0.5 * (p == n) for n in neg] for p in pos])
    assert auc > 0.95 and np.mean([n < 0.5 for n in neg]) > 0.99 and np.mean([p >= 0.5 for p in pos]) > 0.8


def test_odd_rows(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(4, 0, "x"), (6, None, "x"), (10, 1, "x"), (None, 1, "x"), (10, 1, "x")], "doc_id long, toxic int, text string")
    model = toxicity.fit_toxicity(docs, labels)
    rows = docs.select("doc_id", toxicity.toxicity_score(model, F.col("text")).alias("s")).collect()
    assert len(rows) == docs.count() and all(0 <= r.s <= 1 for r in rows)
    none = toxicity.fit_toxicity(docs, labels.limit(0))
    assert {r.s for r in docs.select(toxicity.toxicity_score(none, F.col("text")).alias("s")).collect()} == {1 / (1 + np.exp(5.0))}
    kept = toxicity.drop_toxic(docs, labels, threshold=1.1)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert toxicity.drop_toxic(empty_documents(spark), labels).count() == 0


def test_without_training_rows_nothing_is_toxic(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id long, text string")
    away = [i for i in range(20) if zlib.crc32(str(i).encode()) % 5 == 0]
    for rows in ([], [(4, None)], [(i, 1) for i in away], [(99, 1)]):
        labels = spark.createDataFrame(rows, "doc_id long, toxic int")
        assert toxicity.drop_toxic(docs, labels).count() == 20
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    assert {(r.score, r.predicted) for r in toxicity.op7_toxicity(spark, str(tmp_path)).collect()} == {(1 / (1 + np.exp(5.0)), 0)}   # predicted agrees with the score


def test_the_driver_gets_only_terms_with_weights(spark, monkeypatch):
    """The model is that of all terms, though only the telling ones of a row come to the driver."""
    rng = np.random.default_rng(4)
    texts = [" ".join(["foul"] * (i % 4 == 0) + [f"w{i}x{j}" for j in range(40)] + [f"c{rng.integers(9)}"]) for i in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    rows, y = toxicity.training_rows(docs, labels, 20_000)
    want = toxicity.fit_fm(rows, y)
    got, plain = [], toxicity.fit_fm
    monkeypatch.setattr(toxicity, "fit_fm", lambda rows, y, **k: (got.extend(rows), plain(rows, y, **k))[1])
    model = toxicity.fit_toxicity(docs, labels)
    assert len(got) == len(rows) and sum(map(len, got)) < sum(map(len, rows)) / 20
    assert len(want.ids) and (model.ids == want.ids).all() and model.bias == want.bias
    assert (model.w == want.w).all() and (model.v == want.v).all()


def test_a_labelled_id_of_many_rows_teaches_once(spark):
    docs = spark.createDataFrame([(1, f"text {i % 3}") for i in range(500)] + [(2, "other")], "doc_id long, text string")
    rows, y = toxicity.training_rows(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int"), 100)
    assert len(rows) == len(y) <= 2
