"""Each stage of the pipeline against what its input asks for."""

import re
from collections import Counter

import corpus_pipeline as cp
from odd import odd_documents, write_tables
from test_packing import check
from test_simhash import brute

from foldframe.llm import secrets
from foldframe.llm.common import table
from foldframe.llm.simhash import fingerprint


def test_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents")
    seen = {"documents": docs}
    for name, stage in cp.STAGES:
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{name}")
        docs = seen[name] = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert docs.columns == seen["documents"].columns
    rows = {k: v.collect() for k, v in seen.items()}
    labels = {r.doc_id: r.toxic for r in table(spark, sf, "labels").collect()}
    kept = {r.doc_id for r in rows["toxicity"]}
    gone = {r.doc_id for r in rows["documents"]} - kept
    assert sum(labels.get(i) == 0 for i in gone) == 0 and sum(labels.get(i) == 1 for i in gone) > 30
    # one document of each group
    fps = [fingerprint(r.text) for r in rows["toxicity"]]
    groups = brute([r.doc_id for r in rows["toxicity"]], fps)
    assert sorted(r.doc_id for r in rows["near_duplicates"]) == sorted(set(groups))
    # every clean text stays, every password-like value goes
    before = {r.doc_id: r for r in rows["near_duplicates"]}
    value = re.compile(r"(password=|token = \")[0-9a-f]{18,}|AKIA[A-Z0-9]{16}")
    assert len(rows["secret_scan"]) == len(before)
    for r in rows["secret_scan"]:
        assert not value.search(r.text)
        if not re.search(secrets.CANDIDATE, before[r.doc_id].text):
            assert r == before[r.doc_id]
        elif cp.SECRET_MARK in r.text:
            assert r.n_chars == len(r.text)
    times = Counter(r.doc_id for r in rows["mixing"])
    assert set(times) <= set(before) and max(times.values()) <= 2
    check(rows["packing"], [(r.doc_id, r.text) for r in rows["mixing"]], 2048)


def test_odd_rows(spark, tmp_path):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(4, 0)], "doc_id long, toxic int")
    write_tables(str(tmp_path), docs, labels)
    rows = cp.run(spark, str(tmp_path)).collect()
    assert rows and {r.doc_id for r in rows} <= {r.doc_id for r in docs.collect()}


def test_stages_keep_input_columns_of_their_own_names(spark):
    """Columns called like the operators' internal ones come through unchanged; empty tables too."""
    from foldframe.llm.mixing import mixed_documents
    from foldframe.llm.secrets import redact_secrets
    from foldframe.llm.simhash import drop_near_duplicates
    from foldframe.llm.toxicity import drop_toxic
    odd = ["_key", "_nth", "_id", "_h", "_size", "_n", "_hash", "_bucket", "_target", "_slot", "_epochs", "_toxicity", "_e", "root", "fp", "x__0"]
    rows = [(i, f"text number{i} of some words {i * 7}", "a", *(f"{c}{i}" for c in odd)) for i in range(12)]
    schema = "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in odd)
    labels = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int")
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for stage in (lambda d: drop_toxic(d, labels, threshold=1.1), drop_near_duplicates, redact_secrets, mixed_documents):
            out = stage(docs)
            assert out.columns == docs.columns
            want = {r.doc_id: r for r in docs.collect()}
            assert all(tuple(r)[2:] == tuple(want[r.doc_id])[2:] for r in out.collect())
