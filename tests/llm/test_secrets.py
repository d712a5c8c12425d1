"""Findings, forest and redaction."""

import re

from odd import empty_documents, odd_documents

from foldframe.llm import secrets
from foldframe.llm.common import Scratch, table

KEY = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"


def test_findings_are_those_of_the_pattern(spark):
    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    got = sorted((r.id, r.nth, r.start, r.found) for r in secrets.findings(docs).collect())
    want = [(d.doc_id, n, m.start(), m[0]) for d in docs.collect() for n, m in enumerate(re.finditer(secrets.CANDIDATE, d.text))]
    assert got == sorted(want)


def test_forest_decides_unlabelled_findings(spark):
    rows = secrets.op8_secrets(spark, "/root/testdata/sf0.1").collect()
    labelled = [r for r in rows if r.label is not None]
    assert len({r.label for r in labelled}) == 2
    assert sum((r.score >= 0.5) == bool(r.label) for r in labelled) > 0.99 * len(labelled)
    docs = spark.createDataFrame(
        [(i, f'so token = "{KEY[i % 20:]}{i:020d}" or', "a") for i in range(60)]
        + [(100 + i, "it has abcdefghijklmnopqrstuv" + "xyz" * (i % 7) + " in", "a") for i in range(60)]
        + [(500, f'value: "{KEY}"', "src/app.py"), (501, "thisisalongwordwithoutanydigits1 a", "b")], "doc_id long, text string, source string")
    got = {r.id: r for r in secrets.score_findings(docs, Scratch(spark, "t")).collect()}
    assert got[500].label is None and got[500].is_secret and got[501].label is None and not got[501].is_secret


def test_redaction(spark):
    docs = odd_documents(spark)
    scored = secrets.score_findings(docs, Scratch(spark, "t"))
    out = {(r.doc_id, r.source): r.text for r in secrets.redact(docs, scored).collect()}
    want = {(r.doc_id, r.source): r.text for r in docs.collect()}
    want[(11, "c")] = want[(11, "c")].replace(KEY, "[SECRET]")
    assert out == want and secrets.redact_secrets(docs).count() == docs.count()
    assert secrets.redact_secrets(empty_documents(spark)).count() == 0


def test_short_values_and_neighbours(spark):
    long = "wJalrXUtnFEMIK7MDENGbPxRfiCYzz"
    texts = {1: 'password = "hunter2x9"', 2: "db_token: a8Xk20qz, done", 3: "pwd='p!ss$w0rd@x.y'", 4: f"AWS_SECRET_ACCESS_KEY={long}",
             5: "DATABASE_PASSWORD: tr0ub4dor&3.", 9: "/x?token=ab12cd34&x=1", 6: 'api_key=>"k3yk3y"', 7: "say password here or hunter2x9", 8: f"{long} {long} aaaaaaaaaaaaaaaa"}
    want = {1: "hunter2x9", 2: "a8Xk20qz", 3: "p!ss$w0rd@x.y", 4: long, 5: "tr0ub4dor&3", 9: "ab12cd34", 6: "k3yk3y"}
    docs = spark.createDataFrame([(i, t, "a") for i, t in texts.items()], "doc_id long, text string, source string")
    found = secrets.findings(docs)
    rows = found.collect()
    assert all(texts[r.id][r.start:].startswith(r.found) and texts[r.id][:r.start][-64:] == r.before
               and texts[r.id][r.start + len(r.found):][:32] == r.behind for r in rows)
    assert {i for i, v in want.items() if v in [r.found for r in rows if r.id == i]} == set(want) and not [r for r in rows if r.id == 7]
    labels = {(r.id, r.found): r.label for r in secrets.label_findings(secrets.with_features(found)).collect()}
    assert all(labels[(i, v)] == 1 for i, v in want.items())
    clean = {r.doc_id: r.text for r in secrets.redact_secrets(docs).collect()}
    assert all(clean[i] == texts[i].replace(v, "[SECRET]") for i, v in want.items()) and clean[7] == texts[7]
