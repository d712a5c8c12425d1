"""WARC: round trip, revisits, ranges, odd rows."""

import gzip
import hashlib
import io

import pytest

from foldframe.llm import warc
from foldframe.llm.common import Scratch
from pyspark.sql import functions as F

SCHEMA = "page_id long, url string, html string, digest string, file string, offset string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)


BIG = "<p>" + "längst " * 40
ROWS = [(5, "http://a/1", BIG), (2, "http://a/2 b\r\nX: y", BIG), (9, None, BIG), (1, "u", None), (3, "u", ""), (4, "u", "short"),
        (6, "u", "short"), (7, "u", "a\r\n\r\nb" * 50), (8, "u", BIG * 3000), (None, "u", BIG), (2, "u", BIG), (11, "u", "WARC/1.0\r\n\r\n" * 30)]


def run(spark, df, **options):
    s = Scratch(spark, "t")
    manifest = warc.write_warc(df, s.path("archives"), s, **options)
    return manifest, warc.index_warc(manifest, s)


def test_round_trip(spark):
    df = pages(spark, ROWS)
    manifest, index = run(spark, df.repartition(3), max_bytes=500)
    assert manifest.agg(F.sum("records")).first()[0] == len(ROWS) and manifest.count() > 3
    got = warc.read_records(index, payload=True, max_gap=0, max_range=300).collect()
    small = warc.read_records(index, payload=True).collect()
    assert sorted(map(str, got)) == sorted(map(str, small))
    kinds = sorted((r.page_id or -1, r.record_type, r.refers_to) for r in got)
    assert kinds == sorted([(5, "revisit", 2), (2, "response", None), (2, "response", None), (9, "revisit", 2), (-1, "revisit", 2),
                            (1, "response", None), (3, "response", None), (4, "response", None), (6, "response", None),
                            (7, "response", None), (8, "response", None), (11, "response", None)])
    want = {i: (h or "").encode() for i, _, h in ROWS}
    for r in got:
        if r.record_type == "response":
            assert bytes(r.payload) == want[r.page_id] and r.payload_digest == hashlib.sha256(want[r.page_id]).hexdigest()
    # any selection of the index can be read alone
    assert [r.page_id for r in warc.read_records(index.where("page_id = 8")).collect()] == [8]


def test_files_are_plain_gzip_members(spark):
    manifest, _ = run(spark, pages(spark, ROWS[:3]))
    path = manifest.first()["file"].removeprefix("file:")
    text = gzip.open(io.BytesIO(open(path, "rb").read())).read()
    assert text.startswith(b"WARC/1.0\r\n") and b"\nX: y" not in text


def test_damage_is_noticed():
    member = warc.encode_record(1, "u", b"abc" * 100, "0" * 64, None, "d")
    assert list(warc._members(io.BytesIO(member * 3), chunk=7, keep=40))[1][:2] == (len(member), len(member))
    with pytest.raises(ValueError):
        list(warc._members(io.BytesIO(member[:-4])))


def test_empty(spark, tmp_path):
    s = "page_id long, url string, html string"
    spark.createDataFrame([], s).write.parquet(f"{tmp_path}/pages.parquet")
    assert warc.op1_warc(spark, str(tmp_path)).count() == 0
