"""WARC archives: write records, index them, read selected records by coalesced byte ranges.

Writing: of rows with equal payloads of at least ``min_revisit`` bytes the one of the smallest id is a response
record, the others revisit it; every task writes archives of its own (one gzip member per record) under
fresh names in the shared folder, and only the files in the committed manifest count, so retried or
speculative tasks leave nothing that is read.  Indexing: one row per record with file, offset, length,
URL and digest.  Reading: selected index rows are range-partitioned by (file, offset); each task
reads near neighbours in one request, decodes the members and checks the payload digests.

Files are opened with ``pyarrow.fs`` from their URI (file, hdfs, s3, ...), on the executors only.

Results: a null payload is written empty; a null URL has no target header; control characters and blanks in
URLs are percent-encoded; a null id is written as such and never referred to unless no row with that payload
has an id; rows that share the smallest id are all responses; an empty table gives no archives and
an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldframe.llm.common import Scratch, table

INDEX = ("file string, offset long, length long, url string, digest string, record_type string, page_id long, "
         "refers_to long, block_length long")
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _filesystem(uri: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri)


def encode_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None,
                  date: str) -> bytes:
    """One record as a gzip member."""
    block = _HTTP % len(payload) + (payload if refers_to is None else b"")
    head = ["WARC/1.0", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}",
            f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response",
            f"Content-Length: {len(block)}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    z = zlib.compressobj(3, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n") + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def write_warc(pages: DataFrame, folder: str, scratch: Scratch, min_revisit: int = 100, max_bytes: int = 256 << 20,
               date: str = "1970-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url",
               payload_col: str = "html") -> DataFrame:
    """Writes the archives below ``folder``; returns the committed manifest (file, records, bytes)."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("payload"),
                        F.sha2(payload, 256).alias("digest"))
    again = (rows.where(F.octet_length("payload") >= min_revisit).groupBy("digest")
             .agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first"))
    # response and revisit: a join on the digests that occur again; AQE splits a digest of many rows
    rows = rows.join(again, "digest", "left").select(
        "id", "url", "payload", "digest", F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, out = [], None
        filesystem, base = _filesystem(folder)
        try:
            for batch in batches:
                for page, url, body, digest, refers in zip(*(c.to_pylist() for c in batch.columns)):
                    if out is not None and files[-1][2] >= max_bytes:
                        out.close()
                        out = None
                    if out is None:
                        name = f"{uuid.uuid4().hex}.warc.gz"
                        filesystem.create_dir(base, recursive=True)
                        out = filesystem.open_output_stream(f"{base}/{name}", compression=None)
                        files.append([f"{folder}/{name}", 0, 0])
                    member = encode_record(page, url, body, digest, refers, date)
                    out.write(member)
                    files[-1][1] += 1
                    files[-1][2] += len(member)
        finally:
            if out is not None:
                out.close()
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in files], pa.string()), pa.array([f[1] for f in files], pa.int64()),
                                          pa.array([f[2] for f in files], pa.int64())], names=["file", "records", "bytes"])

    return scratch.write(rows.mapInArrow(run, "file string, records long, bytes long"), "manifest")


def _members(stream, chunk: int = 1 << 20, keep: int = 1 << 16) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, first bytes) of the gzip members of a file, in bounded memory."""
    at = start = 0
    data, z, head = b"", None, b""
    while True:
        if not data:
            data = stream.read(chunk)
            if not data:
                if z is not None:
                    raise ValueError("archive ends within a record")
                return
        if z is None:
            z, head, start = zlib.decompressobj(31), b"", at
        part = z.decompress(data, chunk)
        if len(head) < keep:
            head += part[:keep - len(head)]
        rest = z.unused_data if z.eof else z.unconsumed_tail
        at += len(data) - len(rest)
        data = rest
        if z.eof:
            yield start, at - start, head
            z = None


def _fields(head: bytes) -> dict[str, str]:
    lines = head.partition(b"\r\n\r\n")[0].decode("utf-8", "replace").split("\r\n")
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def _page(uri: str | None) -> int | None:
    digits = (uri or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def index_warc(manifest: DataFrame, scratch: Scratch) -> DataFrame:
    """The written index of all records of the files."""
    schema = pa.schema([(n, pa.string() if t == "string" else pa.int64()) for n, t in (x.split() for x in INDEX.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                filesystem, path = _filesystem(file)
                rows = []
                with filesystem.open_input_stream(path, compression=None) as stream:
                    for offset, length, head in _members(stream):
                        f = _fields(head)
                        rows.append((file, offset, length, f.get("warc-target-uri"), f["warc-payload-digest"].removeprefix("sha256:"),
                                     f["warc-type"], _page(f["warc-record-id"]), _page(f.get("warc-refers-to")), int(f["content-length"])))
                        if len(rows) >= 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    # a given number is not merged by adaptive execution, which would read all archives in one task
    files = manifest.select("file").repartition(max(1, min(manifest.count(), 1 << 16)), "file")
    return scratch.write(files.mapInArrow(run, INDEX), "index")


def decode_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload (what follows the HTTP header) of a gzip member."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = _fields(head + b"\r\n\r\n")
    return fields, rest[:int(fields["content-length"])].partition(b"\r\n\r\n")[2]


def read_records(index: DataFrame, max_gap: int = 1 << 16, max_range: int = 8 << 20, payload: bool = False) -> DataFrame:
    """Reads the records of the index rows; adds payload_bytes and payload_digest (both of what was read;
    null for revisits, which hold none) and, if asked for, the payload."""
    columns = [f.name for f in index.schema]
    kinds = f"page_id long, record_type string, refers_to long, digest string, payload_bytes long, payload_digest string{', payload binary' * payload}"

    def ranges(batch: dict[str, list]) -> Iterator[list[int]]:
        """Row numbers of one request after the other."""
        own: list[int] = []
        for i, (file, offset, length) in enumerate(zip(batch["file"], batch["offset"], batch["length"])):
            if own and (file != batch["file"][own[-1]] or offset > batch["offset"][own[-1]] + batch["length"][own[-1]] + max_gap
                        or offset + length - batch["offset"][own[0]] > max_range):
                yield own
                own = []
            own.append(i)
        if own:
            yield own

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, opened = None, None
        for batch in batches:
            b = dict(zip(columns, (c.to_pylist() for c in batch.columns)))
            for own in ranges(b):
                if b["file"][own[0]] != name:
                    if opened is not None:
                        opened.close()
                    filesystem, path = _filesystem(name := b["file"][own[0]])
                    opened = filesystem.open_input_file(path)
                first = b["offset"][own[0]]
                data = opened.read_at(b["offset"][own[-1]] + b["length"][own[-1]] - first, first)
                rows = []
                for i in own:
                    at = b["offset"][i] - first
                    _, body = decode_record(data[at:at + b["length"][i]])
                    size = digest = None
                    if b["record_type"][i] == "response":
                        size, digest = len(body), hashlib.sha256(body).hexdigest()
                        if digest != b["digest"][i]:
                            raise ValueError(f"payload of {b['file'][i]} at {b['offset'][i]} has another digest")
                    rows.append((b["page_id"][i], b["record_type"][i], b["refers_to"][i], b["digest"][i], size, digest,
                                 *([body] if payload else [])))
                types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)],
                                                 names=[k.split()[0] for k in kinds.split(", ")])
        if opened is not None:
            opened.close()

    return index.repartitionByRange("file", "offset").sortWithinPartitions("file", "offset").mapInArrow(run, kinds)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    manifest = write_warc(table(spark, sf_dir, "pages").select("page_id", "url", "html"), scratch.path("archives"), scratch)
    read = scratch.write(read_records(index_warc(manifest, scratch)), "read")
    own = read.where("record_type = 'response'")
    first = own.groupBy(F.col("page_id").alias("p"), F.col("digest").alias("d")).agg(
        F.min("payload_bytes").alias("b"), F.min("payload_digest").alias("pd"))
    again = read.where("record_type = 'revisit'").join(first, (F.col("refers_to") == F.col("p")) & (F.col("digest") == F.col("d")), "left")
    return own.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").unionByName(
        again.select("page_id", F.col("b").alias("payload_bytes"), F.col("pd").alias("payload_digest"), "record_type", "refers_to"))
