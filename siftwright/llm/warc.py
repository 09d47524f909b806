"""WARC archives, written with an index first and read back by ranges.

Writing: equal payloads (by SHA-256 and length) of some size or more keep one
response, that of the least page id; the others become revisit records. Each
task writes gzip members, one per record, to a file of its own name and attempt
in a shared folder, and returns the index rows: file, offset, length, URL,
digest. The index table is committed by Spark, so only files of successful
attempts are ever referred to.

Reading: index rows of the selected records, sorted by file and offset, are
coalesced into ranges (small gaps are read over, spans are bounded), and each
range is read once and cut into records.

Null html is an empty payload; a null URL leaves out its header; line breaks in
URLs are percent-encoded. A null page id is written as such, takes part in
revisits, and is never the response of a group that has another. Rows that
repeat the least page id are all responses. An empty table gives no files and
an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwright.llm.common import fresh_path, staged, table

#: Bytes of a file before the next one, of a read, of a gap that is read over,
#: and of one task's share when reading.
FILE_BYTES, READ_BYTES, GAP_BYTES, TASK_BYTES = 256 << 20, 8 << 20, 64 << 10, 32 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "file string, offset long, length long, page_id long, url string, digest string, record_type string"


def open_store(folder: str):
    """(file system, path) of a folder in any store that Arrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def urn(page: int | None) -> str:
    return f"<urn:page:{'null' if page is None else page}>"


def page_of(value: str) -> int | None:
    tail = value.strip("<>").rpartition(":")[2]
    return None if tail == "null" else int(tail)


def record(page: int | None, url: str | None, payload: bytes, first: int | None, revisit: bool, date: str = DATE) -> tuple[bytes, str]:
    """One WARC/1.1 record and its payload digest."""
    digest = digest_of(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {urn(page)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        head += [f"WARC-Refers-To: {urn(first)}", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", digest


def parse(raw: bytes) -> dict:
    """Headers, block and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b": ")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length: "))
    return {"fields": fields, "payload": payload, "payload_bytes": size}


def with_firsts(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, first, revisit). Only groups of two or more are
    joined back; the group table has one row for each."""
    rows = pages.withColumn("sha_", F.sha2("payload", 256)).withColumn("size_", F.octet_length("payload"))
    groups = rows.select("page_id", "sha_", "size_").groupBy("sha_", "size_").agg(F.min("page_id").alias("first"), F.count("*").alias("n_"))
    groups = groups.where(F.col("n_") > 1).where(F.col("size_") >= min_bytes)
    groups = groups.select(F.col("sha_").alias("s2_"), F.col("size_").alias("z2_"), "first")
    joined = rows.join(groups, (F.col("sha_") == F.col("s2_")) & (F.col("size_") == F.col("z2_")), "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "payload", "first", revisit.alias("revisit"))


def write(pages: DataFrame, folder: str, min_bytes: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes records of (page_id, url, payload) and returns the staged index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        out, name, at = None, "", 0
        names = INDEX.replace(" string", "").replace(" long", "").split(", ")
        kinds = [pa.string() if " string" in x else pa.int64() for x in INDEX.split(", ")]
        try:
            for batch in batches:
                rows = []
                for page, url, payload, first, revisit in zip(*(c.to_pylist() for c in batch.columns)):
                    if out is None or at >= file_bytes:
                        if out is not None:
                            out.close()
                        store.create_dir(root, recursive=True)
                        name, at = f"part-{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(posixpath.join(root, name), compression=None)
                    raw, digest = record(page, url, payload, first, revisit)
                    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                    member = packer.compress(raw) + packer.flush()
                    out.write(member)
                    rows.append((name, at, len(member), page, url, digest, "revisit" if revisit else "response"))
                    at += len(member)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
        finally:
            if out is not None:
                out.close()

    return staged(with_firsts(pages, min_bytes).mapInArrow(run, INDEX), "warc-index")


def ranges(rows: list[tuple], read_bytes: int = READ_BYTES, gap: int = GAP_BYTES) -> Iterator[list[tuple]]:
    """Runs of sorted (file, offset, length, ...) rows that one read covers."""
    run: list[tuple] = []
    for row in rows:
        if run and (row[0] != run[0][0] or row[1] - (run[-1][1] + run[-1][2]) > gap or row[1] + row[2] - run[0][1] > read_bytes):
            yield run
            run = []
        run.append(row)
    if run:
        yield run


READ = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean"


def read(index: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """Records of the index rows given; ``intact`` tells whether the payload of
    a response has its digest."""
    total = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(index.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_BYTES))
    wanted = index.select("file", "offset", "length").repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        names = [x.split(" ")[0] for x in READ.split(", ")]
        kinds = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}[x.split(" ")[1]] for x in READ.split(", ")]
        for batch in batches:
            for group in ranges(list(zip(*(c.to_pylist() for c in batch.columns)))):
                begin = group[0][1]
                with store.open_input_file(posixpath.join(root, group[0][0])) as f:
                    f.seek(begin)
                    span = f.read(group[-1][1] + group[-1][2] - begin)
                out = []
                for _, offset, length in group:
                    got = parse(zlib.decompress(span[offset - begin : offset - begin + length], 31))
                    fields, payload = got["fields"], got["payload"]
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    revisit = fields["WARC-Type"] == "revisit"
                    out.append((
                        page_of(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), payload if with_payload and not revisit else None,
                        got["payload_bytes"], digest, fields["WARC-Type"],
                        page_of(fields["WARC-Refers-To"]) if revisit else None, revisit or digest_of(payload) == digest,
                    ))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return wanted.mapInArrow(run, READ)


def op7_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")
    folder = fresh_path(spark, "warc")
    index = write(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload), folder)
    return read(index, folder, with_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact"
    )
