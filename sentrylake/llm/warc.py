"""Deterministic sharded WARC archives, written and read back.

Records are range-sorted by (url, page_id); a shard's writer rolls to a new file once the compressed size passes ROLL_BYTES, so
a file holds whole records, each a gzip member of its own. Headers, lengths and digests are made anew from the payload.
Files get a temporary name; a manifest of the shard follows and only files that a manifest names are then moved to their
final names, so a task that is lost or runs twice leaves nothing that counts; what it left is deleted. The manifest (name, records,
bytes, digest of each file) is kept beside the files, and ``verify`` holds the files against it. Equal input gives equal bytes.

A file begins with a warcinfo record. A response's block is an HTTP response with the payload; a revisit's is its head alone.

The payload is the html in UTF-8 (null: empty). Of records with equal payloads of MIN_REVISIT bytes or more, the one with
the smallest page_id is a response and the others are revisits of it, without the payload. A record without page_id is a response and
nobody's; of records that repeat a page_id, all with the smallest are responses. A null url is written as an empty target.
"""

from __future__ import annotations

import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Shared, ship

MIN_REVISIT = 100
ROLL_BYTES = 32 << 20
#: Pages carry no date of their own.
DATE = "2000-01-01T00:00:00Z"
MANIFEST = "name string, records long, bytes long, sha256 string"
FIELDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def revisits(pages: DataFrame, shared: Shared) -> DataFrame:
    """``pages`` with ``digest``, ``size`` and ``refers_to``. Only digests that occur twice are looked up; they are written
    first, so adaptive execution splits a payload that a third of the pages share."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    made = pages.select("page_id", "url", "html", F.sha2(payload, 256).alias("digest"), F.length(payload).cast("long").alias("size"))
    seen = made.filter(F.col("size") >= MIN_REVISIT).groupBy("digest").agg(F.count("*").alias("n"), F.min("page_id").alias("first_id"))
    seen = shared.save(seen.filter("n > 1").drop("n"), "payloads")
    out = made.join(seen, "digest", "left")
    return out.withColumn("refers_to", F.when(F.col("first_id") != F.col("page_id"), F.col("first_id"))).drop("first_id")


def http_head(size: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()


def info(name: str) -> bytes:
    """The record that a file begins with."""
    block = b"software: sentrylake\r\nformat: WARC File Format 1.1\r\n"
    head = [
        "WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'file:{name}')}>", f"WARC-Date: {DATE}", f"WARC-Filename: {name}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record. The date is fixed, for the same input must give the same bytes."""
    kind = "response" if refers_to is None else "revisit"
    block = http_head(len(payload)) + (payload if refers_to is None else b"")
    uid = uuid.uuid5(uuid.NAMESPACE_URL, f"page:{digest if page_id is None else page_id}")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{uid}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        *([] if page_id is None else [f"X-Page-ID: {page_id}"]),
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
    ]
    if refers_to is not None:
        head += [
            f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}')}>",
            f"X-Refers-To-Page-ID: {refers_to}",
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        ]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(raw: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def write(rows: DataFrame, folder: str, shards: int, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write ``revisits`` rows under ``folder`` (any place that Spark's and Arrow's file systems share); returns the manifest."""
    spark = rows.sparkSession
    ship(spark)
    ordered = rows.select("page_id", "url", "html", "digest", "refers_to").repartitionByRange(shards, "url", "page_id").sortWithinPartitions("url", "page_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem
        from pyspark import TaskContext

        context = TaskContext.get()
        shard, attempt = context.partitionId(), context.taskAttemptId()
        fs, root = FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        made, held, size, count = [], [], 0, 0

        def name_of() -> str:
            return f"part-{shard:06d}-{len(made):05d}.warc.gz"

        def roll() -> None:
            nonlocal held, size, count
            name = name_of()
            temp = f"{name}.tmp-{attempt}"
            data = b"".join(held)
            with fs.open_output_stream(f"{root}/{temp}", compression=None) as out:
                out.write(data)
            made.append({"name": name, "temp": temp, "records": count, "bytes": len(data), "sha256": hashlib.sha256(data).hexdigest()})
            held, size, count = [], 0, 0

        for batch in batches:
            for r in zip(*[batch.column(c) for c in ("page_id", "url", "html", "digest", "refers_to")], strict=True):
                page_id, url, html, digest, refers_to = (x.as_py() for x in r)
                if not held:
                    held.append(_member(info(name_of())))
                    size += len(held[-1])
                held.append(_member(record(page_id, url, (html or "").encode(), digest, refers_to)))
                size += len(held[-1])
                count += 1
                if size >= roll_bytes:
                    roll()
        if held:
            roll()
        yield pa.RecordBatch.from_arrays(
            [pa.array([m[k] for m in made], t) for k, t in (("name", pa.string()), ("temp", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string()))],
            names=["name", "temp", "records", "bytes", "sha256"],
        )

    return ordered.mapInArrow(run, "name string, temp string, records long, bytes long, sha256 string")


def commit(manifest: DataFrame, folder: str) -> None:
    """Move the files of a written manifest to their final names; doing so again does nothing."""
    spark = manifest.sparkSession
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem, FileType

        fs, root = FileSystem.from_uri(folder)
        for batch in batches:
            for m in batch.to_pylist():
                if fs.get_file_info(f"{root}/{m['temp']}").type != FileType.NotFound:
                    fs.move(f"{root}/{m['temp']}", f"{root}/{m['name']}")
            yield batch.select(["name"])

    manifest.mapInArrow(run, "name string").agg(F.count("*")).first()
    manifest.select("name", "records", "bytes", "sha256").write.mode("overwrite").json(f"{folder}/_manifest")
    _sweep(spark, folder)
    total = manifest.agg(F.count("*"), F.coalesce(F.sum("records"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(f"{folder}/_MANIFEST.json")
    out = at.getFileSystem(conf).create(at, True)
    out.write(bytearray(json.dumps(dict(zip(("files", "records", "bytes"), total, strict=True))).encode()))
    out.close()


def _sweep(spark, folder: str) -> None:
    """Delete the temporary files that lost attempts left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem, FileType

        fs, root = FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                name = f"{root}/{path.rsplit('/', 1)[-1]}"
                if fs.get_file_info(name).type != FileType.NotFound:
                    fs.delete_file(name)
            yield batch

    left = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz.tmp-*").load(folder).select("path")
    left.mapInArrow(run, "path string").agg(F.count("*")).first()


def verify(spark, folder: str) -> DataFrame:
    """(name, problem) for every file that is missing, not in the manifest, or not the bytes that it names; an empty file counts as missing. Only
    digests are joined."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)
    there = files.select(F.substring_index("path", "/", -1).alias("name"), F.sha2("content", 256).alias("found"))
    named = spark.read.schema(MANIFEST).json(f"{folder}/_manifest").select("name", "sha256")
    problem = F.when(F.col("found").isNull(), "missing").when(F.col("sha256").isNull(), "not in the manifest").when(F.col("found") != F.col("sha256"), "changed")
    return named.join(there, "name", "full").select("name", problem.alias("problem")).filter("problem IS NOT NULL")


def read(spark, folder: str) -> DataFrame:
    """One row per record of the archives in ``folder``, from the bytes of the files."""
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for h in members(content.as_buffer()):
                    if h["WARC-Type"] == "warcinfo":
                        continue
                    back, own = h.get("X-Refers-To-Page-ID"), h.get("X-Page-ID")
                    rows.append((None if own is None else int(own), int(h["X-Payload-Length"]), h["WARC-Payload-Digest"].removeprefix("sha256:"), h["WARC-Type"], None if back is None else int(back)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)],
                    names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
                )

    return files.mapInArrow(run, FIELDS)


def members(buffer) -> Iterator[dict]:
    """``read_records`` over a large buffer, fed in pieces."""
    source, tail, z, raw = io.BytesIO(buffer), b"", None, []
    while True:
        chunk = tail or source.read(1 << 16)
        tail = b""
        if not chunk:
            if raw:
                raise ValueError("archive ends within a record")
            return
        if z is None:
            z, raw = zlib.decompressobj(31), []
        raw.append(z.decompress(chunk))
        if z.eof:
            tail, done = z.unused_data, b"".join(raw)
            z, raw = None, []
            yield parse(done)


def parse(raw: bytes) -> dict:
    head, _, rest = raw.partition(b"\r\n\r\n")
    h = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(h["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n" or h["WARC-Block-Digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise ValueError(f"broken record {h.get('WARC-Record-ID')}")
    payload = block.partition(b"\r\n\r\n")[2]
    if h["WARC-Type"] == "response" and h["WARC-Payload-Digest"] != f"sha256:{hashlib.sha256(payload).hexdigest()}":
        raise ValueError(f"payload of {h.get('WARC-Record-ID')} does not match its digest")
    return h | {"block": block, "payload": payload}


def archive(pages: DataFrame, shards: int | None = None, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write ``pages`` and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    shared = Shared(spark, "warc")
    rows = revisits(pages, shared)
    folder = shared.path("archive")
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    manifest = shared.save(write(rows, folder, n, roll_bytes), "manifest")
    commit(manifest, folder)
    return read(spark, folder)


SQL = r"""
WITH p AS (
  SELECT page_id, sha256(coalesce(html, '')) AS payload_digest, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes
  FROM pages
), f AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM f
"""
