"""Deterministic sharded WARC archives: range-sorted records, files rolled by compressed size, manifest commit."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import date as _date

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statlake.llm.common import scratch, sliced

#: A file is closed once it holds this many compressed bytes; payloads from this size on are stored once.
ROLL_BYTES, MIN_REVISIT_BYTES = 32 << 20, 1000
#: Date of every record unless the caller gives one: archives depend on their rows only.
DATE = _date(2024, 1, 1)
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # RFC 4122: URL


def payloads(pages: DataFrame) -> DataFrame:
    """(page_id, same, refers_to, url, payload): first the decisions (payload null), then the records, for one sort by key.

    Equal payloads (``same``: SHA-256) of at least MIN_REVISIT_BYTES refer to
    the largest page_id among them; rows that share that page_id, and rows of
    a group without any page_id, are stored whole. The decisions come from a
    table without the payloads, so these are shuffled once, by the range sort.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
                        F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "utf-8").alias("payload"))
    rows = rows.withColumn("same", F.unhex(F.sha2("payload", 256)))
    narrow = rows.where(F.octet_length("payload") >= MIN_REVISIT_BYTES).select("page_id", "same").distinct()
    groups = narrow.groupBy("same").agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1").select("same", "top")
    later = F.col("top").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("top")))
    decisions = narrow.join(groups, "same").where(later).select(
        "page_id", "same", F.col("top").alias("refers_to"), F.lit("").alias("url"), F.lit(None).cast("binary").alias("payload"))
    return decisions.unionAll(rows.select("page_id", "same", F.lit(None).cast("long"), "url", "payload"))


def _record_id(page_id: int | None, digest: str, url: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{page_id}|{digest}|{url}')}>"


def _header_text(value: str) -> str:
    """A header value on one line: white space and control characters percent-coded."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None, day: str) -> bytes:
    """One record as a gzip member of its own; headers and digests are made anew from the row. With ``refers_to``: a revisit."""
    digest, head = hashlib.sha1(payload).hexdigest(), _HTTP % len(payload)
    kind, block = ("response", head + payload) if refers_to is None else ("revisit", head)
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_record_id(page_id, digest, url)}", f"WARC-Date: {day}T00:00:00Z",
             f"WARC-Target-URI: {_header_text(url)}", f"WARC-Payload-Digest: sha1:{digest}",
             f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}", "Content-Type: application/http;msgtype=response",
             f"Content-Length: {len(block)}"]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {_PROFILE}", f"X-Refers-To-Page-ID: {refers_to}", f"X-Payload-Length: {len(payload)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)  # gzip with no time or name: the same bytes for the same record
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


class _Roller:
    """Writes records to files under temporary names; ``finish`` moves each to its final name."""

    def __init__(self, root: str, part: int, roll_bytes: int) -> None:
        self.files, self.root = fs.FileSystem.from_uri(root)
        self.part, self.roll_bytes, self.nth, self.out, self.done = part, roll_bytes, 0, None, []

    def write(self, data: bytes) -> None:
        if self.out is None:
            self.name = f"part-{self.part:06d}-{self.nth:05d}.warc.gz"
            self.temporary = f"{self.root}/_temporary/{self.name}.{uuid.uuid4().hex}"
            self.out, self.size, self.records, self.digest = self.files.open_output_stream(self.temporary, compression=None), 0, 0, hashlib.sha256()
        self.out.write(data)
        self.digest.update(data)
        self.size += len(data)
        self.records += 1
        if self.size >= self.roll_bytes:
            self.finish()

    def finish(self) -> None:
        if self.out is None:
            return
        self.out.close()
        self.files.move(self.temporary, f"{self.root}/{self.name}")  # a second attempt writes and moves the same bytes
        self.done.append((self.name, self.records, self.size, self.digest.hexdigest()))
        self.out, self.nth = None, self.nth + 1


def write_warc(pages: DataFrame, root: str, roll_bytes: int = ROLL_BYTES, day: str = DATE.isoformat()) -> DataFrame:
    """Write every row of ``pages`` as a WARC record under ``root`` (a folder or URI all executors see); the manifest.

    Records are range-sorted by page_id and each range is written by one task
    as files of about ``roll_bytes``. A file is written under a temporary name
    and moved when it is complete, so a lost task leaves no half file under a
    final name and its next attempt puts the same bytes there. The manifest
    (name, records, bytes, sha256) is committed last, with rows for committed
    files only; readers go by the manifest. Null html: an empty payload; null
    url: an empty one; null page_ids sort first; repeated rows are records of
    their own; other columns are ignored; an empty table gives an empty manifest.
    """
    spark = pages.sparkSession
    fs.FileSystem.from_uri(root)[0].create_dir(f"{fs.FileSystem.from_uri(root)[1]}/_temporary", recursive=True)
    rows = payloads(pages).repartitionByRange("page_id", "same").sortWithinPartitions(
        "page_id", "same", F.col("payload").isNotNull(), "url")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        roller, revisit = _Roller(root, TaskContext.get().partitionId(), roll_bytes), (None, None, None)
        for batch in sliced(batches, 256):
            for page, same, refers, url, payload in zip(*(batch.column(c).to_pylist() for c in ("page_id", "same", "refers_to", "url", "payload"))):
                if payload is None:  # the rows of this key that follow are revisits
                    revisit = (page, same, refers)
                else:
                    to = revisit[2] if revisit[:2] == (page, same) else None
                    roller.write(record(page, url, payload, to, day))
        roller.finish()
        columns = list(zip(*roller.done)) or [[]] * 4
        yield pa.record_batch([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()),
                               pa.array(columns[3], pa.string())], names=["name", "records", "bytes", "sha256"])

    manifest = rows.mapInArrow(write, "name string, records long, bytes long, sha256 string")
    manifest.write.mode("overwrite").parquet(f"{root}/_manifest")
    return spark.read.schema(manifest.schema).parquet(f"{root}/_manifest")


def _members(stream) -> Iterator[bytes]:
    """The gzip members of a stream, one record each, read piece by piece."""
    left = b""
    while True:
        unpacker, out = zlib.decompressobj(31), []
        while not unpacker.eof:
            piece = left or stream.read(1 << 20)
            if not piece:
                if out:
                    raise ValueError("truncated archive")
                return
            left = b""
            out.append(unpacker.decompress(piece))
        left = unpacker.unused_data
        yield b"".join(out)


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record; the block is checked against its length and digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    if headers["WARC-Block-Digest"] != f"sha1:{hashlib.sha1(block).hexdigest()}" or rest[len(block):] != b"\r\n\r\n":
        raise ValueError(f"broken record {headers.get('WARC-Record-ID')}")
    return headers, block


def read_warc(spark: SparkSession, root: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url) of every record in the manifest's files.

    A response's payload is taken from its block and its digest computed from
    those bytes; a revisit's come from its headers. A file that differs from
    its manifest row, or a record that differs from its digests, raises.
    """
    names = spark.read.parquet(f"{root}/_manifest").select("name", "sha256")
    tasks = max(1, min(names.count(), 10_000))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = fs.FileSystem.from_uri(root)
        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                            ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())])
        for batch in batches:
            for name, expected in zip(batch.column("name").to_pylist(), batch.column("sha256").to_pylist()):
                rows, digest = [], hashlib.sha256()
                with files.open_input_stream(f"{base}/{name}", compression=None) as raw:
                    class Counted:
                        @staticmethod
                        def read(n: int) -> bytes:
                            data = raw.read(n)
                            digest.update(data)
                            return data

                    for member in _members(Counted):
                        headers, block = parse(member)
                        kind, claimed = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        page = int(headers["X-Page-ID"]) if "X-Page-ID" in headers else None
                        if kind == "response":
                            payload = block.partition(b"\r\n\r\n")[2]
                            size, refers, got = len(payload), None, hashlib.sha1(payload).hexdigest()
                            if got != claimed:
                                raise ValueError(f"payload of page {page} differs from its digest")
                        else:
                            size, refers, got = int(headers["X-Payload-Length"]), int(headers["X-Refers-To-Page-ID"]), claimed
                        rows.append((page, size, got, kind, refers, headers["WARC-Target-URI"]))
                        if len(rows) >= 1024:
                            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                            rows = []
                if digest.hexdigest() != expected:
                    raise ValueError(f"{name} differs from the manifest")
                if rows:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return (names.repartition(tasks, "name").mapInArrow(
        read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"))


def archive_report(pages: DataFrame, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Writes ``pages`` to a new folder in the cluster's shared folder and reads the archives back."""
    spark = pages.sparkSession
    root = scratch(spark, "warc")
    write_warc(pages, root, roll_bytes)
    return read_warc(spark, root)


ORACLE_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS payload_digest,
             CASE WHEN octet_length(payload) >= 1000 THEN max(page_id) OVER (PARTITION BY payload) END AS top FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < top THEN top END AS refers_to FROM d
"""
