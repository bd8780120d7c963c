"""WARC archives with a two-level capture index.

Archives hold one gzip member a record.  Records with equal payloads are one response, of the smallest page_id, and
revisits of it.  The index sorts lines by the URL's key, host reversed (com,example)/path), into shards of gzip blocks;
each shard ends with its sparse directory, the first key and the place of every block, and a table names the shards with
their first keys.  A lookup binary-searches the shards and then the directory of one, reads one block (and those that go on
with the key) by range, and then the record by range.  No one ever holds more than the directory of one shard.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import math
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, qualified, tune

ENTRY = "key string, page_id long, url string, type string, digest string, file string, offset long, length long"
_FIELDS = [c.split()[0] for c in ENTRY.split(", ")]
#: One row for each shard of the index; offset and length are those of its directory.
SHARDS = "first_key string, shard string, offset long, length long, n_blocks long, n_lines long, record_bytes long"
_SHARD_FIELDS = [c.split()[0] for c in SHARDS.split(", ")]
#: Lines of an index block, and bytes at which an archive is full.
LINES, ARCHIVE_BYTES = 3000, 1 << 30
#: Bytes of records that a task reads back, and the least for which it is worth to start one.
READ_BYTES, LEAST_READ = 64 << 20, 1 << 20
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "<urn:page:{}>"


def reversed_host(url: str | None) -> str:
    """com,example)/path?query in lower-case host; no scheme, user, fragment, or default port; blanks and controls as %XX."""
    url = (url or "").strip()
    try:
        parts = urlsplit(url)
        host, port = (parts.hostname or ""), parts.port
    except ValueError:
        key = url
    else:
        key = ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "")
        key = f"{key}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")
    return _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", key)


def _line(x: str | None) -> str:
    return (x or "").replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One gzip member.  A revisit keeps the HTTP head, with the payload's length, and leaves out the payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to is not None else 'response'}", f"WARC-Record-ID: {_ID.format('' if page_id is None else page_id)}", f"WARC-Target-URI: {_line(url)}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {_ID.format(refers_to)}", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def parse(member: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """(WARC headers by lower-case name, HTTP head, payload) of a gzip member."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record here")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, http, payload


def _number(record_id: str | None) -> int | None:
    text = (record_id or "").removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text else None


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", lines: int = LINES) -> None:
    """Write a record for every row of pages(page_id, url, html) and the index over them.

    Null html is an empty payload; a null url has an empty target.  Payloads below least_bytes are all responses.  Rows
    repeated with their page_id are responses each or revisits each.  A null page_id is never the response that others
    refer to unless all rows of a payload lack it; then none of them is a revisit.
    """
    spark = pages.sparkSession
    tune(spark)
    folder = qualified(spark, folder)
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    hashed = pages.withColumn("sha", F.sha1(F.encode("html", "UTF-8")))
    slim = hashed.select("page_id", "sha", F.octet_length("html").alias("size"))
    first = slim.where(F.col("size") >= least_bytes).groupBy("sha").agg(F.min("page_id").alias("first"))
    # only revisits: what the wide rows are joined with is as small as it can be
    revisits = slim.join(first, "sha").where(~F.col("page_id").eqNullSafe(F.col("first")) & F.col("first").isNotNull()).select(F.col("page_id").alias("_page"), F.col("sha").alias("_sha"), "first").distinct()
    rows = hashed.join(revisits, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("sha") == F.col("_sha")), "left").select("page_id", "url", "html", "first")

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = filesystem(f"{folder}/archives")
        out, at, name = None, 0, ""
        for b in batches:
            entries = []
            for page_id, url, html, refers in zip(*b.columns):  # a row at a time: texts of a batch never stand in a list
                page_id, url, refers = page_id.as_py(), url.as_py(), refers.as_py()
                if out is None or at >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    store.create_dir(path, recursive=True)
                    name, at = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}.warc.gz", 0
                    out = store.open_output_stream(f"{path}/{name}", compression=None)
                payload = html.as_buffer().to_pybytes()
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                member = record(page_id, url, payload, digest, refers, date)
                out.write(member)
                entries.append((reversed_host(url), page_id, url, "response" if refers is None else "revisit", digest, name, at, len(member)))
                at += len(member)
            if entries:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*entries), (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()))], names=_FIELDS)
        if out is not None:
            out.close()

    # written once: the index is sorted from the table of the archives that successful tasks wrote
    rows.mapInArrow(archive, ENTRY).write.mode("overwrite").parquet(f"{folder}/entries")
    entries = spark.read.schema(ENTRY).parquet(f"{folder}/entries")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = filesystem(f"{folder}/index")
        out, at, held, made, total, name = None, 0, [], [], [0, 0], ""

        def flush() -> None:
            nonlocal at
            block = gzip.compress("".join(x[1] for x in held).encode(), 6, mtime=0)
            out.write(block)
            made.append((held[0][0], at, len(block), len(held)))
            at += len(block)
            held.clear()

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if out is None:
                    store.create_dir(path, recursive=True)
                    name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}.idx"
                    out = store.open_output_stream(f"{path}/{name}", compression=None)
                held.append((row[0], row[0] + " " + json.dumps(dict(zip(_FIELDS[1:], row[1:])), ensure_ascii=False) + "\n"))
                total = [total[0] + 1, total[1] + row[-1]]
                if len(held) >= lines:
                    flush()
        if held:
            flush()
        if out is not None:
            directory = gzip.compress("".join(json.dumps(x, ensure_ascii=False) + "\n" for x in made).encode(), 6, mtime=0)
            out.write(directory)
            out.close()
            row = (made[0][0], name, at, len(directory), len(made), *total)
            yield pa.record_batch([pa.array([x], t) for x, t in zip(row, (pa.string(), pa.string(), *[pa.int64()] * 5))], names=_SHARD_FIELDS)

    entries.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id", "file", "offset").mapInArrow(blocks, SHARDS).write.mode("overwrite").parquet(f"{folder}/shards")


def _read(uri: str, offset: int, length: int) -> bytes:
    store, path = filesystem(uri)
    with store.open_input_file(path) as file:
        file.seek(offset)
        return file.read(length)


def _directory(folder: str, shard: str, offset: int, length: int) -> list[list]:
    """[first key, offset, length, lines] of each block of a shard."""
    return [json.loads(x) for x in gzip.decompress(_read(f"{folder}/index/{shard}", offset, length)).decode().split("\n") if x]


def _lines(block: bytes) -> Iterator[tuple[str, str]]:
    """(key, JSON) of each line; keys hold no blanks."""
    for line in gzip.decompress(block).decode().split("\n"):
        if line:
            key, _, rest = line.partition(" ")
            yield key, rest


class CaptureIndex:
    """Lookups by URL: binary search among shards and in a shard's directory, then range reads of a block and of the records.

    The driver holds one row for each shard (a task's part of the index), and the directories of a few shards.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.folder = qualified(spark, folder)
        self.rows = spark.read.schema(SHARDS).parquet(f"{self.folder}/shards").orderBy("first_key", "shard").collect()
        self.keys = [r.first_key for r in self.rows]
        self._blocks = lru_cache(maxsize=8)(lambda k: _directory(self.folder, self.rows[k].shard, self.rows[k].offset, self.rows[k].length))

    def captures(self, url: str) -> list[dict]:
        """Index entries of a URL, by page_id."""
        key, out = reversed_host(url), []
        at = max(0, bisect.bisect_left(self.keys, key) - 1)
        while at < len(self.rows) and self.keys[at] <= key:
            blocks = self._blocks(at)
            k = max(0, bisect.bisect_left(blocks, key, key=lambda x: x[0]) - 1)
            while k < len(blocks) and blocks[k][0] <= key:
                out += [json.loads(e) for x, e in _lines(_read(f"{self.folder}/index/{self.rows[at].shard}", blocks[k][1], blocks[k][2])) if x == key]
                k += 1
            at += 1
        return out

    def fetch(self, entry: dict) -> bytes:
        """The payload of a capture; of a revisit, empty."""
        return parse(_read(f"{self.folder}/archives/{entry['file']}", entry["offset"], entry["length"]))[2]


RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Every record that the index names, from the archives: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A response's digest and length are those of the payload read; a revisit's are those its head keeps.  Rows that were
    written with a repeated or null page_id come back one for one; an index without shards gives no rows.
    """
    folder = qualified(spark, folder)
    shards = spark.read.schema(SHARDS).parquet(f"{folder}/shards")
    size = shards.agg(F.count("*").alias("n"), F.coalesce(F.sum("record_bytes"), F.lit(0)).alias("bytes")).first()
    # by the bytes that tasks are to read, not by those of the index
    tasks = max(1, math.ceil(size.bytes / READ_BYTES), min(math.ceil(size.bytes / LEAST_READ), spark.sparkContext.defaultParallelism))

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                for _, offset, length, _ in _directory(folder, row["shard"], row["offset"], row["length"]):
                    got = [tuple(e[k] for k in ("file", "offset", "length")) for e in (json.loads(x) for _, x in _lines(_read(f"{folder}/index/{row['shard']}", offset, length)))]
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*got), (pa.string(), pa.int64(), pa.int64()))], names=["file", "offset", "length"])

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file = None, None
        for b in batches:
            rows = []
            for where, offset, length in zip(*(c.to_pylist() for c in b.columns)):
                if where != name:
                    if file is not None:
                        file.close()
                    store, path = filesystem(f"{folder}/archives/{where}")
                    name, file = where, store.open_input_file(path)
                file.seek(offset)
                fields, http, payload = parse(file.read(length))
                if fields["warc-type"] == "response":
                    size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
                else:
                    size = int(next(x.partition(b":")[2] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")))
                    digest = fields["warc-payload-digest"].partition(":")[2]
                rows.append((_number(fields["warc-record-id"]), size, digest, fields["warc-type"], _number(fields.get("warc-refers-to"))))
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))], names=[c.split()[0] for c in RESULT.split(", ")])
        if file is not None:
            file.close()

    named = shards.repartition(max(1, size.n)).mapInArrow(entries, "file string, offset long, length long")
    # stretches of files in order: reads run forward, and a large archive is not one task's
    return named.repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset").mapInArrow(records, RESULT)


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS h FROM p),
f AS (SELECT page_id, n, h, min(page_id) OVER (PARTITION BY h) AS first FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(generate_series(0, 31), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(1 + ((CAST('0x' || substr(h, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f
"""
