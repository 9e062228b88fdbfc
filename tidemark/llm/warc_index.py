"""WARC archives with revisit records and a two-level capture index.

Writing: each task writes its pages as one gzip-per-record archive. Of records with equal payloads that with the largest
page_id is a response and the others are revisits that refer to it; payloads below MIN_BYTES are always responses.

Index: captures (reversed-host URL key, then archive, offset) are range-sorted; each range is one index file of compressed
blocks of BLOCK captures. The sparse directory has a row for each block: its first key, and where it lies; beside each index file
lies that file's part of it. A lookup finds the range, binary-searches that range's directory for the block, binary-searches the
block, and then range-reads the record. Keys that are looked up come to the tasks in order, so a task holds one directory and one
block at a time.

Files are written under names of the task attempt and renamed when whole; only files named in the committed tables are read,
so a lost executor's half-written files don't count. Paths may be any that pyarrow's file systems open (file, hdfs, s3, gs).

Nulls: a null html is an empty payload; a null url has the empty key and no target header; a null page_id ranks below all and
is null again when read. Ties (equal payload and page_id): all are responses. Repeated rows are written and read each. Very
large pages are written whole. An empty table gives an empty result. Extra columns don't matter.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import re
import uuid
from base64 import b32encode
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import groupby
from urllib.parse import urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import keep, lookup, new_path

MIN_BYTES = 0
BLOCK = 500
DATE = "2024-01-01T00:00:00Z"


def url_key(url: str | None) -> str:
    """The sort key of a URL: host labels from the last on, port if not the scheme's own, then path and query; scheme, user,
    fragment and a leading www are left out, A-Z lower-cased in the host."""
    if not url:
        return ""
    try:
        parts = urlsplit(url)
        host, port = (parts.hostname or "").removeprefix("www."), parts.port
    except ValueError:  # not a URL: its own key
        return url
    if not host:
        return url
    said = ",".join(reversed(host.split("."))) + ("" if port in (None, {"http": 80, "https": 443}.get(parts.scheme)) else f":{port}")
    return f"{said}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def base32_sha1(payload: bytes) -> str:
    return b32encode(hashlib.sha1(payload).digest()).decode()


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _write(folder: str, name: str, chunks: Iterator[bytes]) -> None:
    """Writes a file under a passing name and renames it."""
    system, base = _open(folder)
    system.create_dir(base, recursive=True)
    passing = f"{base}/.{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(passing) as out:
        for chunk in chunks:
            out.write(chunk)
    system.move(passing, f"{base}/{name}")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC 1.1 record, gzipped on its own."""
    body = b"" if revisit else payload
    clean = re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", url) if url else url
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {clean}"] if url else []),
        f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}",
        *([f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if revisit else []),
        "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}",
    ]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n", 6, mtime=0)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """A record's headers and body."""
    head, _, rest = gzip.decompress(data).partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    return headers, rest[: int(headers["Content-Length"])]


def with_responses(pages: DataFrame, least: int = MIN_BYTES) -> DataFrame:
    """page_id, url, html (binary), sha1 and response (the largest page_id with this payload; null if the payload is too small)."""
    html = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("sha1", F.sha1("html"))
    small = rows.where(F.octet_length("html") >= least).select("sha1", "page_id")
    shared = keep(small.groupBy("sha1").agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sha1", "response"), "shared-payloads")
    return lookup(rows, shared, ["sha1"], small.count())


CAPTURES = "key string, archive string, offset bigint, length bigint, page_id bigint"


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes archives and returns the stored table of captures: CAPTURES."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        name = f"pages-{uuid.uuid4().hex}.warc.gz"
        captures: list[tuple] = []

        def chunks() -> Iterator[bytes]:
            at = 0
            for b in batches:
                for page_id, url, html, response in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "response")), strict=True):
                    revisit = response is not None and response != page_id
                    data = record(page_id, url, html, base32_sha1(html), response, revisit)
                    captures.append((url_key(url), name, at, len(data), page_id))
                    at += len(data)
                    yield data

        _write(folder, name, chunks())
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        for i in range(0, len(captures), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array([c[j] for c in captures[i : i + 10_000]], k) for j, k in enumerate(kinds)], [x.split()[0] for x in CAPTURES.split(", ")])

    return keep(with_responses(pages).mapInArrow(run, CAPTURES), "captures")


DIRECTORY_END = ".directory"
DIRECTORY = "part int, first string, last string, file string, offset bigint, length bigint, captures int"


def write_index(captures: DataFrame, folder: str, block: int = BLOCK) -> DataFrame:
    """Sorts captures into index files of compressed blocks and returns the stored directory: DIRECTORY."""
    partitions = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        part, name = TaskContext.get().partitionId(), f"captures-{uuid.uuid4().hex}.cdx.gz"
        entries: list[tuple] = []

        def chunks() -> Iterator[bytes]:
            at, waiting = 0, []

            def packed() -> bytes:
                nonlocal at, waiting
                data = gzip.compress("\n".join(json.dumps(x, ensure_ascii=False) for x in waiting).encode(), 6, mtime=0)
                entries.append((part, waiting[0][0], waiting[-1][0], name, at, len(data), len(waiting)))
                at, waiting = at + len(data), []
                return data

            for b in batches:
                for row in zip(*(b.column(c).to_pylist() for c in ("key", "archive", "offset", "length", "page_id")), strict=True):
                    waiting.append(row)
                    if len(waiting) == block:
                        yield packed()
            if waiting:
                yield packed()

        first = next(batches, None)
        if first is None:
            return
        batches = _chain(first, batches)
        _write(folder, name, chunks())
        _write(folder, name + DIRECTORY_END, iter([gzip.compress(json.dumps([e[1:3] + e[4:6] for e in entries], ensure_ascii=False).encode(), 6, mtime=0)]))
        kinds = [pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array([e[j] for e in entries], k) for j, k in enumerate(kinds)], [x.split()[0] for x in DIRECTORY.split(", ")])

    ordered = captures.repartitionByRange(partitions, "key", "archive", "offset").sortWithinPartitions("key", "archive", "offset")
    return keep(ordered.mapInArrow(run, DIRECTORY), "directory")


def _chain(first, rest: Iterator) -> Iterator:
    yield first
    yield from rest


def find(keys: DataFrame, directory: DataFrame, folder: str) -> DataFrame:
    """The captures (CAPTURES) of keys(key), distinct strings. Keys meet the index ranges that may hold them (a row for each range
    is broadcast: as many as the index has files); then each range's keys, in order, are searched for in that range's directory."""
    spark = keys.sparkSession
    ranges = directory.groupBy("part").agg(F.min("first").alias("low"), F.max("last").alias("high"), F.first("file").alias("file"))
    shared = spark.sparkContext.broadcast(sorted((r["low"].encode(), r["high"].encode(), r["file"]) for r in ranges.collect()))

    def deal(batches: Iterator) -> Iterator:
        import pyarrow as pa

        lows, highs = [r[0] for r in shared.value], [r[1] for r in shared.value]
        for b in batches:
            out = []
            for key in b.column("key").to_pylist():
                k = key.encode()
                out += [(key, shared.value[i][2]) for i in range(bisect_left(highs, k), bisect_right(lows, k))]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.string())], ["key", "file"])

    def search(batches: Iterator) -> Iterator:
        import pyarrow as pa

        system, base = _open(folder)
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]

        def read(name: str, offset: int, length: int | None) -> bytes:
            with system.open_input_file(f"{base}/{name}") as f:
                return gzip.decompress(f.read_at(f.size() if length is None else length, offset))

        def rows_of(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], k) for j, k in enumerate(kinds)], [x.split()[0] for x in CAPTURES.split(", ")])

        at: str | None = None
        blocks: list[tuple[bytes, bytes, int, int]] = []
        opened, names, lines = -1, [], []
        for b in batches:
            out = []
            for key, file in zip(b.column("key").to_pylist(), b.column("file").to_pylist(), strict=True):
                if file != at:
                    at, opened = file, -1
                    blocks = [(first.encode(), last.encode(), offset, length) for first, last, offset, length in json.loads(read(file + DIRECTORY_END, 0, None))]
                k = key.encode()
                i = bisect_left(blocks, k, key=lambda x: x[1])  # the first block whose last key isn't below
                while i < len(blocks) and blocks[i][0] <= k:
                    if i != opened:  # keys come in order, so a block is done when the next is opened
                        lines = [json.loads(x) for x in read(file, *blocks[i][2:]).decode().split("\n")]
                        opened, names = i, [r[0].encode() for r in lines]
                    out += [tuple(r) for r in lines[bisect_left(names, k) : bisect_right(names, k)]]
                    i += 1
                    if len(out) >= 10_000:  # a key may have any number of captures
                        yield rows_of(out)
                        out = []
            yield rows_of(out)

    dealt = keys.mapInArrow(deal, "key string, file string")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = dealt.repartition(partitions, "file", F.pmod(F.xxhash64("key"), F.lit(4))).sortWithinPartitions("file", "key")
    return asked.mapInArrow(search, CAPTURES)


READ = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string, payload binary"


def read_records(captures: DataFrame, folder: str) -> DataFrame:
    """Range-reads the captures' records: READ (payload is null for revisits). A response whose payload isn't that of its headers is an error."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        system, base = _open(folder)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        number = re.compile(r"<urn:page:(-?\d+|None)>")
        said = lambda x: None if (n := number.fullmatch(x)[1]) == "None" else int(n)
        for b in batches:
            rows = sorted(zip(*(b.column(c).to_pylist() for c in ("archive", "offset", "length")), strict=True))
            for archive, group in groupby(rows, key=lambda r: r[0]):
                with system.open_input_file(f"{base}/{archive}") as f:
                    out = []
                    for _, offset, length in group:
                        headers, body = parse(f.read_at(length, offset))
                        digest, size = headers["WARC-Payload-Digest"].removeprefix("sha1:"), int(headers["X-Payload-Length"])
                        kind = headers["WARC-Type"]
                        if kind == "response" and (base32_sha1(body) != digest or len(body) != size):
                            raise ValueError(f"{archive} at {offset}: the payload is damaged")
                        refers = said(headers["WARC-Refers-To"]) if kind == "revisit" else None
                        out.append((said(headers["WARC-Record-ID"]), size, digest, kind, refers, headers.get("WARC-Target-URI"), body if kind == "response" else None))
                        if len(out) == 500:
                            yield _rows(out, kinds)
                            out = []
                    yield _rows(out, kinds)

    def _rows(out: list[tuple], kinds: list):
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], k) for j, k in enumerate(kinds)], [x.split()[0] for x in READ.split(", ")])

    spread = captures.repartition(int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions")), "archive", F.expr("offset div 1000000"))
    return spread.sortWithinPartitions("archive", "offset").mapInArrow(run, READ)


def archived(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes pages, indexes the captures, looks every page's URL up in the index and reads its records: READ without payload, url."""
    folder = folder or new_path(pages.sparkSession, "warc")
    captures = write_archives(pages, f"{folder}/archives")
    directory = write_index(captures, f"{folder}/index")
    found = find(captures.select("key").distinct(), directory, f"{folder}/index")
    return read_records(found, f"{folder}/archives").drop("payload", "url")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
h AS (SELECT page_id, strlen(body) AS n, sha1(body) AS hex FROM p),
r AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS last FROM h)
SELECT page_id, n::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(8), lambda g: array_to_string(list_transform(range(4), lambda k:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, 5 * g::INT + 1, 5))::BIGINT >> (15 - 5 * k::INT)) & 31)::INT + 1, 1)), '')), '') AS payload_digest,
  CASE WHEN last <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN last <> page_id THEN last END AS refers_to
FROM r
"""
