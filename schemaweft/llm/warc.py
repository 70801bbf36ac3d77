"""WARC archives with a two-level capture index.

Pages are written as WARC records by Spark's text writer, whose record separator is the
format's own; equal payloads are stored once and revisited. The index has a line per capture,
sorted by reversed-host URL key, in compressed blocks; a sparse directory has the first and last
key of each block. A lookup finds its blocks in the directory, searches them by bisection and
reads the record by its range of bytes.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaweft.llm.common import join_small, settle

END = "\r\n\r\n"
#: Payloads of fewer bytes are never revisits; records of a file and lines of a block at most.
REVISIT_BYTES, RECORDS_PER_FILE, LINES_PER_BLOCK, BLOCKS_PER_RANGE = 1000, 4_000, 3_000, 8
DATE = "1970-01-01T00:00:00Z"
#: What would break a header, a line break or blank in a URL, and what stands for it.
UNSAFE, SAFE = r"[\x00-\x20]", "%20"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def surt(url: str) -> str:
    """Sort key of a URL: host labels from the right, then path and query, lower-cased.

    What can't be split as a URL is its own key.
    """
    try:
        parts = urlsplit(url.strip())
        host = (parts.hostname or "").removeprefix("www.")
        port = f":{parts.port}" if parts.port and parts.port not in (80, 443) else ""
    except ValueError:
        return url.lower()
    if not host:
        return url.lower()
    query = f"?{parts.query}" if parts.query else ""
    return f"{','.join(reversed(host.split('.')))}{port}){parts.path or '/'}{query}".lower()


def _headers(*fields: tuple[str, Column]) -> Column:
    """Header lines; a NULL value leaves its line out."""
    return F.concat(*[F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit("")) for name, value in fields])


def with_revisits(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload, n, digest, refers_to: who revisits whom.

    Of equal payloads of at least ``least`` bytes the one with the largest page_id is the
    response. A NULL html is an empty payload. Rows that share that page_id are all
    responses, and so are payloads of pages without any id. Pages are shuffled only if groups of
    equal payloads are many.
    """
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select(
        "page_id",
        "url",
        payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("n"),
        F.sha1(payload).alias("digest"),
        F.sha2(payload, 256).alias("same"),
    )
    groups = rows.filter(F.col("n") >= least).groupBy("same").agg(F.count("*").alias("k"), F.max("page_id").alias("response"))
    groups = settle(groups.filter("k > 1 and response is not null").select(F.col("same").alias("g"), "response"))
    met = join_small(rows, groups, (F.col("same") == F.col("g")) & (F.col("n") >= least))
    first = F.col("page_id").eqNullSafe(F.col("response"))
    return met.withColumn("refers_to", F.when(~first, F.col("response"))).drop("same", "g", "response")


def write_archives(pages: DataFrame, root: str, least: int = REVISIT_BYTES) -> None:
    """One record per row of ``pages`` (page_id, url, html) under ``root``/archives."""
    rows = with_revisits(pages, least)
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\n"), _headers(("Content-Type", F.lit("text/html; charset=utf-8")), ("Content-Length", F.col("n").cast("string"))), F.lit("\r\n"))
    block = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("n"))
    name = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    url = F.regexp_replace(F.coalesce("url", F.lit("")), UNSAFE, SAFE)
    head = _headers(
        ("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        ("WARC-Record-ID", F.coalesce(name(F.col("page_id")), F.lit("<urn:page:>"))),
        ("WARC-Date", F.lit(DATE)),
        ("WARC-Target-URI", url),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        ("WARC-Refers-To", name(F.col("refers_to"))),
        ("WARC-Profile", F.when(revisit, PROFILE)),
        ("Content-Type", F.lit("application/http;msgtype=response")),
        ("Content-Length", block.cast("string")),
    )
    record = F.concat(F.lit("WARC/1.1\r\n"), head, F.lit("\r\n"), http, F.when(revisit, "").otherwise(F.col("payload")))
    writer = rows.select(record.alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", RECORDS_PER_FILE)
    writer.text(f"{root}/archives")


def _fields(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if x)}


def scan(content: bytes) -> Iterator[tuple[int, int, dict[str, str]]]:
    """(offset, length without the end mark, headers) of the records of a file."""
    at = 0
    while at < len(content):
        body = content.index(END.encode(), at) + len(END)
        fields = _fields(content[at : body - len(END)])
        end = body + int(fields["content-length"])
        if content[end : end + len(END)] != END.encode():
            raise ValueError(f"no end of record at byte {end}")
        yield at, end - at, fields
        at = end + len(END)


def parse(record: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of a record."""
    head, _, block = record.partition(END.encode())
    http, _, payload = block.partition(END.encode())
    return _fields(head), _fields(http), payload


def _page(name: str | None) -> int | None:
    digits = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            raw = content.as_buffer().to_pybytes()
            rows = [(surt(f.get("warc-target-uri", "")), _page(f["warc-record-id"]), path, at, n) for at, n, f in scan(raw)]
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "page_id", "path", "at", "n"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compressed blocks of the lines of a range, which come sorted."""
    held: list[tuple] = []

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        text = "\n".join("\t".join("" if v is None else str(v) for v in row[1:]) for row in rows)
        data = zstandard.ZstdCompressor().compress(text.encode())
        values = (rows[0][0], rows[0][1], rows[-1][1], len(rows), data)
        kinds = (pa.int32(), pa.string(), pa.string(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=["part", "first_key", "last_key", "lines", "data"])

    for batch in batches:
        held += zip(*(c.to_pylist() for c in batch.columns))
        while len(held) >= LINES_PER_BLOCK:
            yield packed(held[:LINES_PER_BLOCK])
            held = held[LINES_PER_BLOCK:]
    if held:
        yield packed(held)


def write_index(spark: SparkSession, root: str) -> None:
    """Blocks under ``root``/blocks and their directory under ``root``/directory."""
    files = spark.read.format("binaryFile").load(f"{root}/archives").select("path", "content")
    lines = settle(files.mapInArrow(_lines, "key string, page_id bigint, path string, at bigint, n bigint"))
    ranges = max(1, math.ceil(lines.count() / (LINES_PER_BLOCK * BLOCKS_PER_RANGE)))
    # Captures of one key are told apart by where they are, so that no key is one range.
    dealt = lines.repartitionByRange(ranges, "key", "path", "at").withColumn("part", F.spark_partition_id())
    dealt = dealt.sortWithinPartitions("key", "path", "at").select("part", "key", "page_id", "path", "at", "n")
    dealt.mapInArrow(_blocks, "part int, first_key string, last_key string, lines int, data binary").write.parquet(f"{root}/blocks")
    spark.read.parquet(f"{root}/blocks").drop("data").write.parquet(f"{root}/directory")


def _entries(data: bytes) -> list[list[str]]:
    return [line.split("\t") for line in zstandard.ZstdDecompressor().decompress(data).decode().split("\n")]


class Ranges:
    """Reads ranges of bytes of files; a few stay open."""

    def __init__(self):
        self.open: dict[str, pa.NativeFile] = {}

    def read(self, path: str, at: int, n: int) -> bytes:
        if path not in self.open:
            if len(self.open) > 64:
                self.close()
            uri = path if "://" in path else path.replace(":/", ":///", 1)
            system, name = pyarrow.fs.FileSystem.from_uri(uri)
            self.open[path] = system.open_input_file(name)
        return self.open[path].read_at(n, at)

    def close(self) -> None:
        for f in self.open.values():
            f.close()
        self.open = {}


CAPTURES = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string"


def _captured(entries: list[list[str]], with_payload: bool) -> pa.RecordBatch:
    rows, source = [], Ranges()
    for _, page_id, path, at, n in sorted(entries, key=lambda e: (e[2], int(e[3]))):
        fields, http, payload = parse(source.read(path, int(at), int(n)))
        kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
        if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"payload of page {page_id} is not what was written")
        row = (_page(fields["warc-record-id"]), fields["warc-target-uri"], kind, _page(fields.get("warc-refers-to")), int(http["content-length"]), digest)
        rows.append((*row, payload) if with_payload else row)
    source.close()
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()][: 7 if with_payload else 6]
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"][: len(kinds)]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def captures(spark: SparkSession, root: str, with_payload: bool = False) -> DataFrame:
    """All captures: every line of the index, and what its range of the archive holds."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                yield _captured(_entries(data), with_payload)

    blocks = spark.read.parquet(f"{root}/blocks").select("data")
    return blocks.mapInArrow(read, CAPTURES + (", payload binary" if with_payload else ""))


def lookup(spark: SparkSession, root: str, url: str) -> DataFrame:
    """The captures of a URL with their payloads: directory, block, bisection, range read."""
    key = surt(re.sub(UNSAFE, SAFE, url))
    directory = spark.read.parquet(f"{root}/directory")
    inside = (F.col("first_key") <= key) & (F.col("last_key") >= key)
    blocks = spark.read.parquet(f"{root}/blocks").join(directory.filter(inside).select("part", "first_key").distinct(), ["part", "first_key"], "left_semi")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                entries = _entries(data)
                a = bisect.bisect_left(entries, key, key=lambda e: e[0])
                b = bisect.bisect_right(entries, key, key=lambda e: e[0])
                yield _captured(entries[a:b], True)

    return blocks.filter(inside).select("data").mapInArrow(read, CAPTURES + ", payload binary")
