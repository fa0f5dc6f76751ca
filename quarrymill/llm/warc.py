"""WARC archives written and read by Spark, with payloads held as a chunked record table.

Writing: one record a page. A payload longer than a segment is written as a first segment and `continuation` records
behind it, so no reader has to hold a whole record. Spark's text writer puts the records into gzip files in any
store that Spark can write; the line separator CRLF is the one that ends a WARC record.

Reading: Spark's text reader splits the same files at CRLF, each gzip file in one task and in order. A task walks
the lines by Content-Length, never by looking for a record's start, and gives rows (record_id, chunk_no, data,
running_sha256): the digest object is carried from chunk to chunk, so a payload is never put together.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fresh_path

SEGMENT_BYTES = 256 * 1024
CHUNK_BYTES = 64 * 1024
LEAST_REVISIT_BYTES = 100
WARC_DATE = "1970-01-01T00:00:00Z"
CHUNK_SCHEMA = (
    "record_id string, page_id long, target_uri string, record_type string, refers_to long, chunk_no long, data binary, chunk_bytes long, running_sha256 string, payload_bytes long, header_sha256 string, last boolean"
)
ARROW_CHUNKS = pa.schema([
    ("record_id", pa.string()), ("page_id", pa.int64()), ("target_uri", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("chunk_no", pa.int64()), ("data", pa.binary()),
    ("chunk_bytes", pa.int64()), ("running_sha256", pa.string()), ("payload_bytes", pa.int64()), ("header_sha256", pa.string()), ("last", pa.bool_()),
])


def plan_records(pages: DataFrame, least_bytes: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """page_id, url, html, sha256, record_type, refers_to for every row of pages.

    Among equal payloads of at least least_bytes the smallest page_id is the response; the others revisit it. A null
    html is an empty payload. Null page_ids revisit the smallest known one; in a group without any, and where the
    smallest id itself is repeated with the same payload, all such rows are responses.
    The digests alone are grouped (partial sums first); the join that brings a hot digest's pages together is left to
    adaptive skew splitting, as each side's row stands alone.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("sha256", F.sha2("html", 256))
    groups = rows.filter(F.octet_length("html") >= least_bytes).groupBy("sha256").agg(F.min("page_id").alias("original"), F.count("*").alias("n")).filter("n > 1 AND original IS NOT NULL").drop("n")
    groups = cut(groups)  # else the join keeps the aggregate's partitions, and a hot payload's pages could not be split
    revisit = F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    return rows.join(groups, "sha256", "left").select(
        "page_id", "url", "html", "sha256", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("original")).alias("refers_to")
    )


def _record_id(page_id: int | None, sha256: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page/{page_id}/{sha256}')}>"


def _record(fields: list[tuple[str, object]], *block: bytes) -> bytes:
    """A whole record but for the last CRLF, which the text writer adds."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", sum(map(len, block)))])
    return b"".join([b"WARC/1.1\r\n", head.encode(), b"\r\n", *block, b"\r\n"])


def _segments(page: dict, segment: int, date: str) -> Iterator[bytes]:
    html, pid, sha = page["html"].as_buffer(), page["page_id"], page["sha256"]
    rid = _record_id(pid, sha)
    size = html.size if html else 0
    uri = (page["url"] or f"urn:page:{pid}").replace("\r", "%0D").replace("\n", "%0A")
    known = [] if pid is None else [("X-Page-Id", pid)]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    fields = [("WARC-Type", page["record_type"]), ("WARC-Record-ID", rid), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha256:{sha}"), ("Content-Type", "application/http;msgtype=response"), *known]
    if page["record_type"] == "revisit":
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _record_id(page["refers_to"], sha)), ("X-Refers-To-Page-Id", page["refers_to"])]
        yield _record(fields, http)
        return
    data = memoryview(html) if html else b""
    cuts = [0]
    while size - cuts[-1] > segment:
        at = cuts[-1] + segment
        while data[at] & 0xC0 == 0x80:  # never inside a character: rows of the text writer are strings
            at -= 1
        cuts.append(at)
    cuts.append(size)
    yield _record(fields + [("WARC-Segment-Number", 1)] * (len(cuts) > 2), http, bytes(data[: cuts[1]]))
    for k, (a, b) in enumerate(zip(cuts[1:], cuts[2:], strict=False), 2):
        more = [("WARC-Segment-Total-Length", len(http) + size)] if b == size else []
        part = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{rid}/{k}')}>"
        yield _record([("WARC-Type", "continuation"), ("WARC-Record-ID", part), ("WARC-Date", date), ("WARC-Segment-Origin-ID", rid), ("WARC-Segment-Number", k), ("WARC-Target-URI", uri), *more], bytes(data[a:b]))


def write_warc(records: DataFrame, path: str, segment: int = SEGMENT_BYTES, date: str = WARC_DATE) -> None:
    """Write planned records (plan_records) as gzip WARC files under path, each with a warcinfo record first."""
    if segment < 8:
        raise ValueError("a segment must hold at least one character")

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")], 0
        started = False
        for batch in batches:
            started = True
            html = batch.column("html").cast(pa.binary())
            rest = batch.drop_columns(["html"]).to_pylist()
            for i, row in enumerate(rest):
                for one in _segments(row | {"html": html[i]}, segment, date):
                    out.append(one)
                    size += len(one)
                    if size >= 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()).cast(pa.string())], names=["value"])
                        out, size = [], 0
        if started and out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()).cast(pa.string())], names=["value"])

    records.select("page_id", "url", "html", "sha256", "record_type", "refers_to").mapInArrow(lines, "value string").write.option("lineSep", "\r\n").option("compression", "gzip").text(path)


class _Payload:
    """The payload of one record, fed piece by piece."""

    def __init__(self, fields: dict[bytes, bytes], chunk: int, with_data: bool) -> None:
        number = lambda key: int(fields[key]) if key in fields else None
        self.fixed = (fields[b"warc-record-id"].decode(), number(b"x-page-id"), fields.get(b"warc-target-uri", b"").decode())
        self.kind, self.refers_to = fields[b"warc-type"].decode(), number(b"x-refers-to-page-id")
        self.header = fields.get(b"warc-payload-digest", b"").decode().removeprefix("sha256:") or None
        self.digest, self.total, self.no, self.chunk, self.with_data, self.held, self.held_size = hashlib.sha256(), 0, 0, chunk, with_data, [], 0

    def row(self, last: bool) -> tuple:
        row = (*self.fixed, self.kind, self.refers_to, self.no, b"".join(self.held) if self.with_data else None, self.held_size, self.digest.hexdigest(), self.total, self.header, last)
        self.no, self.held, self.held_size = self.no + 1, [], 0
        return row

    def feed(self, piece: bytes) -> Iterator[tuple]:
        for at in range(0, len(piece), self.chunk):
            part = piece[at : at + self.chunk]
            if self.held_size + len(part) > self.chunk:
                yield self.row(False)
            self.digest.update(part)
            self.total += len(part)
            self.held_size += len(part)
            if self.with_data:
                self.held.append(part)


def _fields(lines: Iterator[bytes]) -> tuple[dict[bytes, bytes], int]:
    """The named fields up to the blank line, and how many bytes they and it take."""
    found, size = {}, 0
    for line in lines:
        size += len(line) + 2
        if not line:
            return found, size
        key, _, value = line.partition(b":")
        found[key.strip().lower()] = value.strip()
    raise ValueError("the archive ends inside a record's fields")


def parse_lines(lines: Iterator[bytes], chunk: int = CHUNK_BYTES, with_data: bool = True) -> Iterator[tuple]:
    """Rows of the chunk table from an archive's CRLF-separated lines, in order."""
    opened: dict[str, _Payload] = {}
    for line in lines:
        if not line:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not the start of a record: {line[:40]!r}")
        fields, _ = _fields(lines)
        left, kind = int(fields[b"content-length"]), fields[b"warc-type"]
        payload, more, declared = None, b"warc-segment-number" in fields, None
        if kind in (b"response", b"revisit"):
            payload = _Payload(fields, chunk, with_data)
            if fields.get(b"content-type", b"").startswith(b"application/http"):
                first = next(lines)
                http, size = _fields(lines)
                left -= len(first) + 2 + size
                declared = int(http.get(b"content-length", b"0"))
            if more:
                opened[payload.fixed[0]] = payload
        elif kind == b"continuation":
            payload = opened[fields[b"warc-segment-origin-id"].decode()]
            more = b"warc-segment-total-length" not in fields
        start = True
        while start or left > 0:
            piece = next(lines) if start else b"\r\n" + next(lines)
            start, left = False, left - len(piece)
            if payload and piece:
                yield from payload.feed(piece)
        if left:
            raise ValueError("a record is longer than its Content-Length")
        if payload and not more:
            opened.pop(payload.fixed[0], None)
            if payload.kind == "revisit" and declared is not None:
                payload.total = declared
            yield payload.row(True)
    if opened:
        raise ValueError("the archive ends before a segmented record does")


def read_warc(spark: SparkSession, path: str, chunk: int = CHUNK_BYTES, with_data: bool = True) -> DataFrame:
    """The chunk table of all archives under path: at least one row a record, the last one marked.

    payload_bytes and running_sha256 are of the payload up to and with the row's chunk. A revisit has one row without
    data; its payload_bytes is the length that its HTTP fields name. Records of other types are passed over.
    """

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = (x or b"" for batch in batches for x in batch.column(0).cast(pa.binary()).to_pylist())
        out, size = [], 0
        for row in parse_lines(lines, chunk, with_data):
            out.append(row)
            size += 200 + row[7] * with_data
            if size >= 1 << 22:
                yield pa.RecordBatch.from_pylist([dict(zip(ARROW_CHUNKS.names, x, strict=True)) for x in out], ARROW_CHUNKS)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(ARROW_CHUNKS.names, x, strict=True)) for x in out], ARROW_CHUNKS)

    return spark.read.option("lineSep", "\r\n").text(path).mapInArrow(chunks, CHUNK_SCHEMA)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write_warc(plan_records(spark.read.parquet(f"{sf_dir}/pages.parquet")), path)
    ends = read_warc(spark, path, with_data=False).filter("last")
    digest = F.when(F.col("record_type") == "revisit", F.col("header_sha256")).otherwise(F.col("running_sha256"))
    return ends.select("page_id", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to", (digest == F.col("header_sha256")).alias("digest_holds"))


ORACLE = """
SELECT p.page_id, CAST(octet_length(encode(p.h)) AS BIGINT) AS payload_bytes, p.d AS payload_digest,
       CASE WHEN g.o IS NOT NULL AND g.o <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN g.o <> p.page_id THEN g.o END AS refers_to, TRUE AS digest_holds
FROM (SELECT page_id, coalesce(html, '') AS h, sha256(coalesce(html, '')) AS d FROM pages) p
LEFT JOIN (SELECT sha256(html) AS d, min(page_id) AS o FROM pages WHERE octet_length(encode(html)) >= 100 GROUP BY 1 HAVING count(*) > 1) g ON g.d = p.d
"""
