"""WARC archives through a chunked record table.

Writing: a page becomes rows (record identifier, chunk number). Payloads are cut at CHUNK bytes, each chunk
carries the running SHA-1, and no task builds a whole record. Every row is one WARC 1.1 record: the first
`response`, the others `continuation` segments. Spark's text sink writes the rows as compressed archives.
Reading: Spark's text source splits archives at the version line; rows of a record stand together in one
file, so one streaming pass per task checks lengths and digests, again chunk by chunk.

A payload is also cut inside any version line that it contains, so that the line never occurs in a block:
the source then needs no length to find records. Archives whose blocks contain that line are refused by
the length check, never misread.

Of records with equal payloads of at least `least` bytes the smallest page_id is the response and the others
revisit it; found by a join with the written table of each digest's smallest page_id, in which Spark may split a
digest that has very many rows.

Defined cases: a null html is an empty payload; a null url writes no target; a null page_id is kept (it is a
response only if no other id has its payload); repeated rows with the smallest id are all responses; line
ends in a url are percent-encoded; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialize, shared_folder, utf8

CHUNK = 1 << 18
_VERSION = b"WARC/1.1\r\n"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_BATCH = 4 << 20


def chunk_ends(payload: memoryview | bytes, most: int = CHUNK) -> Iterator[int]:
    """Where chunks end: after `most` bytes at a character's start, or inside a version line; at least one."""
    at, n = 0, len(payload)
    while n - at > 0 or at == 0:
        end = min(at + most, n)
        while at + 1 < end < n and payload[end] & 0xC0 == 0x80:
            end -= 1
        hit = bytes(payload[at : min(end + len(_VERSION) - 1, n)]).find(_VERSION)
        if hit >= 0:
            end = min(end, at + hit + len(_VERSION) - 1)
        yield end
        at = end
        if at >= n:
            return


def _base32(sha: bytes) -> str:
    return base64.b32encode(sha).decode()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8(batch.column(2))
        view = memoryview(data)
        found = []
        for a, b in zip(offsets, offsets[1:], strict=False):
            sha = hashlib.sha1()
            for at in range(a, b, CHUNK):
                sha.update(view[at : min(at + CHUNK, b)])
            found.append(_base32(sha.digest()))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.diff(offsets)), pa.array(found, pa.string())], names=["page_id", "url", "html", "payload_bytes", "payload_digest"])


def tag(pages: DataFrame, least: int = 0) -> DataFrame:
    """pages(page_id, url, html) with payload_bytes, payload_digest, record_type and refers_to."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    pages = pages.mapInArrow(_digests, "page_id long, url string, html string, payload_bytes long, payload_digest string")
    first = pages.filter(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.min("page_id").alias("first_id"))
    first = materialize(first, "first")
    revisit = (F.col("payload_bytes") >= least) & F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    out = pages.join(first, "payload_digest", "left")
    return out.select(
        "page_id", "url", F.when(~revisit, F.col("html")).alias("html"), "payload_bytes", "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first_id")).alias("refers_to"),
    )


def _name(page: int | None) -> str:
    return f"<urn:page:{'null' if page is None else page}>"


def _segments(date: str):
    def lines(kind: str, record: str, more: list[str], head: bytes, chunk: bytes) -> bytes:
        fields = [f"WARC-Type: {kind}", f"WARC-Record-ID: {record}", f"WARC-Date: {date}", *more, f"Content-Length: {len(head) + len(chunk)}", "", ""]
        return b"".join((_VERSION, "\r\n".join(fields).encode(), head, chunk, b"\r\n"))

    def of_row(page, url, view, size, digest, kind, refers) -> Iterator[bytes]:
        record = _name(page)
        more = [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
        if url is not None:
            more.insert(0, "WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
        if kind == "revisit":
            profile = "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
            yield lines(kind, record, [*more, profile, f"WARC-Refers-To: {_name(refers)}"], _HTTP % size, b"")
            return
        sha, at = hashlib.sha1(), 0
        for number, end in enumerate(chunk_ends(view), 1):
            chunk = bytes(view[at:end])
            sha.update(chunk)
            last = end == len(view)
            running = [f"WARC-Segment-Number: {number}", f"WARC-X-Running-Digest: sha1:{_base32(sha.digest())}"] if number > 1 or not last else []
            if number > 1:
                running += [f"WARC-Segment-Origin-ID: {record}"] + [f"WARC-Segment-Total-Length: {size}"] * last
            yield lines("response" if number == 1 else "continuation", record if number == 1 else f"{record[:-1]}:{number}>", more + running, _HTTP % size if number == 1 else b"", chunk)
            at = end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            view, out, size = memoryview(data), [], 0
            rest = [batch.column(i).to_pylist() for i in (0, 1, 3, 4, 5, 6)]
            for i, (page, url, n, digest, kind, refers) in enumerate(zip(*rest, strict=True)):
                for row in of_row(page, url, view[offsets[i] : offsets[i + 1]], n, digest, kind, refers):
                    out.append(row)
                    size += len(row)
                    if size >= _BATCH:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()).cast(pa.string())], names=["value"])
                        out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()).cast(pa.string())], names=["value"])

    return run


def write_archives(pages: DataFrame, path: str, least: int = 0, date: str = "1970-01-01T00:00:00Z", compression: str = "gzip") -> None:
    """Writes a record per row of pages(page_id, url, html) below path, an archive file per task.

    Only compressions that Spark reads as one split: in a split file a record's segments could fall to several tasks.
    """
    if compression not in ("gzip", "deflate"):
        raise ValueError(f"archives can be compressed by gzip or deflate, not by {compression!r}: a reader would split such files inside records")
    rows = tag(pages, least).mapInArrow(_segments(date), "value string")
    rows.write.option("lineSep", "\r\n").option("compression", compression).text(path)


_ID = re.compile(rb"<urn:page:(null|-?\d+)(?::\d+)?>")


def _page(value: bytes) -> int | None:
    found = _ID.fullmatch(value)[1]
    return None if found == b"null" else int(found)


def _parse(piece: bytes) -> tuple[dict[bytes, bytes], bytes]:
    """Fields and block of one record, without the version line before it."""
    head, _, block = piece.partition(b"\r\n\r\n")
    fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n"))
    size = int(fields[b"Content-Length"])
    if len(block) != size + 4 or not block.endswith(b"\r\n\r\n"):
        raise ValueError(f"record {fields.get(b'WARC-Record-ID')!r}: its block does not have the length that it states")
    return fields, block[:size]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a record, from its chunks in order; only the running digest and the length are kept between chunks."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "n_chunks"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    now: dict = {}

    def close() -> list[tuple]:
        if not now:
            return []
        if now["kind"] == "response" and (_base32(now["sha"].digest()) != now["digest"] or now["got"] != now["size"]):
            raise ValueError(f"record of page {now['page']}: payload and digest differ")
        return [(now["page"], now["url"], now["size"], now["digest"], now["kind"], now["refers"], now["chunks"])]

    for batch in batches:
        out = []
        data, offsets = utf8(batch.column(0))
        raw = memoryview(data)
        for a, b in zip(offsets, offsets[1:], strict=False):
            if a == b:
                continue
            fields, block = _parse(bytes(raw[a:b]))
            kind = fields[b"WARC-Type"].decode()
            if kind == "continuation":
                if not now or _page(fields[b"WARC-Segment-Origin-ID"]) != now["page"] or int(fields[b"WARC-Segment-Number"]) != now["chunks"] + 1:
                    raise ValueError("a segment does not follow its record")
                chunk = block
            else:
                out += close()
                head, _, chunk = block.partition(b"\r\n\r\n")
                refers = fields.get(b"WARC-Refers-To")
                now = {
                    "page": _page(fields[b"WARC-Record-ID"]), "url": fields[b"WARC-Target-URI"].decode() if b"WARC-Target-URI" in fields else None, "size": int(head.rpartition(b": ")[2]),
                    "digest": fields[b"WARC-Payload-Digest"].decode().removeprefix("sha1:"), "kind": kind, "refers": refers and _page(refers), "sha": hashlib.sha1(), "got": 0, "chunks": 0,
                }
            now["sha"].update(chunk)
            now["got"] += len(chunk)
            now["chunks"] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), types, strict=True)] if out else [pa.array([], t) for t in types], names=names)
    last = close()
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in last], t) for i, t in enumerate(types)], names=names)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of archives that write_archives wrote: page_id, url, payload_bytes, payload_digest, record_type, refers_to, n_chunks; every payload is checked against its digest."""
    rows = spark.read.schema("value string").option("lineSep", _VERSION.decode()).text(path)
    return rows.mapInArrow(_read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, n_chunks long")


def _payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    page, number = None, 0
    for batch in batches:
        data, offsets = utf8(batch.column(0))
        raw, out = memoryview(data), []
        for a, b in zip(offsets, offsets[1:], strict=False):
            if a < b:
                fields, block = _parse(bytes(raw[a:b]))
                if fields[b"WARC-Type"] == b"continuation":
                    number += 1
                else:
                    page, number, block = _page(fields[b"WARC-Record-ID"]), 0, block.partition(b"\r\n\r\n")[2]
                out.append((page, number, block))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["page_id", "chunk_no", "chunk"])


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunked record table of archives: page_id, chunk_no (from 0), chunk (bytes of the payload)."""
    rows = spark.read.schema("value string").option("lineSep", _VERSION.decode()).text(path)
    return rows.mapInArrow(_payloads, "page_id long, chunk_no long, chunk binary")


def op10_warc(spark, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/sparkloom-warc-{uuid.uuid4().hex}"
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
