"""WARC archives: a writer with one gzip member per record, and a sequential reader.

Archives are written by Spark's text writer, because it commits files safely and reaches every file
system Spark does: a value is a gzip member as raw bytes, and the line separator is a zero byte. Most
members end in a zero byte, which the separator supplies; others are followed by one zero byte of
padding, which gzip allows and the reader skips.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trajlake.llm.text import table, written
from trajlake.session import new_folder

#: Payloads of fewer bytes are never replaced by a revisit.
LEAST_BYTES = 0
#: An archive ends with the record that takes it beyond so many bytes, which bounds a reader's memory.
ARCHIVE_BYTES = 32 << 20
#: Bytes inflated at a time.
STEP = 1 << 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = "page_id long, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string, fault string"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _name(page: int | None) -> str:
    return f"<urn:page:{'' if page is None else page}>"


def _page(name: str | None) -> int | None:
    number = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def record(page: int | None, url: str | None, payload: bytes, revisit: bool, first: int | None, date: str) -> bytes:
    """One record: a response with its payload, or a revisit of an earlier response without it.

    ``date`` is the instant of capture, in UTC, as 2026-01-31T23:59:59Z.
    """
    kind = "revisit" if revisit else "response"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_name(page)}", f"WARC-Date: {date}"]
    # A URL cannot hold line breaks; percent signs keep the header one line whatever the table has.
    head.append("WARC-Target-URI: " + "".join(f"%{ord(c):02X}" if c in "\r\n" else c for c in url or ""))
    head.append("Content-Type: application/http; msgtype=response")
    head.append(f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}")
    head.append(f"WARC-Block-Digest: sha1:{base32_sha1(block)}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_name(first)}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """The gzip member, without its last byte if that is zero (the separator follows)."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = deflate.compress(data) + deflate.flush()
    return out[:-1] if out[-1] == 0 else out


def _members(date: str, size: int) -> callable:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, filled = 0, 0
        for batch in batches:
            values, archives = [], []
            for page, url, html, first, revisit in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                values.append(member(record(page, url, (html or "").encode(), revisit, first, date)))
                archives.append(archive)
                filled += len(values[-1]) + 1
                if filled > size:
                    archive, filled = archive + 1, 0
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.binary()), pa.array(archives, pa.int32())], ["value", "archive"])

    return each


def with_revisits(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """``pages`` (page_id, url, html) with ``first`` (the response's page) and ``revisit``.

    Payloads are equal if their SHA-256 is. The smallest number is found before rows move, and the
    join back to it is one Spark can split. All rows with the smallest number are responses.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    mark = F.when(F.length(payload) >= least_bytes, F.sha2(payload, 256))
    marked = pages.select("page_id", "url", "html", mark.alias("mark"))
    # As a table, so that the join deals out both sides and can split a payload that very many pages have.
    firsts = written(marked.where("mark is not null").groupBy("mark").agg(F.min("page_id").alias("first")), "firsts")
    out = marked.join(firsts, "mark", "left")
    revisit = F.coalesce(F.col("first") != F.coalesce(F.col("page_id"), F.col("first") + 1), F.lit(False))
    return out.select("page_id", "url", "html", "first", revisit.alias("revisit"))


def write_warc(pages: DataFrame, path: str, size: int = ARCHIVE_BYTES, date: str | None = None) -> None:
    """Write a record for each row of ``pages`` (page_id, url, html, first, revisit).

    A task's archives are numbered, one folder for each number, and each ends with the record that
    takes it beyond ``size`` bytes. All records bear ``date``, the driver's present by default: a task
    that runs again writes the same.
    """
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    value: Column = F.col("value").cast("string")
    rows = pages.select("page_id", "url", "html", "first", "revisit").mapInArrow(_members(date, size), "value binary, archive int")
    writer = rows.select(value, "archive").write.option("lineSep", "\0").option("encoding", "ISO-8859-1")
    writer.partitionBy("archive").text(path)


class Reader:
    """Reads records one after the other from an archive's bytes, inflating a step at a time."""

    def __init__(self, data: bytes):
        self.data, self.at = memoryview(data), 0
        self.inflate: zlib._Decompress | None = None
        self.ready = bytearray()

    def fill(self) -> bool:
        """Inflate the next step of the current member; False at its end."""
        if self.inflate is None or self.inflate.eof:
            return False
        left = self.inflate.unconsumed_tail
        if not left:
            left = self.data[self.at : self.at + STEP]
            self.at += len(left)
            if not left:
                raise ValueError("truncated member")
        self.ready += self.inflate.decompress(left, STEP)
        if self.inflate.eof:
            # What was handed in beyond the member's end belongs to the next one.
            self.at -= len(self.inflate.unused_data)
        return True

    def next_member(self) -> bool:
        while self.at < len(self.data) and self.data[self.at] == 0:
            self.at += 1
        if self.at >= len(self.data):
            return False
        self.inflate, self.ready = zlib.decompressobj(31), bytearray()
        return True

    def until(self, mark: bytes) -> bytes:
        start = 0
        while (place := self.ready.find(mark, start)) < 0:
            start = max(0, len(self.ready) - len(mark))
            if not self.fill():
                raise ValueError("no end of headers")
        out = bytes(self.ready[:place])
        del self.ready[: place + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.ready) < n:
            if not self.fill():
                raise ValueError("shorter than its Content-Length")
        out = bytes(self.ready[:n])
        del self.ready[:n]
        return out

    def rest(self) -> bytes:
        while self.fill():
            pass
        return bytes(self.ready)

    def records(self) -> Iterator[tuple[dict[str, str], bytes]]:
        """Headers (names in lower case) and block of each record. A broken member ends the archive."""
        while self.next_member():
            lines = self.until(b"\r\n\r\n").decode("utf-8", "replace").split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError("no WARC version line")
            head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            block = self.take(int(head["content-length"]))
            if self.rest() != b"\r\n\r\n":
                raise ValueError("a record does not end after its Content-Length")
            yield head, block


def _parsed(head: dict[str, str], block: bytes) -> tuple:
    """One output row; ``fault`` names the digest that does not hold."""
    kind, page = head.get("warc-type"), _page(head.get("warc-record-id"))
    digest = head.get("warc-payload-digest", "").removeprefix("sha1:")
    fault = None if base32_sha1(block) == head.get("warc-block-digest", "").removeprefix("sha1:") else "block digest"
    http, _, payload = block.partition(b"\r\n\r\n")
    if kind == "revisit":
        fields = (x.partition(":") for x in http.decode("utf-8", "replace").split("\r\n")[1:])
        size = int({k.strip().lower(): v for k, _, v in fields}.get("content-length", "0"))
        return page, kind, _page(head.get("warc-refers-to")), None, size, digest, fault
    if base32_sha1(payload) != digest:
        fault = fault or "payload digest"
    return page, kind, None, payload, len(payload), digest, fault


_FIELDS = pa.schema(
    [
        ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()),
        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("fault", pa.string()),
    ]
)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _FIELDS, strict=True)], schema=_FIELDS)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0):
            rows: list[tuple] = []
            held = 0
            try:
                for head, block in Reader(content.as_py()).records():
                    rows.append(_parsed(head, block))
                    held += len(block)
                    if held > STEP * 64:
                        yield _batch(rows)
                        rows, held = [], 0
            except (ValueError, KeyError, zlib.error) as e:
                rows.append((None, None, None, None, None, None, f"unreadable: {e}"))
            if rows:
                yield _batch(rows)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives in a folder.

    ``fault`` is null for sound records, names a digest that does not hold, or says why an archive
    could not be read on; the records before that are returned. An archive is one value, so those of
    other writers may have 2 GB at most (``ARCHIVE_BYTES`` here); their contents are inflated step by step.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    # Arrow batches are bounded in bytes, so a task holds few archives at a time.
    return files.mapInArrow(_read, RECORD)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write a WARC record per page, read the archives back, and describe each record.

    Returns page_id, payload_bytes, payload_digest, record_type, refers_to. A null html is an empty
    payload. Rows that share a payload's smallest page_id are all responses, and so are those of a
    payload that has only rows without page_id; other rows without page_id are revisits.
    """
    path = f"{new_folder(spark, 'warc')}/{uuid.uuid4().hex}"
    write_warc(with_revisits(table(spark, sf_dir, "pages", "page_id", "url", "html")), path)
    found = read_warc(spark, path)
    sound = F.when(F.col("fault").isNotNull(), F.raise_error(F.col("fault")).cast("string")).otherwise(F.col("payload_digest"))
    return found.select("page_id", "payload_bytes", sound.alias("payload_digest"), "record_type", "refers_to")


_DIGIT = "('0x' || substr(h, 10 * (i // 8) + 1, 10))::BIGINT >> (35 - 5 * (i % 8))::INT"
OP5_SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((({_DIGIT}) & 31) + 1)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN f USING (h)
"""
