"""WARC archives of web pages, in which records of one payload are resolved to one response and revisits of it.

Three steps, each of which leaves archives or a table in the shared folder: every page becomes a response record
(``write_pages``); the headers are read back and shuffled by payload digest, and every record that repeats a payload
is joined to the original response of it (``resolve``); the records are read again, meet their decision by record id
and are written to new archives with fresh headers (``deduplicate``).  ``read_archive`` reads either kind, or any
other WARC file, plain or compressed as a whole or by record.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revcast.llm.common import stored
from revcast.session import checkpoint_dir

RECORDS_PER_FILE = 8_000
BATCH_BYTES = 4_000_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEX_OF_32, BASE_32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
RECORD = (
    "record_id string, record_type string, uri string, date string, page_id long, payload_bytes long, payload_digest string, "
    "refers_to_id string, refers_to long, intact boolean, payload binary"
)


def payload_digest(payload: Column) -> Column:
    """SHA-1 in upper-case base32: each five bytes are eight digits of base 32."""
    digest = F.sha1(payload)
    part = [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*part), HEX_OF_32, BASE_32)


def _one_line(value: Column) -> Column:
    """A header value: control characters are percent-encoded, so no value can end its line."""
    plain = F.coalesce(value, F.lit(""))
    for code in (9, 10, 13):
        plain = F.replace(plain, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return F.regexp_replace(plain, r"[\x00-\x1F\x7F]", "%00")


def _line(name: str, value: Column) -> Column:
    """One header line, left out where the value is null."""
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def rendered(revisit: Column) -> Column:
    """The bytes of a record as text, but for the two line ends after it, which the sink writes.

    Reads the columns of ``RECORD`` and, of a revisit, ``to_uri`` and ``to_date``.  The block is the HTTP header and, of a
    response, the payload; the HTTP header's length is that of the full payload in both.
    """
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload").cast("string")))
    lines = [
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _line("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), F.col("record_id"), F.lit(">"))),
        _line("WARC-Date", F.col("date")),
        _line("WARC-Target-URI", _one_line(F.col("uri"))),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        _line("WARC-Block-Digest", F.concat(F.lit("sha1:"), payload_digest(block))),
        _line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        _line("WARC-Refers-To", F.when(revisit, F.concat(F.lit("<urn:uuid:"), F.col("refers_to_id"), F.lit(">")))),
        _line("WARC-Refers-To-Target-URI", F.when(revisit, _one_line(F.col("to_uri")))),
        _line("WARC-Refers-To-Date", F.when(revisit, F.col("to_date"))),
        _line("Refers-To-Page-ID", F.when(revisit, F.col("refers_to").cast("string"))),
        _line("Page-ID", F.col("page_id").cast("string")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        _line("Content-Length", F.octet_length(block).cast("string")),
    ]
    return F.concat(*[F.coalesce(x, F.lit("")) for x in lines], F.lit("\r\n"), block)


def write_archive(records: DataFrame, revisit: Column, path: str) -> None:
    """Records to compressed archives of at most ``RECORDS_PER_FILE``; Spark's writer commits each task's files once."""
    text = records.select(rendered(revisit).alias("value"))
    text.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def write_pages(pages: DataFrame, path: str) -> None:
    """Every page as a response record with an id of its own."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("uri"), payload.alias("payload"))
    records = rows.select(
        "*",
        F.expr("uuid()").alias("record_id"),
        F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        payload_digest(F.col("payload")).alias("payload_digest"),
        *[F.lit(None).cast(t).alias(c) for c, t in (("refers_to_id", "string"), ("refers_to", "long"), ("to_uri", "string"), ("to_date", "string"))],
    )
    write_archive(records, F.lit(False), path)


class _Stream:
    """Reads a WARC file piece by piece, through any number of compressed members."""

    def __init__(self, content: bytes):
        self.rest, self.at, self.raw = b"", 0, memoryview(content)
        self.packed = content[:2] == b"\x1f\x8b"
        self.inflate = zlib.decompressobj(31) if self.packed else None

    def _more(self) -> bool:
        if not len(self.raw):
            return False
        if self.inflate is None:
            new, self.raw = bytes(self.raw), self.raw[:0]
        else:
            piece, self.raw = self.raw[:1_000_000], self.raw[1_000_000:]
            new = self.inflate.decompress(piece)
            while self.inflate.eof:
                left = self.inflate.unused_data
                if not left and not len(self.raw):
                    break
                self.inflate = zlib.decompressobj(31)
                if not left:
                    break
                new += self.inflate.decompress(left)
        self.rest, self.at = self.rest[self.at :] + new, 0
        return True

    def upto(self, mark: bytes) -> bytes | None:
        seen = self.at
        while (end := self.rest.find(mark, seen)) < 0:
            held = max(0, len(self.rest) - self.at - len(mark) + 1)
            if not self._more():
                return None
            seen = held
        out, self.at = self.rest[self.at : end], end + len(mark)
        return out

    def exactly(self, n: int) -> bytes:
        while len(self.rest) - self.at < n and self._more():
            pass
        out, self.at = self.rest[self.at : self.at + n], self.at + n
        return out


def _digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def parsed(content: bytes) -> Iterator[dict]:
    """The response and revisit records of one file; other types (as ``warcinfo``) are passed over.

    A record ends where its Content-Length says, whatever its payload looks like.  ``intact`` tells whether the block is
    complete and has its own digest; size and digest of a response are worked out from the payload read, those of a
    revisit, which has none, are what its headers keep of the full payload.
    """
    stream = _Stream(content)
    while (head := stream.upto(b"\r\n\r\n")) is not None:
        lines = head.lstrip(b"\r\n").decode("utf-8", "surrogateescape").split("\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(fields.get("content-length", 0))
        block = stream.exactly(size)
        stream.exactly(4)
        kind = fields.get("warc-type")
        if kind not in ("response", "revisit"):
            continue
        http, _, payload = block.partition(b"\r\n\r\n")
        known = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")[1:])}
        digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
        intact = len(block) == size and fields.get("warc-block-digest", "").removeprefix("sha1:") in ("", _digest(block))
        if kind == "response":
            intact &= digest in ("", own := _digest(payload))
            digest = own
        yield {
            "record_id": fields.get("warc-record-id", "").removeprefix("<urn:uuid:").removesuffix(">"),
            "record_type": kind,
            "uri": fields.get("warc-target-uri", "").encode("utf-8", "replace").decode(),
            "date": fields.get("warc-date"),
            "page_id": int(fields["page-id"]) if "page-id" in fields else None,
            "payload_bytes": len(payload) if kind == "response" else int(known.get(b"content-length", b"0")),
            "payload_digest": digest,
            "refers_to_id": fields["warc-refers-to"].removeprefix("<urn:uuid:").removesuffix(">") if "warc-refers-to" in fields else None,
            "refers_to": int(fields["refers-to-page-id"]) if "refers-to-page-id" in fields else None,
            "intact": intact,
            "payload": payload if kind == "response" else None,
        }


def _read(batches: Iterator[pa.RecordBatch], with_payload: bool) -> Iterator[pa.RecordBatch]:
    kinds = {"payload_bytes": pa.int64(), "page_id": pa.int64(), "refers_to": pa.int64(), "intact": pa.bool_(), "payload": pa.binary()}
    names = [x.split()[0] for x in RECORD.split(", ")]
    schema = pa.schema([(n, kinds.get(n, pa.string())) for n in names if with_payload or n != "payload"])
    for batch in batches:
        for content in batch.column("content"):
            rows, held = [], 0
            for row in parsed(content.as_py()):
                held += 500 + (len(row["payload"] or b"") if with_payload else 0)
                rows.append(row if with_payload else {k: v for k, v in row.items() if k != "payload"})
                if held > BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, held = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


def read_archive(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records of all archives in a folder; a file is read by one task, piece by piece."""
    files = spark.read.format("binaryFile").load(path).select("content")
    schema = RECORD if with_payload else RECORD.removesuffix(", payload binary")
    return files.mapInArrow(lambda batches: _read(batches, with_payload), schema)


def resolve(headers: DataFrame, least_bytes: int = 0) -> DataFrame:
    """What each record becomes: record_id, revisit, and of the original response its id, page, address and date.

    Of the records of one payload the one with the largest page_id is the response (null pages last; between rows of one
    page the larger record id decides); payloads below ``least_bytes`` are never revisits.  Payloads are equal if SHA-1,
    SHA-256 and length are, so a forged SHA-1 twin stays a response.  Only headers are shuffled; originals are combined
    before the shuffle, and the rows of a very common payload meet one original in a join that Spark can split.
    """
    same = ["payload_digest", "guard", "payload_bytes"]
    originals = headers.groupBy(*same).agg(F.max(F.struct("page_id", "record_id", "uri", "date")).alias("original"))
    met = headers.join(originals, same)
    own = (F.col("original.record_id") == F.col("record_id")) | (F.col("payload_bytes") < least_bytes)
    return met.select(
        F.col("record_id").alias("of"),
        (~own).alias("revisit"),
        F.col("original.record_id").alias("to_id"),
        F.col("original.page_id").alias("to_page"),
        F.col("original.uri").alias("to_uri"),
        F.col("original.date").alias("to_date"),
    )


def deduplicate(spark: SparkSession, source: str, target: str, least_bytes: int = 0) -> None:
    """Read the response records of ``source`` and write them to ``target``, revisits without their payload.

    Record ids are unique, so the join that brings a payload to its decision has no hot key.
    """
    records = read_archive(spark, source).where("record_type = 'response'")
    headers = stored(records.select("record_id", "page_id", "uri", "date", "payload_bytes", "payload_digest", F.sha2("payload", 256).alias("guard")), "warc-headers")
    decided = records.drop("refers_to_id", "refers_to").join(resolve(headers, least_bytes), F.col("record_id") == F.col("of"))
    fresh = decided.withColumns({"refers_to_id": F.col("to_id"), "refers_to": F.col("to_page")})
    write_archive(fresh, F.col("revisit"), target)


def archived(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Archive ``pages`` (page_id, url, html) without repeated payloads and read the archives back, without payloads.

    One row per row of ``pages``, with the columns of ``RECORD``.  Null html is an empty payload, a real one that others
    revisit; a null url is an empty address; a null page_id is no header line and comes back as null.  Rows that repeat a
    page_id, or repeat wholly, are records of their own, one of which is the response.  Payloads may hold anything,
    WARC records included.  A single record passes through memory at once, a text of any length too.  An empty table
    gives an empty result; other columns are not read.
    """
    spark = pages.sparkSession
    folder = f"{checkpoint_dir(spark).rstrip('/')}/llm-warc-{uuid.uuid4().hex}"
    write_pages(pages, f"{folder}/captured")
    deduplicate(spark, f"{folder}/captured", f"{folder}/archive", least_bytes)
    return read_archive(spark, f"{folder}/archive", with_payload=False)
