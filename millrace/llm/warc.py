"""WARC archives: a writer in Spark's commit protocol, and a salvage reader.

A record is one gzip member, as archives have it. Members go through Spark's text writer,
so a lost executor or a repeated task leaves no half-written or doubled archive in
whatever store the folder is: a line of text is an archive, bounded in bytes, and its last
byte is given as the line separator. That byte is the top byte of the last member's length,
0 below 16 MB (a longer record is followed by an empty member, which ends in 0 too).
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import kind
from millrace.session import BATCH_BYTES, bound_batches, materialize, shared_dir

VERSION = b"WARC/1.1"
#: Payloads shorter than this are stored again instead of referred to.
LEAST_REVISIT = 1000
#: Bytes of an archive file, unless its one record is larger; the reader holds one file at a time.
FILE_BYTES = 32 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_START = re.compile(rb"\x1f\x8b\x08|WARC/\d\.\d\r\n")
_EMPTY = gzip.compress(b"", mtime=0)
_LENGTH = re.compile(r"[0-9]{1,18}")
#: Fields that a record has once.
_ONCE = frozenset(("warc-type", "warc-record-id", "content-length", "warc-payload-digest", "warc-payload-length"))
_DIGEST = re.compile(r"sha1:([A-Z2-7]{32})")


def record(sort: str, record_id: str, uri: str, payload: bytes, sha1: str, refers_to: str | None = None) -> bytes:
    """The bytes of one record: version line, header fields, blank line, block, two line ends."""
    digest = "sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode()
    block = payload if sort == "response" else b""
    fields = [
        ("WARC-Type", sort), ("WARC-Record-ID", f"<urn:page:{record_id}>"), ("WARC-Date", DATE), ("WARC-Target-URI", re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", uri)),
        ("WARC-Payload-Digest", digest), ("WARC-Payload-Length", str(len(payload))),
        *([("WARC-Refers-To", f"<urn:page:{_named(refers_to)}>"), ("WARC-Profile", PROFILE)] if sort == "revisit" else []),
        ("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(block))),
    ]
    head = b"".join(f"{k}: {v}\r\n".encode() for k, v in fields)
    return VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member that ends in a zero byte."""
    out = gzip.compress(data, 6, mtime=0)
    return out if out[-1] == 0 else out + _EMPTY


def parse(data: bytes) -> tuple[dict, int] | None:
    """The record at the start of ``data`` and where it ends; None if any check fails."""
    end = data.find(b"\r\n\r\n")
    if not data.startswith(b"WARC/") or end < 0:
        return None
    fields = {}
    for line in data[:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        field = name.strip().lower().decode("latin-1")
        if not colon or b"\r" in line or b"\n" in line or (field in fields and field in _ONCE):
            return None
        fields[field] = value.strip().decode("utf-8", "replace")
    size = fields.get("content-length", "")
    if not _LENGTH.fullmatch(size):
        return None
    start, stop = end + 4, end + 4 + int(size)
    if data[stop : stop + 4] != b"\r\n\r\n":
        return None
    block, revisit = data[start:stop], fields.get("warc-type") == "revisit"
    named, length = fields.get("warc-payload-digest", ""), fields.get("warc-payload-length")
    if named.startswith("sha1:"):
        digest = _DIGEST.fullmatch(named)
        if not digest or (not revisit and hashlib.sha1(block).digest() != base64.b32decode(digest[1])):
            return None
    if length is not None and (not _LENGTH.fullmatch(length) or (not revisit and int(length) != len(block))):
        return None
    return fields | {"block": block}, stop + 4


def _member_at(data: memoryview, at: int) -> tuple[bytes, int] | None:
    """The inflated member at ``at`` and its end; None if it is damaged."""
    z, parts = zlib.decompressobj(31), []
    while not z.eof and at < len(data):
        try:
            parts.append(z.decompress(data[at : at + 65536]))
        except zlib.error:
            return None
        at = min(at + 65536, len(data))
    return (b"".join(parts), at - len(z.unused_data)) if z.eof else None


def salvage(data: bytes) -> Iterator[tuple]:
    """Records and gaps of an archive: ``("record", start, end, fields)`` or ``("gap", start, end, None)``.

    Plain and gzip archives, also mixed. Where a record fails a check (broken member,
    checksum, header, length, or a payload's digest and length), the reader searches for the next member
    or version line at which a whole record is valid, goes on from there, and reports the
    bytes between as a gap. Nothing is both in a record and in a gap.
    """
    view, at, gap = memoryview(data), 0, None
    while at < len(data):
        found = None
        if data.startswith(b"\x1f\x8b\x08", at):
            inflated = _member_at(view, at)
            if inflated is not None:
                body, end = inflated
                records, inner = [], 0
                while inner < len(body):
                    parsed = parse(body[inner:] if inner else body)
                    if parsed is None:
                        break
                    records.append(parsed[0])
                    inner += parsed[1]
                if inner == len(body):
                    found = (records, end)
        elif data.startswith(b"WARC/", at):
            head = data.find(b"\r\n\r\n", at)
            length = re.search(rb"(?i)\r\ncontent-length:[ \t]*([0-9]{1,18})[ \t]*\r\n", data[at : head + 2]) if head >= 0 else None
            parsed = parse(data[at : head + 8 + int(length[1])]) if length else None
            if parsed is not None:
                found = ([parsed[0]], at + parsed[1])
        if found is not None:
            if gap is not None:
                yield "gap", gap, at, None
                gap = None
            for fields in found[0]:
                yield "record", at, found[1], fields
            at = found[1]
            continue
        gap = at if gap is None else gap
        later = _START.search(data, at + 1)
        at = later.start() if later else len(data)
    if gap is not None:
        yield "gap", gap, len(data), None


def plan(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id, url, payload, sha1, refers_to`` for every row.

    Of payloads that are equal and have ``LEAST_REVISIT`` bytes, the one of largest id is
    stored and the others refer to it. Ids may be of any type that has an order. Only
    digests are aggregated; groups of one don't come back. Rows that repeat an id with an
    equal payload are stored each; rows without an id refer to the group's largest, and
    are stored where no row of the group has one. Null urls and payloads are empty.
    """
    payload = F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).alias("page_id"), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload"))
    groups = materialize(rows.where(F.octet_length("payload") >= LEAST_REVISIT).groupBy("sha1", F.octet_length("payload").alias("size")).agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("sha1", "size", "first"), "groups")
    joined = rows.withColumn("size", F.octet_length("payload")).join(groups, ["sha1", "size"], "left")
    return joined.select("page_id", "url", "payload", "sha1", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")).alias("refers_to"))


def write(rows: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    """Archives of ``plan``'s rows under ``path``, each of ``file_bytes`` at most or of one record."""
    bound_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        out = lambda: pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], names=["members"])
        for batch in batches:
            for page_id, url, payload, sha1, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = member(record("response" if refers is None else "revisit", _named(page_id), url, payload, sha1, refers))
                if held and size + len(data) > file_bytes:
                    yield out()
                    held, size = [], 0
                held.append(data)
                size += len(data)
        if held:
            yield out()

    members = rows.select(F.col("page_id").cast("string").alias("page_id"), "url", "payload", "sha1", F.col("refers_to").cast("string").alias("refers_to")).mapInArrow(run, "members binary")
    members.select(F.col("members").cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def _named(page_id: str | None) -> str:
    """An id as a record's name has it: bytes that a name can't hold are escaped, null is no name."""
    return "null" if page_id is None else "id:" + quote(page_id, safe="")


def _number(name: str | None) -> str | None:
    found = re.fullmatch(r"<urn:page:id:(.*)>", name or "")
    return unquote(found[1]) if found else None


RECORDS = "archive string, start long, end long, kind string, page_id string, url string, payload_bytes long, payload_digest string, refers_to string, payload binary"


def fields_of(archive: str, start: int, end: int, f: dict, payloads: bool) -> tuple:
    """A record's row of ``RECORDS``."""
    block, sort = f["block"], f.get("warc-type")
    size, digest = len(block), None
    if sort == "revisit":
        length, named = f.get("warc-payload-length"), f.get("warc-payload-digest", "")
        size, digest = length and int(length), base64.b32decode(named[5:]).hex() if named.startswith("sha1:") else None
    else:
        digest = hashlib.sha1(block).hexdigest()
    return archive, start, end, sort, _number(f.get("warc-record-id")), f.get("warc-target-uri"), size, digest, _number(f.get("warc-refers-to")), block if payloads else None


def read(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """``RECORDS`` of the archives under ``path``: a row per record, and per gap (kind ``gap``).

    A response's size and digest are those of the block that was read; a revisit's are
    those its header names, null where it names none. Ids are text, as a header has them.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    names = [x.split()[0] for x in RECORDS.split(", ")]
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows, held = [], 0
                name = batch.column(0)[i].as_py()
                for what, start, end, fields in salvage(batch.column(1)[i].as_py()):
                    row = (name, start, end, "gap", *[None] * 6) if what == "gap" else fields_of(name, start, end, fields, payloads)
                    rows.append(row)
                    held += len(row[-1] or b"") + 200
                    if held > BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return files.mapInArrow(run, RECORDS)


def op4_warc(spark, sf_dir: str) -> DataFrame:
    """Writes all pages as archives in the shared folder and reads them back."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = f"{shared_dir(spark)}/millrace/{spark.sparkContext.applicationId}/warc-{uuid.uuid4().hex}"
    write(plan(pages), path)
    own = kind(pages, "page_id")
    found = read(spark, path).where("kind <> 'gap'")
    return found.select(F.col("page_id").cast(own).alias("page_id"), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), F.col("refers_to").cast(own).alias("refers_to"))


OP4_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), d AS (
  SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS payload_digest FROM p
), g AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first FROM d
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND first <> page_id THEN first END AS refers_to FROM g
"""
