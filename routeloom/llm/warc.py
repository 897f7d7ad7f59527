"""Operator 3: WARC derivatives: linked metadata and plain-text conversion records from responses.

Every response gives two records.  Both name the response by WARC-Refers-To, repeat its target URI and date, and carry
digests of their own block; the metadata record also keeps the source's headers as `application/warc-fields` - the
record's own (source-warc-...), the status line and every header of the message in order, repeated ones too
(source-http-...), length, block and payload digests -, and the conversion record names the metadata record by
WARC-Concurrent-To and holds the visible text of the payload: scripts, styles and comments go, block tags break lines,
other tags go, character references are decoded, white space within a line becomes one space, empty lines go.

from_records() reads serialised response records, with their ids, dates and headers; derive() takes tables.  Where a table
has no ids or dates, a response is named by its key, URI and digest, and `date` stands for its date.  Record ids are
name-based (the SHA-1 of type, source id, URI and source digest), so that a task run again gives the same records; equal
responses are numbered, so that no two records share an id.  In written headers control characters, line ends among them,
are percent-encoded.  Null payloads are empty and give an empty conversion; null URIs are written as empty; a null key
stays null; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .markup import Hidden, tokens

DATE = "2024-01-01T00:00:00Z"
SCHEMA = (
    "key long, target_uri string, warc_type string, record_id string, refers_to string, concurrent_to string, warc_date string, content_type string, content_length long, "
    "block_digest string, source_block_digest string, source_payload_digest string, block binary"
)

_UNREAD = frozenset(("script", "style"))
_HIDDEN = frozenset("noscript template".split())
_BREAK = frozenset("p div br li ul ol h1 h2 h3 h4 h5 h6 tr table section article header footer nav aside main title body html head blockquote pre form dl dt dd td th hr figure figcaption".split())
_LINE = re.compile(r"[ \t\r\f\v\xa0]+")
_CONTROL = re.compile(r"[\x00-\x1f\x7f]")


def visible_text(page: str) -> str:
    """The text a reader would see, one line a block."""
    parts: list[str] = []
    hidden, around = Hidden(_HIDDEN), []
    for text, name, closing, attrs in tokens(page, _UNREAD):
        if not hidden.open:
            parts.append(text.replace("\n", " "))
        if name is None:
            continue
        if name in _UNREAD or hidden.passed(name, closing, attrs, around):
            parts.append(" ")
        else:
            if name in _BREAK:
                parts.append("\n")
            if not closing:
                around.append(name)
            elif name in around:
                del around[len(around) - 1 - around[::-1].index(name) :]
    lines = [_LINE.sub(" ", x).strip() for x in html.unescape("".join(parts).replace("&#10;", " ")).split("\n")]
    return "\n".join([x for x in lines if x])


def safe(value: str | None) -> str:
    """A header's value on one line."""
    return _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", value or "")


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(*name: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(chr(0).join(name).encode()).digest()[:16], version=5)}>"


def response_block(payload: bytes) -> bytes:
    """The HTTP message of a page that was stored without its headers."""
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload


def message_of(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers in order and body of an HTTP message; a folded line belongs to the header before it."""
    head, _, body = block.partition(b"\r\n\r\n")
    status, *lines = head.decode("latin-1").split("\r\n")
    headers: list[tuple[str, str]] = []
    for x in lines:
        if x[:1] in (" ", "\t") and headers:
            headers[-1] = (headers[-1][0], f"{headers[-1][1]} {x.strip()}")
        elif x:
            k, _, v = x.partition(":")
            headers.append((k.strip(), v.strip()))
    return status, headers, body


def split_message(block: bytes) -> tuple[str, dict[str, str], bytes]:
    """Status line, headers by lower-case name (the last of repeated ones) and body of an HTTP message."""
    status, headers, body = message_of(block)
    return status, {k.lower(): v for k, v in headers}, body


def derive_one(key, uri: str | None, block: bytes, source_id: str | None = None, date: str | None = None, copy: int = 1, source: list[tuple[str, str]] = ()) -> list[dict]:
    """The metadata and the conversion record of one response; `copy` numbers equal ones, `source` are its record's headers."""
    uri, date = uri or "", date or DATE
    status, headers, body = message_of(block)
    whole, payload = digest(block), digest(body)
    number = (str(copy),) * (copy > 1)
    source_id = source_id or record_id("response", str(key), uri, whole, *number)
    meta_id, text_id = (record_id(kind, source_id, uri, whole, *number) for kind in ("metadata", "conversion"))
    kind = next((v for k, v in headers if k.lower() == "content-type"), "")
    charset = (re.search(r"charset=[\"']?([\w-]+)", kind, re.I) or [None, "utf-8"])[1]
    try:
        page = body.decode(charset, "replace")
    except LookupError:
        page = body.decode("utf-8", "replace")
    text = visible_text(page).encode()
    fields = [("source-status", status), *((f"source-http-{k.lower()}", v) for k, v in headers), *((f"source-warc-{k.lower()}", v) for k, v in source), ("source-payload-length", str(len(body))), ("source-block-digest", whole), ("source-payload-digest", payload), ("conversion-record", text_id)]
    meta = "".join(f"{safe(k)}: {safe(v)}\r\n" for k, v in fields).encode()
    common = {"key": key, "target_uri": uri, "refers_to": source_id, "warc_date": date, "source_block_digest": whole, "source_payload_digest": payload}
    return [
        common | {"warc_type": "metadata", "record_id": meta_id, "concurrent_to": text_id, "content_type": "application/warc-fields", "content_length": len(meta), "block_digest": digest(meta), "block": meta},
        common | {"warc_type": "conversion", "record_id": text_id, "concurrent_to": meta_id, "content_type": "text/plain; charset=utf-8", "content_length": len(text), "block_digest": digest(text), "block": text},
    ]


def _numbered(d: DataFrame) -> DataFrame:
    """Rows with `copy`: 1, and 2, 3 ... for further equal ones.  Only where there are such rows are any moved."""
    same = ["key", "uri", "id", "date"]
    d = d.withColumn("sum", F.md5(F.coalesce("block", F.lit(b""))))
    twice = d.groupBy(*same, "sum").agg(F.count("*").alias("c")).where("c > 1").drop("c")
    if twice.isEmpty():
        return d.withColumn("copy", F.lit(1)).drop("sum")
    on = [*same, "sum"]
    t = twice.toDF(*[f"t_{c}" for c in on])
    match = None
    for c in on:
        e = F.col(c).eqNullSafe(F.col(f"t_{c}"))
        match = e if match is None else match & e
    again = d.join(t, match, "left_semi").withColumn("copy", F.row_number().over(Window.partitionBy(*on).orderBy("sum")).cast("int"))
    return d.join(t, match, "left_anti").withColumn("copy", F.lit(1)).unionByName(again).drop("sum")


def derive(responses: DataFrame, key: str, uri: str, block: str, date: str = DATE, bare: bool = False, id_col: str | None = None, date_col: str | None = None) -> DataFrame:
    """The records of SCHEMA for every response; `block` holds its HTTP message, or with `bare` its payload alone.

    id_col and date_col hold the WARC-Record-ID and WARC-Date of the responses, where the table has them.
    """
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, len(b), 256):
                rows = []
                for k, u, x, r, t, n in zip(*(c.to_pylist() for c in b.slice(i, 256).columns), strict=True):
                    rows += derive_one(k, u, response_block(x or b"") if bare else x or b"", r, t or date, n)
                yield _batch(rows, names)

    given = lambda c: F.col(c).cast("string") if c else F.lit(None).cast("string")
    d = responses.select(F.col(key).cast("long").alias("key"), F.col(uri).cast("string").alias("uri"), F.col(block).cast("binary").alias("block"), given(id_col).alias("id"), given(date_col).alias("date"))
    return _numbered(d).select("key", "uri", "block", "id", "date", "copy").mapInArrow(run, SCHEMA)


def from_records(files: DataFrame, key: str, data: str) -> DataFrame:
    """The records of SCHEMA for every response record in serialised WARC data (one or more records a row; others pass by)."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = []
                for headers, block in parse(raw or b""):
                    if headers.get("WARC-Type") == "response":
                        rows += derive_one(k, headers.get("WARC-Target-URI"), block, headers.get("WARC-Record-ID"), headers.get("WARC-Date"), source=list(headers.items()))
                yield _batch(rows, names)

    return files.select(F.col(key).cast("long"), F.col(data).cast("binary")).mapInArrow(run, SCHEMA)


def _batch(rows: list[dict], names: list[str]) -> pa.RecordBatch:
    kinds = {"key": pa.int64(), "content_length": pa.int64(), "block": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds.get(n, pa.string())) for n in names], names)


def serialise(r: dict) -> bytes:
    """A record in WARC 1.1 form."""
    head = [("WARC-Type", r["warc_type"]), ("WARC-Record-ID", r["record_id"]), ("WARC-Date", r["warc_date"]), ("WARC-Target-URI", r["target_uri"]), ("WARC-Refers-To", r["refers_to"]), ("WARC-Concurrent-To", r["concurrent_to"]), ("WARC-Block-Digest", r["block_digest"]), ("Content-Type", r["content_type"]), ("Content-Length", str(r["content_length"]))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {safe(v)}\r\n" for k, v in head).encode() + b"\r\n" + bytes(r["block"]) + b"\r\n\r\n"


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        headers = {k: v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        n = int(headers["Content-Length"])
        yield headers, data[end + 4 : end + 4 + n]
        at = end + 8 + n


def _safe(c: Column) -> Column:
    """safe() by built-in functions: most values have no control character and are left alone."""
    out = F.coalesce(c.cast("string"), F.lit(""))
    bad = [*range(32), 127]
    cleaned = out
    for i in bad:
        cleaned = F.replace(cleaned, F.lit(chr(i)), F.lit(f"%{i:02X}"))
    return F.when(F.regexp_like(out, F.lit(r"[\x00-\x1f\x7f]")), cleaned).otherwise(out)


def with_warc(records: DataFrame) -> DataFrame:
    """records and `warc`: the serialised record, by built-in functions; concatenated values make a WARC file."""
    line = lambda k, c: F.concat(F.lit(f"{k}: "), _safe(F.col(c)), F.lit("\r\n"))
    head = F.concat(F.lit("WARC/1.1\r\n"), line("WARC-Type", "warc_type"), line("WARC-Record-ID", "record_id"), line("WARC-Date", "warc_date"), line("WARC-Target-URI", "target_uri"), line("WARC-Refers-To", "refers_to"), line("WARC-Concurrent-To", "concurrent_to"), line("WARC-Block-Digest", "block_digest"), line("Content-Type", "content_type"), line("Content-Length", "content_length"), F.lit("\r\n"))
    return records.withColumn("warc", F.concat(head.cast("binary"), F.col("block"), F.lit("\r\n\r\n").cast("binary")))
