"""Operator 6: WARC archives, with a reader that salvages damaged ones.

Writer: the records are text (the payload is UTF-8), so Spark's own text
writer puts them down with a blank-line record end; it runs on any file system
Spark knows and commits like any other sink.  Of records with equal payloads
the one with the smallest id is a ``response``; the others are ``revisit``
records that name it.  Minima are partially aggregated and joined back, so a
payload held by a third of all rows is no hot task.

Reader: each file is parsed by its records' lengths.  Every record is checked
(version line, header, length, record end, digest; for ``.gz`` files also each
member's own check sum).  After a failed check the reader looks for the next
version line or gzip member that does parse, goes on from there, and logs the
bytes in between as quarantined.  Files are kept small by the writer
(``file_bytes``); a task reads one at a time.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote_plus

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agrolens.llm.common import materialize
from agrolens.session import scratch_path

_END = "\r\n\r\n"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
_VERSION = re.compile(rb"WARC/\d\.\d\r?\n")
_MEMBER = b"\x1f\x8b\x08"


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 SHA-1 of a binary or string column, without Python."""
    hexed = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", _BASE32)


def records(pages: DataFrame, page_id: str, url: str, html: str, least: int = 0) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to) per row.

    Of rows whose equal payloads have ``least`` bytes or more, those with the
    smallest id are responses; all others revisit it.  Null html is empty; rows
    with a null id are responses if no row of theirs has an id; repeated rows
    with the smallest id are all responses.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"),
                        F.coalesce(F.col(html).cast("string"), F.lit("")).alias("payload"))
    rows = rows.select("*", F.octet_length("payload").cast("long").alias("payload_bytes"),
                       base32_sha1(F.col("payload").cast("binary")).alias("payload_digest"))
    # written first: its size is known when the join is planned, and payloads need not move where it is small
    first = materialize(rows.where(F.col("payload_bytes") >= least).groupBy("payload_digest", "payload_bytes").agg(
        F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "warc-first")
    again = ~F.col("page_id").eqNullSafe(F.col("first")) & F.col("first").isNotNull()
    return rows.join(first, ["payload_digest", "payload_bytes"], "left").select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest", F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("first")).alias("refers_to"))


def _header_value(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), "[\\x00-\\x20\\x7F]", " ")


def write_warc(found: DataFrame, path: str, mean_bytes: float, file_bytes: int = 8 << 20) -> None:
    """Writes ``records`` as text files of about ``file_bytes`` below ``path``; ``mean_bytes``: a payload's mean size."""
    def uid(c: Column) -> Column:
        h = F.md5(F.concat(F.lit("page "), c.cast("string")).cast("binary"))
        return F.concat(F.lit("<urn:uuid:"), *[x for i, (a, n) in enumerate(((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) for x in (
            [F.lit("-")] if i else []) + [F.substring(h, a, n)]], F.lit(">"))

    http = F.concat(F.lit(_HTTP + "Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(_END))
    block = F.when(F.col("record_type") == "response", F.concat(http, "payload")).otherwise(http)
    line = lambda name, c: F.when(c.isNull(), "").otherwise(F.concat(F.lit(f"{name}: "), c, F.lit("\r\n")))
    none = F.lit(None).cast("string")
    revisit = F.col("record_type") == "revisit"
    head = F.concat(
        F.lit("WARC/1.0\r\n"), line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", F.coalesce(uid(F.col("page_id")), F.lit("<urn:uuid:00000000-0000-0000-0000-000000000000>"))),
        line("WARC-Date", F.lit("1970-01-01T00:00:00Z")), line("WARC-Target-URI", _header_value(F.col("url"))),
        line("WARC-Page-ID", F.url_encode(F.col("page_id").cast("string"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        line("WARC-Payload-Length", F.col("payload_bytes").cast("string")),
        line("WARC-Profile", F.when(revisit, _PROFILE).otherwise(none)),
        line("WARC-Refers-To", F.when(revisit, uid(F.col("refers_to"))).otherwise(none)),
        line("WARC-Refers-To-Page", F.when(revisit, F.url_encode(F.col("refers_to").cast("string"))).otherwise(none)),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"))
    text = found.select(F.concat(head, block).alias("value"))
    text.write.option("lineSep", _END).option("maxRecordsPerFile", max(1, int(file_bytes / (mean_bytes + 700)))).text(path)


@dataclass
class Record:
    """One record that passed its checks, or (kind ``quarantine``) a gap of ``end - start`` bytes that did not."""

    kind: str
    start: int
    end: int
    headers: dict
    payload: bytes
    reason: str = ""


def _parsed(data: bytes, at: int) -> Record | str:
    """The record at ``at``, or why there is none."""
    m = _VERSION.match(data, at)
    if m is None:
        return "no version line"
    end = data.find(b"\r\n\r\n", m.end() - 2)
    if end < 0:
        return "header without end"
    headers = {}
    for line in data[m.end():end].split(b"\r\n"):
        if line:
            name, colon, value = line.partition(b":")
            if not colon:
                return "header line without colon"
            headers[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not headers.get("content-length", "").isdigit() or "warc-type" not in headers:
        return "no length or type"
    start, size = end + 4, int(headers["content-length"])
    stop = start + size
    if data[stop:stop + 4] != b"\r\n\r\n":
        return "no record end where the length says"
    block, payload = data[start:stop], data[start:stop]
    if headers.get("content-type", "").startswith("application/http"):
        payload = block.partition(b"\r\n\r\n")[2]
    digest = headers.get("warc-payload-digest", "")
    if headers["warc-type"] != "revisit" and digest.startswith("sha1:") \
            and digest[5:] != base64.b32encode(hashlib.sha1(payload).digest()).decode():
        return "payload digest differs"
    return Record(headers["warc-type"], at, stop + 4, headers, payload)


def read_plain(data: bytes) -> Iterator[Record]:
    """Records and quarantined gaps of an uncompressed archive, in order, without overlap."""
    at, gap, why = 0, None, ""
    while at < len(data):
        got = _parsed(data, at)
        if isinstance(got, Record):
            if gap is not None:
                yield Record("quarantine", gap, at, {}, b"", why)
                gap = None
            yield got
            at = got.end
            continue
        if gap is None:
            gap, why = at, got
        after = _VERSION.search(data, at + 1)
        at = after.start() if after else len(data)
    if gap is not None:
        yield Record("quarantine", gap, len(data), {}, b"", why)


#: Compressed bytes that are inflated at once.
_WINDOW = 1 << 16


def read_gzip(data: bytes) -> Iterator[Record]:
    """The same for an archive of one gzip member per record; places count compressed bytes."""
    at, gap, why, view = 0, None, "", memoryview(data)
    while at < len(data):
        got: Record | str = "no gzip member"
        if data.startswith(_MEMBER, at):
            inflate, parts, to = zlib.decompressobj(31), [], at
            try:
                while to < len(data) and not inflate.eof:  # fed in windows: the rest of the file is never copied
                    parts.append(inflate.decompress(view[to:to + _WINDOW]))
                    to += _WINDOW
                plain = b"".join(parts)
                if not inflate.eof:
                    got = "member without end"
                else:
                    got = _parsed(plain, 0)
                    if isinstance(got, Record):
                        if got.end != len(plain):
                            got = "member holds more than its record"
                        else:
                            got.start, got.end = at, min(to, len(data)) - len(inflate.unused_data)
            except zlib.error as e:
                got = f"member broken: {e}"
        if isinstance(got, Record):
            if gap is not None:
                yield Record("quarantine", gap, at, {}, b"", why)
                gap = None
            yield got
            at = got.end
            continue
        if gap is None:
            gap, why = at, got
        after = data.find(_MEMBER, at + 1)
        at = after if after >= 0 else len(data)
    if gap is not None:
        yield Record("quarantine", gap, len(data), {}, b"", why)


_FIELDS = ("file string, start long, stop long, record_type string, page_id string, url string, payload_bytes long, payload_digest string, "
           "refers_to string, payload binary, reason string")


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """One row per record of the archives below ``path``; a quarantined gap is a row of type ``quarantine``.

    start and stop are places in the file; reason says which check failed.
    payload_bytes and payload_digest are those of the full payload, computed
    here for responses and taken from the header for revisits.  ``payload``
    false leaves the payload out (null).  Empty files have no rows.
    """
    plain_id = lambda x: None if x is None else unquote_plus(x)  # noqa: E731  ids are written percent-encoded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                data, rows = data.as_py(), []
                for r in (read_gzip if data.startswith(_MEMBER) or name.endswith(".gz") else read_plain)(data):
                    h, full = r.headers, r.kind not in ("revisit", "quarantine")
                    size = len(r.payload) if full else h.get("warc-payload-length")
                    digest = base64.b32encode(hashlib.sha1(r.payload).digest()).decode() if full else \
                        h.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    rows.append((name, r.start, r.end, r.kind, plain_id(h.get("warc-page-id")), h.get("warc-target-uri"),
                                 None if size is None else int(size), digest, plain_id(h.get("warc-refers-to-page")),
                                 r.payload if payload and full else None, r.reason or None))
                types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(),
                         pa.binary(), pa.string())
                names = [x.split()[0] for x in _FIELDS.split(", ")]
                yield pa.record_batch([pa.array([x[i] for x in rows], t) for i, t in enumerate(types)], names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    # whole files to Python one by one
    return files.select("path", "content").mapInArrow(run, _FIELDS)


def round_trip(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> DataFrame:
    """Writes a record per row, reads the archives back, and returns what they say.

    page_id, payload_bytes, payload_digest, record_type, refers_to per row.
    Bytes that do not read back as a record end the query with an error: no row is lost unseen.
    """
    spark = pages.sparkSession
    kind = pages.select(page_id).schema[0].dataType.simpleString()
    mean = pages.agg(F.avg(F.octet_length(F.col(html).cast("string"))).alias("m")).first()["m"] or 0
    path = scratch_path(spark, f"warc-{uuid.uuid4().hex[:12]}")
    write_warc(records(pages, page_id, url, html, least), path, mean)
    gap = F.concat(F.lit("quarantined bytes in "), "file", F.lit(": "), "start", F.lit(" to "), "stop", F.lit(", "), "reason")
    back = read_warc(spark, path, payload=False).withColumn(
        "record_type", F.when(F.col("record_type") == "quarantine", F.raise_error(gap).cast("string")).otherwise(F.col("record_type")))
    return back.select(F.col("page_id").cast(kind).alias(page_id), "payload_bytes", "payload_digest", "record_type",
                       F.col("refers_to").cast(kind).alias("refers_to"))
