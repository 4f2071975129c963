"""Legacy archive converter: ARC records to WARC records, and WARC archives written and read by Spark.

ARC: each record is a header line, a line feed and as many bytes as the line declares. Version 1 lines have five fields (URL,
IP, date, type, length), version 2 lines ten (result code, checksum, location, offset and file name come before the length).
The ``filedesc:`` record that opens a file says which; without one, the line is taken as version 2 if it has the shape.
From a record come its WARC counterpart's identifier (a name-based UUID of URL, date, key and payload digest), timestamp (the
date's digits, padded), type (warcinfo, response, resource; revisit where the caller says what it repeats) and SHA-1 digests. A
revisit refers to its response by identifier, URL and date. What WARC has no field for is kept: the lines of the ``filedesc:`` body
as fields of the warcinfo record, and result code, checksum, location, offset and file name of version 2 as ``X-ARC-`` headers.

Archives are written by Spark's text writer, with the two line ends that close a WARC record as its separator, so no file is
opened by hand and any store that Spark writes serves. They are read back as whole files of one task's rows each. That writer makes one
gzip member a file; ``convert_archives`` gives records as rows, for writers that make one a record.

Defined results: null or empty payloads are records of length 0; null URLs are ``urn:unknown``; white space and control
characters in URLs are percent-encoded; a malformed ARC header line is skipped up to the next line; a truncated body ends the
archive. Rows with equal ids are each written. A row with a null id is a revisit if some row with an id has its payload. Ids stay
in Arrow and in text, so they are exact beside nulls too.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import cut, shared_path

#: Fixed by the formats.
ARC_FIELDS = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
CRLF = b"\r\n"
END = "\r\n\r\n"

_V1 = re.compile(rb"^(.*?) (\S+) (\d{4,17}) (.*) (\d+)$", re.S)
_V2 = re.compile(rb"^(.*?) (\S+) (\d{4,17}) (.*) (\S+) (\S+) (\S+) (\S+) (\S+) (\d+)$", re.S)
#: Fields of version 2 that WARC has no field for, in the order of the header line.
_ARC_EXTRA = ("Result-Code", "Checksum", "Location", "Offset", "Filename")
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


@dataclass
class ArcRecord:
    url: str
    ip: str
    date: str
    mime: str
    content: bytes
    version: int
    extra: dict[str, str] = field(default_factory=dict)
    offset: int = 0


@dataclass
class Original:
    """What a revisit refers to."""

    key: str
    url: str
    date: str


@dataclass
class WarcRecord:
    headers: dict[str, str]
    block: bytes = b""
    payload: bytes = b""

    def to_bytes(self) -> bytes:
        """Without the closing pair of line ends."""
        lines = [b"WARC/1.0"] + [f"{k}: {v}".encode() for k, v in (self.headers | {"Content-Length": str(len(self.block))}).items()]
        return CRLF.join(lines) + CRLF + CRLF + self.block


def safe_url(url: str | None) -> str:
    return _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url) if url else "urn:unknown"


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def arc_header(version: int, url: str, ip: str, date: str, mime: str, length: int, code: str = "200") -> bytes:
    middle = f" {code} - - 0 -" if version == 2 else ""
    return f"{url} {ip} {date} {mime}{middle} {length}\n".encode()


def arc_version_block(version: int, name: str, date: str) -> bytes:
    body = f"{version} 0 millrace\n{ARC_FIELDS[version]}\n".encode()
    return arc_header(version, f"filedesc://{name}", "0.0.0.0", date, "text/plain", len(body)) + body + b"\n"


def read_arc(stream: io.BufferedIOBase) -> Iterator[ArcRecord]:
    version, at = 0, 0
    while line := stream.readline():
        start, at = at, at + len(line)
        line = line.rstrip(b"\r\n")
        if not line:
            continue
        found, kind = None, version
        for kind in [version] if version else [2, 1]:
            if found := (_V2 if kind == 2 else _V1).match(line):
                break
        # The opening record's own line has either shape, whatever the version it announces.
        if not found and not (found := _V1.match(line)):
            continue
        parts = [x.decode("utf-8", "replace") for x in found.groups()]
        content = stream.read(int(parts[-1]))
        at += len(content)
        if len(content) < int(parts[-1]):
            return
        if parts[0].startswith("filedesc:") and content[:1] in (b"1", b"2"):
            version = kind = int(content[:1])
        extra = dict(zip(_ARC_EXTRA, parts[4:9], strict=True)) if len(parts) == 10 else {}
        yield ArcRecord(parts[0], parts[1], parts[2], parts[3], content, kind, extra, start)


def warc_date(digits: str) -> str:
    """14 digits, shorter ones padded with the first month, day and midnight, longer ones cut."""
    d = (digits + "00000101000000"[len(digits) :])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def split_http(content: bytes) -> tuple[bytes, bytes] | None:
    if not content.startswith(b"HTTP/"):
        return None
    for mark in (b"\r\n\r\n", b"\n\n"):
        if (i := content.find(mark)) >= 0:
            return content[: i + len(mark)], content[i + len(mark) :]
    return content, b""


def record_id(url: str, date: str, key: str, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {date} {key} {digest}')}>"


def to_warc(arc: ArcRecord, key: str = "", repeats: Original | None = None) -> WarcRecord:
    """``key`` makes records with equal URL, date and payload distinct; ``repeats``: the response of equal payload that it revisits."""
    date = warc_date(arc.date)
    extra = {f"X-ARC-{k}": v for k, v in arc.extra.items() if v != "-"}
    if arc.url.startswith("filedesc:"):
        fields = ["software: millrace", "format: WARC File Format 1.0", f"description: converted from ARC {arc.version}"]
        fields += [f"x-arc-filedesc: {x}" for x in arc.content.decode("utf-8", "replace").splitlines() if x.strip()]
        head = {"WARC-Type": "warcinfo", "WARC-Record-ID": record_id(arc.url, arc.date, key, sha1(arc.content)), "WARC-Date": date, "WARC-Filename": arc.url.removeprefix("filedesc://")}
        return WarcRecord(head | extra | {"Content-Type": "application/warc-fields"}, "".join(f"{x}\r\n" for x in fields).encode())
    http = None if arc.url.startswith("dns:") else split_http(arc.content)
    block, payload = arc.content, http[1] if http else arc.content
    digest = sha1(payload)
    head = {"WARC-Type": "response" if http else "resource", "WARC-Record-ID": record_id(arc.url, arc.date, key, digest), "WARC-Date": date, "WARC-Target-URI": arc.url, "WARC-IP-Address": arc.ip}
    head |= extra | ({"X-Source-Key": key} if key else {})
    head |= {"Content-Type": "application/http; msgtype=response" if http else arc.mime, "WARC-Payload-Digest": f"sha1:{digest}"}
    if http:
        head["X-Payload-Length"] = str(len(payload))
    if http and repeats is not None:
        head |= {
            "WARC-Type": "revisit", "WARC-Profile": "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", "WARC-Refers-To": record_id(repeats.url, repeats.date, repeats.key, digest),
            "WARC-Refers-To-Target-URI": repeats.url, "WARC-Refers-To-Date": warc_date(repeats.date), "X-Refers-To-Key": repeats.key,
        }
        block, payload = http[0], b""
    return WarcRecord(head | {"WARC-Block-Digest": f"sha1:{sha1(block)}"}, block, payload)


def read_warc(stream: io.BufferedIOBase) -> Iterator[WarcRecord]:
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        headers = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip()] = value.strip()
        block = stream.read(int(headers["Content-Length"]))
        http = split_http(block) if headers.get("Content-Type", "").startswith("application/http") else None
        yield WarcRecord(headers, block, http[1] if http else block)


def convert_archives(files: DataFrame) -> DataFrame:
    """ARC files, rows (path, content) as of Spark's binaryFile source, plain or gzip: one WARC record a row, in order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                raw = io.BytesIO(content or b"")
                stream = io.BufferedReader(gzip.GzipFile(fileobj=raw)) if (content or b"")[:2] == b"\x1f\x8b" else raw
                rows = []
                for arc in read_arc(stream):
                    w = to_warc(arc, f"{path}#{arc.offset}")
                    rows.append((path, arc.offset, w.headers["WARC-Type"], arc.url, w.headers["WARC-Date"], w.headers["WARC-Record-ID"], w.headers.get("WARC-Payload-Digest"), w.to_bytes()))
                    if len(rows) >= 500:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                yield pd.DataFrame(rows, columns=names)

    names = ["path", "offset", "record_type", "url", "date", "record_id", "payload_digest", "record"]
    return files.select("path", "content").mapInPandas(run, "path string, offset long, record_type string, url string, date string, record_id string, payload_digest string, record binary")


#: Pages carry no date.
PAGE_DATE = "20240101"


def page_archive(ids: list, urls: list, htmls: list, version: int, name: str) -> bytes:
    """Pages as one ARC archive; the id travels in a header of the response."""
    out = [arc_version_block(version, name, "20240101000000")]
    for i, url, html in zip(ids, urls, htmls, strict=True):
        payload = (html or "").encode("utf-8", "surrogatepass")
        head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {'' if i is None else i}\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
        out += [arc_header(version, safe_url(url), "0.0.0.0", PAGE_DATE, "text/html", len(head) + len(payload)), head, payload, b"\n"]
    return b"".join(out)


_PAGE_ID = re.compile(rb"\r\nX-Page-Id: (-?\d*)\r\n")


def write_pages(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Pages by way of ARC archives into WARC archives under ``path``: of equal payloads the smallest id is the response.

    First copies are found from digests alone, aggregated before the shuffle; only that table meets the pages, on the digest,
    in a join whose stream side adaptive execution can split where one payload holds a large part of the rows.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), F.sha1(F.coalesce(html_col, F.lit("")).cast("binary")).alias("digest"))
    known = F.when(F.col("id").isNotNull(), F.struct("id", "url"))
    first = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(known).alias("f")).where("n > 1 and f is not null")
    first = cut(first.select("digest", F.col("f.id").alias("first"), F.col("f.url").alias("first_url")))
    rows = rows.join(first.hint("shuffle_hash"), "digest", "left")
    own = F.expr("CASE WHEN id = first THEN NULL ELSE first END").cast("string")
    rows = rows.select(F.col("id").cast("string").alias("id"), "url", "html", own.alias("repeats"), "first_url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                ids, urls, htmls, repeats, first_urls = (c.to_pylist() for c in batch.slice(at, 200).columns)
                originals = iter([None if k is None else Original(k, safe_url(u), PAGE_DATE) for k, u in zip(repeats, first_urls, strict=True)])
                archive = page_archive(ids, urls, htmls, 1 + n % 2, f"pages-{n}.arc")
                out = []
                for arc in read_arc(io.BytesIO(archive)):
                    if arc.url.startswith("filedesc:"):
                        if not n:
                            out.append(to_warc(arc).to_bytes())
                        continue
                    key = _PAGE_ID.search(arc.content)
                    out.append(to_warc(arc, key[1].decode() if key else "", next(originals)).to_bytes())
                n += 1
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    records = rows.mapInArrow(run, "record binary")
    # One file a task, so that the warcinfo record of a task opens it.
    records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", END).option("compression", "gzip").text(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, of the records under ``path``; digests are verified."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                rows = []
                for w in read_warc(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content)))):
                    h = w.headers
                    if h["WARC-Type"] == "warcinfo":
                        continue
                    digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                    if f"sha1:{sha1(w.block)}" != h["WARC-Block-Digest"] or h["WARC-Type"] == "response" and sha1(w.payload) != digest:
                        raise ValueError(f"digest of {h['WARC-Record-ID']} does not hold")
                    size = len(w.payload) if h["WARC-Type"] == "response" else int(h["X-Payload-Length"])
                    rows.append((h.get("X-Source-Key"), size, digest, h["WARC-Type"], h.get("X-Refers-To-Key"), h.get("WARC-Target-URI"), h["WARC-Record-ID"], h.get("WARC-Refers-To")))
                    if len(rows) >= 10_000:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                yield pd.DataFrame(rows, columns=names)

    names = ["key", "payload_bytes", "payload_digest", "record_type", "refers", "target_uri", "record_id", "refers_to_record"]
    files = spark.read.format("binaryFile").load(path).select("content")
    found = files.mapInPandas(run, "key string, payload_bytes long, payload_digest string, record_type string, refers string, target_uri string, record_id string, refers_to_record string")
    return found.select(
        F.col("key").try_cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers").cast("long").alias("refers_to"), "target_uri", "record_id", "refers_to_record"
    )


def round_trip(pages: DataFrame) -> DataFrame:
    path = shared_path(pages.sparkSession, "warc")
    write_pages(pages, path)
    return read_pages(pages.sparkSession, path).drop("target_uri", "record_id", "refers_to_record")
