"""WARC derivatives: from response records, a linked metadata record and a plain-text conversion record each.

``responses`` writes pages as WARC/1.1 response records, ``parse`` reads records of any type back, and ``derive`` makes the derivatives: the
metadata record (application/warc-fields: title, language, length and outlinks of the page) and the conversion record (text/plain), both
with WARC-Refers-To set to the response's id, WARC-Refers-To-Target-URI and -Date to the source's headers, WARC-Source-Payload-Digest to the
digest of the payload they were made from, and a block digest of their own. Record ids are name-based UUIDs of type, id and URI, so a run
that is repeated after a failure writes the same records. Everything is done row by row; nothing is shuffled.

Defined results: a null url is written as an empty target URI, null HTML is an empty payload with an empty conversion; repeated pages give
repeated records with the same ids. Records that can't be parsed come back with type ``invalid`` and their bytes, and have no derivatives.
A record is self-contained bytes, so a file of them is their concatenation."""

from __future__ import annotations

import base64
import hashlib
import html as html_lib
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship

ship(__name__)
DATE = "2024-01-01T00:00:00Z"
#: elements whose content is no text, and those that end a line
HIDDEN = re.compile(r"<(script|style|noscript|template|svg)\b[^>]*>.*?</\1\s*>|<!--.*?-->|<(?:script|style)\b[^>]*>.*\Z", re.I | re.S)
BREAKS = re.compile(r"</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|article|section|nav|header|footer|title|blockquote|pre|td|th|option|hr)\b[^>]*>", re.I)
TAGS = re.compile(r"<[a-zA-Z/!?][^>]*>")
LINK = re.compile(r"<a\b[^>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
TITLE = re.compile(r"<title\b[^>]*>(.*?)</title\s*>", re.I | re.S)
LANG = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z-]+)", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(kind: str, key: str, uri: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind} {key} {uri}')}>"


def _clean(v: str) -> str:
    """A header value in one line, in ASCII."""
    return re.sub(r"[^\x21-\x7e]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode("utf-8", "surrogatepass")), v)


def compose(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def read(record: bytes) -> tuple[dict[str, str], bytes] | None:
    """(headers, block), or None if it is no record."""
    head, mark, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not mark or not lines[0].startswith("WARC/"):
        return None
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = headers.get("content-length", "")
    return (headers, rest[: int(n)]) if n.isdigit() and len(rest) >= int(n) else None


def response(key: str, url: str, page: str) -> bytes:
    payload, uri = page.encode("utf-8", "surrogatepass"), _clean(url)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return compose([("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", key, uri)), ("WARC-Target-URI", uri), ("WARC-Date", DATE), ("WARC-Payload-Digest", digest(payload)),
                    ("WARC-Block-Digest", digest(http + payload)), ("Content-Type", "application/http; msgtype=response")], http + payload)


def plain_text(page: str) -> str:
    t = html_lib.unescape(TAGS.sub("", BREAKS.sub("\n", HIDDEN.sub(" ", page))))
    lines = (" ".join(x.split()) for x in t.split("\n"))
    return "\n".join(x for x in lines if x)


def derived(record: bytes) -> list[bytes]:
    """The metadata and the conversion record of a response record; none for other records."""
    got = read(record)
    if got is None or got[0].get("warc-type") != "response":
        return []
    headers, block = got
    payload = block.partition(b"\r\n\r\n")[2]
    page = payload.decode("utf-8", "replace")
    source, uri, date = (headers.get(k, "") for k in ("warc-record-id", "warc-target-uri", "warc-date"))
    one = lambda m: " ".join(html_lib.unescape(m[1]).split()) if m else ""
    links = [x for m in LINK.findall(page) if (x := "".join(m))]
    fields = [("title", one(TITLE.search(page))), ("language", one(LANG.search(page))), ("bytes", str(len(payload))), *(("outlink", _clean(html_lib.unescape(x))) for x in links)]
    meta = "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "surrogatepass")
    text = plain_text(page).encode("utf-8", "surrogatepass")
    out = []
    for kind, body, mime in (("metadata", meta, "application/warc-fields"), ("conversion", text, "text/plain; charset=utf-8")):
        out.append(compose([("WARC-Type", kind), ("WARC-Record-ID", record_id(kind, source, uri)), ("WARC-Refers-To", source), ("WARC-Refers-To-Target-URI", uri), ("WARC-Refers-To-Date", date),
                            ("WARC-Target-URI", uri), ("WARC-Date", date), ("WARC-Source-Payload-Digest", headers.get("warc-payload-digest") or digest(payload)), ("WARC-Block-Digest", digest(body)), ("Content-Type", mime)], body))
    return out


def _each(df: DataFrame, schema: str, f, rows: int = 128) -> DataFrame:
    names = T._parse_datatype_string(schema).names

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, rows):
                part = b.slice(i, rows)
                got = [x for r in zip(*(part.column(c).to_pylist() for c in part.schema.names), strict=True) for x in f(*r)]
                yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in got], pa.int64() if n == "page_id" else pa.binary() if n in ("record", "block") else pa.string()) for j, n in enumerate(names)], names=names)

    return df.mapInArrow(run, schema)


def responses(pages: DataFrame) -> DataFrame:
    """page_id, record: one response record per page."""
    return _each(pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))), "page_id long, record binary",
                 lambda i, u, h: [(i, response("" if i is None else str(i), u, h))])


def derive(records: DataFrame) -> DataFrame:
    """page_id, record: the metadata and conversion records of the response records in ``records`` (page_id, record)."""
    return _each(records.select("page_id", "record"), "page_id long, record binary", lambda i, r: [(i, x) for x in derived(r or b"")])


def parse(records: DataFrame) -> DataFrame:
    """page_id, the linking headers and the block of each record."""
    keys = ("warc-type", "warc-record-id", "warc-refers-to", "warc-target-uri", "warc-date", "warc-source-payload-digest", "warc-block-digest")

    def one(i, r):
        got = read(r or b"")
        return [(i, *(got[0].get(k) for k in keys), got[1])] if got else [(i, "invalid", *[None] * 6, r)]

    return _each(records.select("page_id", "record"), "page_id long, type string, record_id string, refers_to string, target_uri string, date string, source_digest string, block_digest string, block binary", one)
