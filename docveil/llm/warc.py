"""WARC derivatives: linked metadata and plain-text conversion records from responses.

``responses`` makes response records of a table of pages.  ``derive`` turns each response into a ``conversion`` record (its plain text) and a
``metadata`` record (title, language, links, sizes); both name the response in WARC-Refers-To and keep its target URI, date, HTTP headers
and payload digest.  ``write_warc`` and ``read_warc`` store records as gzipped WARC/1.1, one member a record.

Ids are name-based (a UUID from the digest of type, source id, URI and payload), so a task that runs again makes the same records.

Defined results: a null or empty page has an empty conversion; null URLs give records without a target; repeated rows give repeated
records with equal ids; malformed HTML is read as far as it goes; an empty table gives no records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html as _html
import io
import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches

DATE = "1970-01-01T00:00:00Z"
RECORD = "page_id long, record_type string, record_id string, refers_to string, target_uri string, date string, content_type string, http_headers string, payload_digest string, block_digest string, content_length long, block binary"
_ARROW = pa.schema([(c.split()[0], {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[c.split()[1]]) for c in RECORD.split(", ")])
_DROP = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_BREAK = re.compile(r"</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|section|article|nav|header|footer|aside|main|blockquote|pre|form|hr|title|head|body|dl|dt|dd|option|figure)\b[^>]*>", re.I)
_TAG = re.compile(r"</?[A-Za-z!?][^>]*(?:>|\Z)")
_TITLE = re.compile(r"<title\b[^>]*>(.*?)(?:</title\s*>|\Z)", re.S | re.I)
_LANG = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z-]+)", re.I)
_HREF = re.compile(r"<a\b[^>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(chr(0).join(parts).encode('utf-8', 'surrogatepass')).digest()[:16], version=5)}>"


def plain_text(page: str) -> str:
    """The page's text: a line for each block, white space squeezed, entities resolved."""
    t = _DROP.sub(" ", page)
    # line ends of the source are white space; blocks make the lines
    t = _BREAK.sub("\n", t.replace("\n", " ").replace("\r", " "))
    t = _html.unescape(_TAG.sub("", t))
    return "\n".join(s for line in t.split("\n") if (s := " ".join(line.split())))


def page_metadata(page: str) -> dict:
    title, lang = _TITLE.search(page), _LANG.search(page)
    links = [_html.unescape(a or b or c) for a, b, c in _HREF.findall(page)]
    return {"title": " ".join(_html.unescape(_TAG.sub("", title[1])).split()) if title else "", "lang": lang[1] if lang else "", "links": links, "n_chars": len(page)}


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = DATE) -> DataFrame:
    """Response records whose block is the HTTP head and the page's UTF-8 bytes."""

    def make(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for i, url, page in zip(*(b[c].to_pylist() for c in ("id", "url", "html")), strict=True):
            body = page.encode("utf-8", "surrogatepass")
            head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n"
            block, pd = head.encode() + body, digest(body)
            rows.append((i, "response", record_id("response", str(i), url or "", pd), None, url, date, "application/http; msgtype=response", head, pd, digest(block), len(block), block))
        return _records(rows)

    df = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    return map_batches(df, make, RECORD)


def _records(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_ARROW)], schema=_ARROW)


def derived_from(r: dict) -> list[tuple]:
    """The metadata and the conversion record of a response."""
    body = bytes(r["block"] or b"").partition(b"\r\n\r\n")[2]
    charset = m[1] if (m := re.search(r"charset=([\w-]+)", r["http_headers"] or "", re.I)) else "utf-8"
    try:
        page = body.decode(charset, "replace")
    except LookupError:
        page = body.decode("utf-8", "replace")
    text = plain_text(page).encode("utf-8", "surrogatepass")
    rid = r["record_id"] or ""
    conv = record_id("conversion", rid)
    meta = page_metadata(page) | {"conversion": conv, "text_bytes": len(text), "text_digest": digest(text)}
    data = json.dumps(meta, ensure_ascii=False, sort_keys=True).encode("utf-8", "surrogatepass")
    shared = (r["record_id"], r["target_uri"], r["date"])
    kept = (r["http_headers"], r["payload_digest"])
    return [
        (r["page_id"], kind, i, *shared, mime, *kept, digest(block), len(block), block)
        for kind, i, mime, block in (("metadata", record_id("metadata", rid), "application/json", data), ("conversion", conv, "text/plain; charset=utf-8", text))
    ]


def derive(records: DataFrame) -> DataFrame:
    """Metadata and conversion records of all response records; other records are left out."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return _records([d for r in b.to_pylist() for d in derived_from(r)])

    return map_batches(records.where("record_type = 'response'").select(*_ARROW.names), run, RECORD)


_HEADER = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "refers_to": "WARC-Refers-To", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "content_type": "Content-Type", "payload_digest": "WARC-Payload-Digest", "block_digest": "WARC-Block-Digest", "http_headers": "X-Source-Headers", "page_id": "X-Source-Id"}


def to_bytes(r: dict) -> bytes:
    """One gzip member with the record."""
    lines = ["WARC/1.1"]
    for k, name in _HEADER.items():
        if r[k] is not None:
            v = json.dumps(r[k]) if k == "http_headers" else str(r[k])
            lines.append(f"{name}: {v}")
    lines.append(f"Content-Length: {len(r['block'])}")
    return gzip.compress("\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + r["block"] + b"\r\n\r\n", mtime=0)


def from_bytes(data: bytes) -> Iterator[dict]:
    """The records of a WARC file, gzipped or not."""
    f = io.BytesIO(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data)
    while line := f.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not at the start of a WARC record")
        head: dict[str, str] = {}
        while (h := f.readline().decode("utf-8", "surrogatepass").rstrip("\r\n")) != "":
            k, _, v = h.partition(":")
            head[k.strip().lower()] = v.strip()
        block = f.read(int(head.get("content-length", 0)))
        r = {k: head.get(n.lower()) for k, n in _HEADER.items()}
        if r["http_headers"] is not None:
            r["http_headers"] = json.loads(r["http_headers"])
        elif r["record_type"] == "response":
            r["http_headers"] = block.partition(b"\r\n\r\n")[0].decode("latin-1") + "\r\n\r\n"
        r["page_id"] = int(r["page_id"]) if r["page_id"] is not None else None
        yield r | {"content_length": len(block), "block": block}


def write_warc(records: DataFrame, path: str) -> None:
    """Write the records with Spark's writer, as rows of gzip members: ``read_warc`` reads them back, and their concatenation is a WARC file."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([pa.array([to_bytes(r) for r in b.to_pylist()], pa.binary())], names=["member"])

    map_batches(records.select(*_ARROW.names), run, "member binary").write.option("compression", "none").parquet(path)


def read_warc(spark: SparkSession, path: str, members: bool = True) -> DataFrame:
    """Records of what ``write_warc`` wrote, or (``members=False``) of WARC files in a folder."""
    src = spark.read.parquet(path).select(F.col("member").alias("data")) if members else spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("content").alias("data"))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return _records([tuple(r[n] for n in _ARROW.names) for d in b["data"].to_pylist() for r in from_bytes(d)])

    return map_batches(src, run, RECORD)
