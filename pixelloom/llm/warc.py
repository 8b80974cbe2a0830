"""WARC derivatives: metadata and plain-text conversion records that refer to the response they were made from."""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.llm.common import columns

DATE = "1970-01-01T00:00:00Z"
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:pixelloom:warc")
RECORD = "page_id long, warc_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, block_digest string, payload_digest string, content_length long, source_headers map<string,string>, block binary"
FIELDS = ("page_id", "warc_type", "record_id", "refers_to", "target_uri", "warc_date", "content_type", "block_digest", "payload_digest", "content_length", "source_headers", "block")
TYPES = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary())

#: Elements whose content isn't text, and elements that end a line.
HIDDEN = ("script", "style", "noscript", "template", "head", "svg", "iframe", "object")
LINES = frozenset("address article aside blockquote br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol option p pre section table td th tr ul".split())

_name = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
_blank = re.compile(r"[ \t\r\f\v\xa0]+")
_controls = re.compile(r"[\x00-\x20\x7f]")
_link = re.compile(r"<a\b[^>]*?\bhref\s*=\s*[\"']?([^\"' >]+)", re.I)
_language = re.compile(r"\blang\s*=\s*[\"']?([A-Za-z-]+)", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(kind: str, *of: object) -> str:
    """The same record gets the same identifier whenever it is made again, as when an executor is lost."""
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, '|'.join(map(str, (kind, *of))))}>"


def plain_text(page: str) -> tuple[str, str, str]:
    """Title, text and language (of the first html tag that has one) of a page: one pass from tag to tag, so that unclosed elements don't cost more than their length."""
    low = page.lower() if len(page.lower()) == len(page) else "".join(c.lower() if c.isascii() else c for c in page)
    parts: list[str] = []
    title, language, at, n = "", "", 0, len(page)
    while at < n:
        tag = page.find("<", at)
        if tag < 0:
            parts.append(page[at:])
            break
        parts.append(page[at:tag])
        if page.startswith("<!--", tag):
            end = page.find("-->", tag + 4)
            at = n if end < 0 else end + 3
            continue
        found = _name.match(page, tag)
        if not found and not page.startswith(("<!", "<?"), tag):
            parts.append("<")
            at = tag + 1
            continue
        end = tag_end(page, tag)
        at = end
        if not found:
            continue
        name = found[1].lower()
        if name == "html" and not language and (said := _language.search(page[tag:end])):
            language = said[1].lower()
        if name in LINES:
            parts.append("\n")
        if name == "title" and page[tag + 1] != "/":
            close = low.find("</title", at)
            close = n if close < 0 else close
            title, at = title or page[at:close], close
        elif name in HIDDEN and name != "head" and page[tag + 1] != "/" and page[end - 2 : end] != "/>":
            close = low.find("</" + name, at)
            at = n if close < 0 else close
    lines = (_blank.sub(" ", line).strip() for line in html.unescape("".join(parts)).split("\n"))
    return " ".join(html.unescape(title).split()), "\n".join(line for line in lines if line), language


def tag_end(page: str, tag: int) -> int:
    """Past the > of a tag; one in a quoted value doesn't end it, unless the quote is never closed."""
    at = tag + 1
    while True:
        end = page.find(">", at)
        if end < 0:
            return len(page)
        quote = min((q for q in (page.find('="', at, end), page.find("='", at, end)) if q >= 0), default=-1)
        if quote < 0:
            return end + 1
        close = page.find(page[quote + 1], quote + 2)
        if close < 0 or page.find("<", quote + 2, close) >= 0 and close > end:
            return end + 1
        at = close + 1


def line_of(value: str) -> str:
    """A value as one header line: each run of white space and control characters is one space, so that none begins a field."""
    return " ".join(_controls.sub(" ", value).split())


def uri_of(url: str | None) -> str:
    """A URI as WARC wants it: no white space and no control characters, which are escaped."""
    return _controls.sub(lambda c: f"%{ord(c[0]):02X}", (url or "").strip())


def outlinks(page: str) -> list[str]:
    """The targets of links in order, as they are written."""
    return [line_of(html.unescape(x)) for x in _link.findall(page)]


def made(page_id, kind: str, uri: str, refers_to, content_type: str, block: bytes, payload: bytes, headers: dict, date: str) -> tuple:
    return (page_id, kind, record_id(kind, page_id, uri, refers_to, digest(block)), refers_to, uri, date, content_type, digest(block), digest(payload), len(block), list(headers.items()), block)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * len(FIELDS), TYPES, strict=True)], names=list(FIELDS))


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """A response record per row of pages (page_id, url, html): HTTP headers and the page.

    Null columns count as empty; white space and control characters within a url are escaped. Repeated rows give repeated
    records, further columns are ignored, an empty table gives no records. Pages hold no status, headers or date: those are
    200, type and length, and ``date``. Responses that have them come from ``read``.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page_id, url, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload = (page or "").encode()
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
                rows.append(made(page_id, "response", uri_of(url), None, "application/http; msgtype=response", head + payload, payload, {}, date))
            yield batch_of(rows)

    return columns(pages, "page_id", "url", "html").mapInArrow(build, RECORD)


def http_parts(block: bytes | None) -> tuple[str, dict[str, str], bytes]:
    head, _, payload = (block or b"").partition(b"\r\n\r\n")
    status, *lines = head.decode("latin-1").split("\r\n")
    return status, {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, payload


def derived(records: DataFrame) -> DataFrame:
    """For each response its metadata and its conversion record, each with the response's identifier, headers and digest.

    Other records are passed over, a null block counts as empty. The metadata names title, language and every link. Repeated responses give repeated records with equal identifiers. An empty page gives an
    empty text. An empty table gives no records.
    """

    def derive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page_id, source, uri, date, source_digest, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                status, sent, payload = http_parts(block)
                page = payload.decode("utf-8", "replace")
                title, text, language = plain_text(page)
                headers = {"status": status} | {k.lower(): v for k, v in sent.items()} | {"warc-payload-digest": source_digest}
                fields = [("title", title), ("language", language), *(("outlink", x) for x in outlinks(page)), ("textLength", str(len(text))), *((f"source-{k}", v) for k, v in headers.items())]
                about = "".join(f"{k}: {line_of(v)}\r\n" for k, v in fields).encode()
                rows.append(made(page_id, "metadata", uri, source, "application/warc-fields", about, about, headers, date))
                body = text.encode()
                rows.append(made(page_id, "conversion", uri, source, "text/plain; charset=utf-8", body, body, headers, date))
            yield batch_of(rows)

    return records.where("warc_type = 'response'").select("page_id", "record_id", "target_uri", "warc_date", "payload_digest", "block").mapInArrow(derive, RECORD)


def serialized(fields: dict) -> bytes:
    """One record as WARC 1.1, a gzip member of its own."""
    names = [("WARC-Type", "warc_type"), ("WARC-Record-ID", "record_id"), ("WARC-Date", "warc_date"), ("WARC-Target-URI", "target_uri"), ("WARC-Refers-To", "refers_to"), ("WARC-Block-Digest", "block_digest"), ("WARC-Payload-Digest", "payload_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length")]
    said = "".join(f"{name}: {line_of(str(fields[key]))}\r\n" for name, key in names if fields[key] is not None)
    said += "".join(f"X-Source-{line_of(k)}: {line_of(v or '')}\r\n" for k, v in fields["source_headers"])
    return gzip.compress(b"WARC/1.1\r\n" + said.encode() + b"\r\n" + fields["block"] + b"\r\n\r\n", mtime=0)


def archived(records: DataFrame) -> DataFrame:
    """(page_id, warc_type, record_id, member): each record as a gzip member; members put one after another are a WARC file."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = [serialized(row) for row in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(members, pa.binary())], names=["page_id", "warc_type", "record_id", "member"])

    return records.mapInArrow(write, "page_id long, warc_type string, record_id string, member binary")


def parsed(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a WARC file, compressed or not."""
    data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        start, n = end + 4, int(headers["content-length"])
        yield headers, data[start : start + n]
        at = start + n + 4


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of the WARC files under ``path``; a task holds one file at a time."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                out = []
                for h, block in parsed(data.as_py()):
                    out.append((None, h.get("warc-type"), h.get("warc-record-id"), h.get("warc-refers-to"), h.get("warc-target-uri"), h.get("warc-date"), h.get("content-type"), h.get("warc-block-digest"), h.get("warc-payload-digest"), len(block), [(k[9:], v) for k, v in h.items() if k.startswith("x-source-")], block))
                yield batch_of(out)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(rows, RECORD)


def derivatives(pages: DataFrame) -> DataFrame:
    """The derived records of a table of pages, with their blocks as text."""
    return derived(responses(pages)).withColumn("block", F.col("block").cast("string")).withColumn("source_headers", F.to_json("source_headers"))
