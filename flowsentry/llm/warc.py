"""WARC derivatives (operator 6): response, metadata and conversion records of captured pages.

Every page gives three linked records.  The ``response`` record keeps the capture's own headers
and digests; the ``metadata`` record (JSON) holds the status line and headers of the capture, the
title, the declared language and all links; the ``conversion`` record holds the plain text.  The
derived records name the response in ``refers_to`` and carry its target address and date.
Record ids are name-based, so a repeated run gives the same ids.

A page's ``html`` may begin with an HTTP status line and headers, which then are the source
headers; a bare document has none.

Edge cases: a NULL ``html`` is an empty document, a NULL ``url`` an empty address; repeated rows
give repeated records with equal ids; unclosed comments, scripts and tags run to the end of the
document; a NULL ``page_id`` is carried through; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import html as html_lib
import json
import re
import uuid
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame

RECORD_SCHEMA = ("page_id long, warc_type string, record_id string, refers_to string, target_uri string, "
                 "warc_date string, content_type string, content_length long, block_digest string, "
                 "payload_digest string, n_links long, block string")

_DROP = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b[^>]*(?:>|\Z).*?(?:</\1\s*>|\Z)", re.S | re.I)
_BREAK = re.compile(r"</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|article|section|header|footer|nav|title|head|body|"
                    r"blockquote|pre|hr|td|th|option|form)\b[^>]*(?:>|\Z)", re.I)
_TAG = re.compile(r"<[!/?a-zA-Z][^>]*(?:>|\Z)")
_SPACE = re.compile(r"[^\S\n]+")
_LINES = re.compile(r" ?\n[\s]*")
_TITLE = re.compile(r"<title\b[^>]*(?:>|\Z)(.*?)(?:</title|\Z)", re.S | re.I)
_HTML_TAG, _LANG = re.compile(r"<(html)\b", re.I), re.compile(r"\b(lang)\s*=\s*[\"']?([\w-]+)", re.I)
_LINK_TAG = re.compile(r"<(a|link|img|script|iframe)\b", re.I)
_LINK = re.compile(r"\b(href|src)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HTTP = re.compile(r"HTTP/\d(?:\.\d)? \d{3}[^\r\n]*\r?\n")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, json.dumps(parts))}>"


def split_capture(capture: str) -> tuple[str, list[list[str]], str]:
    """Status line, header fields and body."""
    if not _HTTP.match(capture):
        return "", [], capture
    cut = re.search(r"\r?\n\r?\n", capture)
    head, body = (capture[:cut.start()], capture[cut.end():]) if cut else (capture, "")
    lines = head.splitlines()
    return lines[0], [[k.strip(), v.strip()] for k, _, v in (x.partition(":") for x in lines[1:] if x.strip())], body


def plain_text(body: str) -> str:
    """Visible text: scripts, styles and comments dropped, block elements as lines, references resolved."""
    text = _TAG.sub("", _BREAK.sub("\n", _DROP.sub(" ", body)))
    if "&" in text:
        text = html_lib.unescape(text)
    return _LINES.sub("\n", _SPACE.sub(" ", text)).strip()


def attributes(body: str, tag: re.Pattern, attribute: re.Pattern):
    """``(tag, attribute)`` matches: the first wanted attribute of each tag, before the tag's ``>`` or the end.

    The next ``>`` and the next attribute are looked up once and kept until the tags pass them, so a
    page of unclosed tags takes time in proportion to its length.
    """
    at, close, found, more = 0, -1, None, True
    while start := tag.search(body, at):
        at = start.end()
        if close < at:
            close = body.find(">", at)
            close = len(body) if close < 0 else close
        if more and (found is None or found.start() < at):
            found = attribute.search(body, at)
            more = found is not None
        if more and found.start() < close:
            yield start, found
            at = found.end()


def links(body: str, base: str) -> list[dict]:
    seen = []
    for start, found in attributes(_DROP.sub(" ", body) if "<!--" in body else body, _LINK_TAG, _LINK):
        target = html_lib.unescape(next((v for v in found.groups()[1:] if v), "")).strip()
        try:
            address = urljoin(base, target)
        except ValueError:      # not an address; kept as written
            address = target
        seen.append({"path": f"{start[1].upper()}@/{found[1].lower()}", "url": address})
    return seen


def derive(page_id, url: str | None, capture: str | None, date: str) -> list[tuple]:
    """The three records of one capture."""
    url, capture = url or "", capture or ""
    raw = capture.encode("utf-8", "surrogatepass")
    status, headers, body = split_capture(capture)
    payload = digest(body.encode("utf-8", "surrogatepass"))
    source = record_id("response", page_id, url, digest(raw))
    found = links(body, url)
    title = _TITLE.search(body)
    lang = next((found for _, found in attributes(body, _HTML_TAG, _LANG)), None)
    meta = json.dumps({
        "envelope": {"record-id": source, "target-uri": url, "date": date, "block-digest": digest(raw),
                     "payload-digest": payload, "content-length": len(raw)},
        "response": {"status-line": status, "headers": headers},
        "html": {"title": plain_text(title[1]) if title else None, "lang": lang[2] if lang else None, "links": found},
    }, ensure_ascii=False)
    text = plain_text(body)
    out = [(page_id, "response", source, None, url, date,
            "application/http; msgtype=response" if status else "text/html", len(raw), digest(raw), payload, len(found), None)]
    for kind, content, block in (("metadata", "application/json", meta), ("conversion", "text/plain", text)):
        data = block.encode("utf-8", "surrogatepass")
        out.append((page_id, kind, record_id(kind, source), source, url, date, content, len(data), digest(data), payload,
                    len(found), block))
    return out


def serialise(record: tuple, block: bytes) -> bytes:
    """One record in WARC/1.1 form; ``record`` as in ``RECORD_SCHEMA``."""
    _, kind, rid, refers, uri, date, content, _, block_digest, payload, _, _ = record
    head = [("WARC-Type", kind), ("WARC-Record-ID", rid), ("WARC-Refers-To", refers), ("WARC-Target-URI", uri),
            ("WARC-Date", date), ("WARC-Block-Digest", block_digest),
            ("WARC-Payload-Digest", payload if kind == "response" else None), ("Content-Type", content),
            ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head if v)
    return f"WARC/1.1\r\n{lines}\r\n".encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def warc_records(pages: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """``page_id, warc_type, record``: the three records of every page in WARC/1.1 form, the response with its capture."""
    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                out = []
                for page, url, capture in zip(*(batch.column(k).slice(a, 64).to_pylist() for k in range(3))):
                    for r in derive(page, url, capture, date):
                        block = capture or "" if r[1] == "response" else r[-1]
                        out.append((page, r[1], serialise(r, block.encode("utf-8", "surrogatepass"))))
                page, kind, record = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(page, pa.int64()), pa.array(kind), pa.array(record, pa.binary())],
                                                 ["page_id", "warc_type", "record"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, warc_type string, record binary")


def derivatives(pages: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Three rows per page, see ``RECORD_SCHEMA``; no shuffle."""
    names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]
    kinds = {"page_id": pa.int64(), "content_length": pa.int64(), "n_links": pa.int64()}

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                rows = [r for p, u, h in zip(*(part.column(k).to_pylist() for k in range(3))) for r in derive(p, u, h, date)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, kinds.get(n, pa.string())) for n, c in zip(names, zip(*rows))], names)

    return pages.select("page_id", "url", "html").mapInArrow(run, RECORD_SCHEMA)
