"""WARC derivatives: metadata and plain-text conversion records linked to their response records.

Each response gives a ``metadata`` record (application/warc-fields) and, for a
text body, a ``conversion`` record (text/plain). Both carry WARC-Refers-To with
the response's id, its target URI and date; the metadata record keeps the
response's HTTP headers and digests. Record ids are made from the response's id,
so a retried task writes the same records. Rows are independent: no shuffle.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TAG = re.compile(r"<(!--|[!?]|/?[a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_BLOCK = frozenset("address article aside blockquote body br dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 head header "
                   "hr html li main nav ol p pre section table td th title tr ul".split())
_SKIPPED = frozenset(("script", "style", "noscript", "template", "title"))
_CLOSE = {name: re.compile(f"</{name}", re.IGNORECASE | re.ASCII) for name in _SKIPPED}
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w.:-]+)", re.IGNORECASE)

RESULT = ("response_id string, warc_type string, record_id string, refers_to string, target_uri string, warc_date string, "
          "content_type string, block_digest string, source_payload_digest string, content_length long, record binary")


def digest(data: bytes) -> str:
    """Labelled digest as WARC writes it."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def parse_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and body as sent; a block without an empty line has no body."""
    head, _, body = block.partition(b"\r\n\r\n")
    first, *rest = head.decode("latin-1").split("\r\n")
    return first, [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in rest) if k.strip()], body


def decoded_body(headers: dict[str, str], body: bytes) -> bytes:
    """The body without chunking and compression; as it is where those are broken."""
    if "chunked" in headers.get("transfer-encoding", "").lower():
        whole, rest = [], body
        while rest:
            size, _, rest = rest.partition(b"\r\n")
            try:
                n = int(size.split(b";")[0], 16)
            except ValueError:
                whole = [body]
                break
            if not n:
                break
            whole.append(rest[:n])
            rest = rest[n + 2:]
        body = b"".join(whole)
    try:
        if (kind := headers.get("content-encoding", "").lower()) in ("gzip", "x-gzip"):
            return gzip.decompress(body)
        if kind == "deflate":
            return zlib.decompress(body)
    except (OSError, EOFError, zlib.error):
        pass
    return body


def _tag_end(source: str, at: int, last: dict[str, int]) -> int:
    """Where the tag that holds ``at`` is over. A > inside a quoted value does not end it; a quote that is not closed (``last`` holds the last of either) is a character."""
    while m := _STOP.search(source, at):
        if m[0] == ">":
            return m.end()
        value = m.start() < last[m[0]] and source[at:m.start()].rstrip().endswith("=")
        at = source.index(m[0], m.end()) + 1 if value else m.end()
    return len(source)


def html_text(source: str) -> tuple[str, str, list[str]]:
    """Plain text, title and link targets; one pass, linear in the length.

    Comments, declarations (``<!DOCTYPE ..>``) and processing instructions
    (``<?xml ..?>``) are left out, as is what scripts, styles, templates and the
    like hold.
    """
    out, links, title, at = [], [], "", 0
    last = {q: source.rfind(q) for q in "\"'"}
    while m := _TAG.search(source, at):
        out.append(source[at:m.start()])
        name = m[1].lower()
        if name == "!--":
            end = source.find("-->", m.end())
            at = len(source) if end < 0 else end + 3
            continue
        if name in ("!", "?"):
            end = source.find(">", m.end())
            at = len(source) if end < 0 else end + 1
            continue
        stop = _tag_end(source, m.end(), last)
        if name in _SKIPPED:
            m = _CLOSE[name].search(source, stop)
            close = m.start() if m else -1
            if name == "title" and not title:
                title = " ".join(html.unescape(source[stop:close if close >= 0 else len(source)]).split())
            at = len(source) if close < 0 else close
            continue
        if name == "a":
            hrefs = (a for a in _ATTRIBUTE.finditer(source, m.end(), stop) if a[1].lower() == "href")
            if (a := next(hrefs, None)) and a[0] != a[1]:
                links.append(html.unescape(a[2] or a[3] or a[4] or ""))
        if name.lstrip("/") in _BLOCK:
            out.append("\n")
        at = stop
    out.append(source[at:])
    lines = (" ".join(x.split()) for x in html.unescape("".join(out)).split("\n"))
    return "\n".join(x for x in lines if x), title, links


def _record(kind: str, record_id: str, refers_to: str, uri: str, date: str, content_type: str, block: bytes, more: list[str]) -> bytes:
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Refers-To: <{refers_to}>", f"WARC-Target-URI: {uri}",
            f"WARC-Date: {date}", f"WARC-Block-Digest: {digest(block)}", *more, f"Content-Type: {content_type}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _one_line(x: str) -> str:
    return " ".join(x.split())


def derive(response_id: str | None, uri: str | None, date: str | None, payload_digest: str | None, block: bytes | None) -> list[tuple]:
    """The derived records of one response, in the columns of ``RESULT``."""
    uri, date, block = _one_line(uri or ""), date or "", block or b""
    status, headers, body = parse_http(block)
    by_name = {k.lower(): v for k, v in headers}
    payload_digest = payload_digest or digest(body)
    response_id = response_id or f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{uri} {date} {payload_digest}')}"
    meta_id, text_id = (f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{response_id}#{x}')}" for x in ("metadata", "conversion"))
    kind = by_name.get("content-type", "").split(";")[0].strip().lower()
    title, links, text = "", [], None
    if not kind or kind.startswith("text/") or kind in ("application/xhtml+xml", "application/xml"):
        m = _CHARSET.search(by_name.get("content-type", ""))
        raw = decoded_body(by_name, body)
        try:
            text = raw.decode(m[1] if m else "utf-8", "replace")
        except LookupError:
            text = raw.decode("utf-8", "replace")
        if kind != "text/plain":
            text, title, links = html_text(text)
    fields = [("source-status", status), *((f"source-header-{k.lower()}", v) for k, v in headers),
              ("source-block-digest", digest(block)), ("source-payload-digest", payload_digest), ("title", title)]
    if text is not None:
        fields += [("conversion", f"<{text_id}>"), ("text-chars", str(len(text)))]
    fields += [("outlink", x) for x in links]
    meta = "".join(f"{k}: {_one_line(v)}\r\n" for k, v in fields).encode()
    rows = [("metadata", meta_id, "application/warc-fields", meta)]
    if text is not None:
        rows.append(("conversion", text_id, "text/plain; charset=utf-8", text.encode()))
    return [(response_id, kind, own, response_id, uri, date, content, digest(data), payload_digest, len(data),
             _record(kind, own, response_id, uri, date, content, data, [f"WARC-Source-Payload-Digest: {payload_digest}"]))
            for kind, own, content, data in rows]


def build_derivatives(responses: DataFrame) -> DataFrame:
    """Derived records of response rows ``record_id, target_uri, warc_date, payload_digest, block``; columns as in ``RESULT``.

    ``record`` is the whole WARC record. A null block is an empty response
    without headers: its metadata has no source headers and its conversion is
    empty. A null id is made from URI, date and digest; other nulls are empty,
    a null digest is computed. A body that is no text gives metadata alone.
    Repeated rows each give their records; an empty table gives none; further
    columns are left out.
    """
    names = [x.split()[0] for x in RESULT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                rows = [r for x in zip(*(c.to_pylist() for c in b.columns), strict=True) for r in derive(*x)]
                cols = list(zip(*rows, strict=True)) or [()] * len(names)
                kinds = [pa.string()] * 9 + [pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return responses.select("record_id", "target_uri", "warc_date", "payload_digest", "block").mapInArrow(run, RESULT)


def responses_of_pages(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Stand-in response rows of ``pages (page_id, url, html)``: only wraps each page as an HTTP message."""
    body = F.coalesce("html", F.lit(""))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nServer: archive\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    h = F.md5(F.concat_ws(" ", F.lit("response"), F.col("page_id").cast("string"), F.col("url")))
    parts = F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    return pages.select("page_id", F.concat(F.lit("urn:uuid:"), parts).alias("record_id"), F.col("url").alias("target_uri"),
                        F.lit(date).alias("warc_date"), F.lit(None).cast("string").alias("payload_digest"),
                        F.encode(F.concat(head, body), "utf-8").alias("block"))
