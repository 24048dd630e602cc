"""WARC derivatives: from every response a metadata record with its links and a conversion record with its plain text.

Both refer to the response by WARC-Refers-To and keep its target URI, date and payload digest, as the response itself gives it where it
does; its other headers, block digest included, are in the metadata. Identifiers are made from the response's, so they are the same
whenever a lost task runs again. Records can be written as WARC/1.1 bytes and read from them, one at a time.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import io
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from modalith.llm.common import col

_BREAK = re.compile(r"[\r\n]+")
SPACE = uuid.UUID("6f6d7f0a-5d0e-5c43-9f0e-2a2f5a7c1b90")
#: Date of a record whose source has none.
NO_DATE = "1970-01-01T00:00:00Z"
RECORD = "page_id long, record_type string, record_id string, refers_to string, target_uri string, payload_digest string, block_digest string, content_length long, headers string, block string"

#: Pages whose records a task holds at once.
SLICE = 32
_HIDDEN = ("script", "style", "noscript", "template", "svg", "iframe")
_CLOSING = {t: re.compile(rf"</{t}\s*>", re.I) for t in _HIDDEN}
_OPEN = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9]*)")
_MARK = re.compile(r"[>\"']")
_BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
#: Begins at the first character of a word and never goes back, so that a tag of any length is read once.
_ATTRIBUTE = re.compile(r"""(?<![\w:.-])([a-zA-Z_:][\w:.-]*+)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""")
_LINKS = {"a": "href", "area": "href", "link": "href", "img": "src", "script": "src", "iframe": "src", "form": "action", "source": "src", "video": "src", "audio": "src"}
_SPACES = re.compile(r"[ \t\r\f\v\xa0]+")
_LINES = re.compile(r" ?\n[ \n]*")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _tags(page: str) -> Iterator[tuple[int, int, bool, str, str, str]]:
    """(start, end, hides, "/" or "", tag name or "", attributes) of every piece of markup; hides: the piece is an element whose content
    is no text. A "<" that begins no tag is text, and so is one that no ">" follows. A tag ends at the first ">" outside of quotes; if
    a quote is never closed, this and all further tags end at the first ">" of any kind. Every character is thus read a few times at
    most."""
    at, last, quotes = 0, page.rfind(">"), True
    while 0 <= (start := page.find("<", at)):
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = len(page) if end < 0 else end + 3
            yield start, at, False, "", "", ""
            continue
        if start >= last:
            return
        m = _OPEN.match(page, start + 1)
        if not m:
            at = start + 1
            if page[at] in "!?/":
                at = page.find(">", at) + 1
                yield start, at, False, "", "", ""
            continue
        end = m.end()
        while quotes:
            mark = _MARK.search(page, end)
            if mark and mark[0] == ">":
                end = mark.start()
                break
            end = page.find(mark[0], mark.end()) + 1 if mark else 0
            if not end:
                quotes = False
        if not quotes:
            end = page.find(">", m.end())
        close, tag, attributes = m[1], m[2].lower(), page[m.end() : end]
        at, hides = end + 1, not close and tag in _CLOSING
        if hides:
            closing = _CLOSING[tag].search(page, at)
            at = closing.end() if closing else len(page)
        yield start, at, hides, close, tag, attributes


def parsed(page: str, url: str | None) -> tuple[str, dict]:
    """(plain text, {title, language, links, metas}) of a page. Blocks are set apart by one line break, white space is single."""
    out: list[str] = []
    links, metas, at = [], [], 0
    language, title_from, title = None, -1, None
    for start, end, hidden, close, tag, attributes in _tags(page):
        if start > at:
            out.append(page[at:start])
        at = end
        if not tag:
            continue
        if not hidden and tag in _BLOCK:
            out.append("\n")
            if tag == "title":
                if not close:
                    title_from = len(out)
                elif title_from >= 0 and title is None:
                    title = _clean("".join(out[title_from:]))
        if close or "=" not in attributes:
            continue
        if tag in _LINKS or tag in ("html", "meta"):
            have = {k.lower(): html.unescape(a or b or c) for k, a, b, c in _ATTRIBUTE.findall(attributes)}
            if tag == "html":
                language = language or have.get("lang")
            elif tag == "meta":
                if "content" in have and (name := have.get("name") or have.get("property") or have.get("http-equiv")):
                    metas.append({"name": name, "content": have["content"]})
            elif target := have.get(_LINKS[tag]):
                links.append({"path": f"{tag.upper()}@/{_LINKS[tag]}", "url": _joined(url, target)})
    out.append(page[at:])
    return _clean("".join(out)), {"title": title, "language": language, "links": links, "metas": metas}


def _joined(base: str | None, target: str) -> str:
    try:
        return urljoin(base or "", target.strip())
    except ValueError:
        return target


def _clean(text: str) -> str:
    """Entities undone, then white space made single."""
    if "&" in text:
        text = html.unescape(text)
    return _LINES.sub("\n", _SPACES.sub(" ", text)).strip()


def response_id(page_id: int | None, url: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, json.dumps([page_id, url]))}>"


def derived(page_id: int | None, url: str | None, page: str, record_id: str | None = None, date: str | None = None, source: dict[str, str] | None = None) -> list[tuple]:
    """The metadata and conversion records of one response, as rows of RECORD. source: the response's own headers, which metadata
    carry on; its payload digest is that of both records. Without one it is that of the page in UTF-8."""
    source = source or {}
    origin = record_id or response_id(page_id, url)
    payload = source.get("WARC-Payload-Digest") or digest(page.encode("utf-8", "surrogatepass"))
    text, facts = parsed(page, url)
    source = {"WARC-Record-ID": origin, "WARC-Target-URI": url, "WARC-Date": date or NO_DATE, "WARC-Payload-Digest": payload, **source}
    bodies = [
        ("metadata", "application/json", json.dumps({"source": source, "payload_length": len(page.encode("utf-8", "surrogatepass")), **facts}, ensure_ascii=False)),
        ("conversion", "text/plain", text),
    ]
    out = []
    for kind, content, body in bodies:
        data = body.encode("utf-8", "surrogatepass")
        name = f"<urn:uuid:{uuid.uuid5(SPACE, kind + origin)}>"
        headers = {"WARC-Type": kind, "WARC-Record-ID": name, "WARC-Refers-To": origin, "WARC-Target-URI": url, "WARC-Date": date or NO_DATE, "WARC-Payload-Digest": payload, "WARC-Block-Digest": digest(data), "Content-Type": content, "Content-Length": str(len(data))}
        if kind == "conversion" and facts["language"]:
            headers["WARC-Identified-Content-Language"] = facts["language"]
        # a line break within a value would end the header
        lines = "\r\n".join(f"{k}: {_BREAK.sub(' ', v)}" for k, v in headers.items() if v is not None)
        out.append((page_id, kind, name, origin, url, payload, headers["WARC-Block-Digest"], len(data), lines, body))
    return out


def derivatives(pages: DataFrame, own: bool = False) -> DataFrame:
    """Two rows of RECORD for every row of pages (page_id, url, html): its metadata and its conversion.

    With own, the columns record_id, date and headers (a JSON object of strings), those of them that there are, are the response's own;
    headers that are no such object count as none. Without a record_id one is made of page_id and url, without a date it is NO_DATE.
    Other columns, and without own these too, play no part.

    page_id is read as a long; one that is none is an error under ANSI and null otherwise. A null html has no payload and gives no
    records; an empty one gives both, with an empty text. A null url gives records without a target. Repeated rows give repeated
    records. An empty table gives an empty table. Pages of any length and shape take time in proportion to their length.
    """
    theirs = [col(c).cast("string").alias(c) if own and c in pages.columns else F.lit(None).cast("string").alias(c) for c in ("record_id", "date", "headers")]
    rows = pages.where(col("html").isNotNull()).select(col("page_id").cast("long").alias("page_id"), col("url").cast("string").alias("url"), col("html").cast("string").alias("html"), *theirs)
    schema = to_arrow_schema(T.StructType.fromDDL(RECORD))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), SLICE):
                some = zip(*(c.to_pylist() for c in whole.slice(at, SLICE).columns))
                records = [r for i, u, h, rid, d, source in some for r in derived(i, u, h, rid, d, _headers(source))]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*records), schema)], schema=schema)

    return rows.mapInArrow(build, RECORD)


def _headers(source: str | None) -> dict[str, str]:
    try:
        found = json.loads(source) if source else {}
    except ValueError:
        return {}
    return {k: v for k, v in found.items() if isinstance(v, str)} if isinstance(found, dict) else {}


def warc_bytes(headers: str, block: bytes) -> bytes:
    return b"WARC/1.1\r\n" + headers.encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def warc_records(file: BinaryIO | bytes, strict: bool = False) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every whole record of an uncompressed WARC file, one held at a time. What is no record is passed over up to
    the next line that begins one; a last record that is cut short is left out. strict: these raise ValueError instead."""
    f = io.BytesIO(file) if isinstance(file, bytes) else file

    def bad(what: str) -> None:
        if strict:
            raise ValueError(what)

    while line := f.readline(1 << 16):
        if not line.startswith(b"WARC/"):
            if line.strip():
                bad("no WARC record where one should begin")
            continue
        headers: dict[str, str] = {}
        while (line := f.readline(1 << 20)).strip():
            name, colon, value = line.decode("utf-8", "replace").partition(":")
            if colon:
                headers[name.strip()] = value.strip()
            else:
                bad(f"no header: {name[:80]}")
        length = next((v for k, v in headers.items() if k.lower() == "content-length"), "")
        if not line or not (length.isascii() and length.isdigit()):
            bad("a WARC record without a length")
            continue
        block = f.read(int(length))
        if len(block) < int(length):
            bad("the last WARC record is cut short")
            return
        if f.read(4) != b"\r\n\r\n":
            bad("a WARC record is longer or shorter than it says")
        yield headers, block


def http_payload(block: bytes) -> tuple[dict[str, str], bytes]:
    """(headers by lower-case name, body) of a response record's block, the body as it was transferred."""
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        return {}, block
    lines = (line.partition(":") for line in head.decode("latin-1").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, colon, v in lines if colon}, body


def unchunked(body: bytes) -> bytes:
    """The body behind chunked transfer encoding; as it is from where it isn't chunked."""
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        size = body[at:end].split(b";", 1)[0].strip()
        if not re.fullmatch(rb"[0-9a-fA-F]{1,8}", size):
            break
        n = int(size, 16)
        if not n:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + n])
        at = end + 2 + n + 2
    return b"".join([*out, body[at:]])


_CHARSET = re.compile(rb"""charset\s*=\s*["']?\s*([A-Za-z0-9_.:-]{2,40})""", re.I)


def page_text(headers: dict[str, str], body: bytes) -> str:
    """The page in a body: content encoding undone, then decoded by the charset of its type, of its first 4 KB, or as UTF-8. What can't
    be decoded becomes U+FFFD; a body that isn't encoded as it says is taken as it is."""
    for name in reversed([x.strip().lower() for x in headers.get("content-encoding", "").split(",")]):
        try:
            if name in ("gzip", "x-gzip"):
                body = gzip.decompress(body)
            elif name == "deflate":
                try:
                    body = zlib.decompress(body)
                except zlib.error:
                    body = zlib.decompress(body, -15)
        except (OSError, EOFError, zlib.error):
            break
    found = _CHARSET.search(headers.get("content-type", "").encode("latin-1", "replace")) or _CHARSET.search(body, 0, 4096)
    try:
        return body.decode(found[1].decode() if found else "utf-8", "replace")
    except (LookupError, UnicodeError, ValueError):
        return body.decode("utf-8", "replace")


def responses(files: DataFrame) -> DataFrame:
    """pages for derivatives(own=True), from WARC files (path, content), plain or gzip: url, html, record_id, date and headers of every
    response; page_id is null.

    headers gets the payload digest where the response has none: that of the body as transferred, without its chunks. A null content
    gives no rows, nor do records of other types. Damaged records are passed over, and a damaged gzip file ends where the damage is.
    Records are read, and rows leave the task, one at a time.
    """
    out = "url string, html string, record_id string, date string, headers string"
    schema = to_arrow_schema(T.StructType.fromDDL(out))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                content = batch.column(0)[i]
                if not content.is_valid:
                    continue
                raw = io.BufferedReader(_Bytes(content.as_buffer()))
                f = gzip.GzipFile(fileobj=raw) if raw.peek(2)[:2] == b"\x1f\x8b" else raw
                try:
                    for headers, block in warc_records(f):
                        if headers.get("WARC-Type") != "response":
                            continue
                        http, body = http_payload(block)
                        if "chunked" in http.get("transfer-encoding", "").lower():
                            body = unchunked(body)
                        headers.setdefault("WARC-Payload-Digest", digest(body))
                        row = headers.get("WARC-Target-URI"), page_text(http, body), headers.get("WARC-Record-ID"), headers.get("WARC-Date"), json.dumps(headers)
                        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)
                except (OSError, EOFError, zlib.error):
                    continue

    found = files.select(col("content").cast("binary").alias("content")).mapInArrow(read, out)
    return found.select(F.lit(None).cast("long").alias("page_id"), "*")


class _Bytes(io.RawIOBase):
    """A buffer as a file, without a copy."""

    def __init__(self, data: pa.Buffer) -> None:
        self.data, self.at = memoryview(data).cast("B"), 0

    def readable(self) -> bool:
        return True

    def readinto(self, to: bytearray) -> int:
        n = min(len(to), len(self.data) - self.at)
        to[:n] = self.data[self.at : self.at + n]
        self.at += n
        return n
