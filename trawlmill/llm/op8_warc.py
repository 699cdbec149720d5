"""WARC derivatives: metadata and plain-text conversion records for web responses.

Method: each response record gives two records that refer to it by its record id: `metadata` (JSON: the response's WARC and
HTTP headers, its digests, title, language and links) and `conversion` (plain text of the page).  Both carry the target
URI and date of the source and a digest of their own block.  Record ids are name-based from the source's id, so a second
run gives the same ids.  Markup is read by one scanner from left to right, in time linear in the page whatever it holds:
comments, scripts and styles go, block elements end a line, other tags vanish, character references are resolved, and a tag
that never ends is text.  Bodies are read by their transfer encoding, content encoding and charset.

`responses` builds response records from a table of pages; `serialise` gives a record's bytes, one gzip member each, so
records put one after the other are a valid file; `read_records` parses such files, each by one task, up to the 2 GB that
Spark reads as one value; broken records are left out.

Rows: a null page is an empty one, a null URL leaves the header out.  Equal rows give equal records.  Extra columns are
not read.
"""

from __future__ import annotations

import base64
import codecs
import gzip
import hashlib
import html
import json
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawlmill.llm.common import chunks, table

DATE = "1970-01-01T00:00:00Z"
NAMES = uuid.UUID("5b0c8d0e-6f5b-5a53-9d4b-0a1c7d6f2f11")

_OPENED = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*)")
_ENDS = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_CLOSED = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style", "noscript", "template", "title")}
_LINKS = frozenset("a area link img iframe".split())
_BLOCKS = frozenset(
    "address article aside blockquote body br dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split()
)
_LONG_NUMBER = re.compile(r"&#([0-9]{8,});?")

#: Bytes that are inflated at a time.
PIECE = 1 << 20
#: Inflated bytes of one response's body that are read; a larger body counts as one that can't be read (Unread-Encoding).
MAX_BODY = 1 << 28
#: Bytes of a record's header in a file.
MAX_HEAD = 1 << 20

GZIP = b"\x1f\x8b\x08"
_VERSION = re.compile(rb"^WARC/\d[^\r\n]{0,32}\r?\n", re.M)
_LINE_ENDS = re.compile(r"[\r\n]+")
_BLANK = re.compile(rb"\r?\n\r?\n")
_KNOWN = {x.lower(): x for x in ("WARC-Type", "WARC-Record-ID", "WARC-Refers-To", "WARC-Target-URI", "WARC-Date", "WARC-Payload-Digest", "WARC-Block-Digest", "Content-Type", "Content-Length")}
_CHARSET = re.compile(r"utf-?8|utf-?16(-?[lb]e)?|(us-)?ascii|iso-8859-\d{1,2}|latin1|windows-125\d|cp125\d|koi8-[ru]|shift[_-]jis|euc-(jp|kr)|gbk|gb2312|gb18030|big5")

RECORD = "page_id long, warc_type string, record_id string, refers_to string, target_uri string, headers map<string,string>, block binary"


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _unescaped(text: str) -> str:
    """Character references resolved; a number of very many digits is no character, as any other beyond the last one."""
    return html.unescape(_LONG_NUMBER.sub(lambda m: f"&#{m[1].lstrip('0') or '0'};" if len(m[1].lstrip("0")) < 8 else "&#1114112;", text))


def _attributes(inside: str) -> dict[str, str]:
    """A tag's attributes by lower-case name, the first of each."""
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(inside):
        found.setdefault(m[1].lower(), _unescaped(m[2] or m[3] or m[4] or ""))
    return found


class _TagEnds:
    """Where tags of one page end: at the next ``>`` that no quoted value holds.

    What is missing once is missing from there on, and is not looked for again: a kind of quote that doesn't come any more
    quotes nothing, and where quotes hold every ``>`` up to the page's end, quotes count no longer.  So all calls together
    read the page a fixed number of times.
    """

    def __init__(self, page: str) -> None:
        self.page, self.none_after, self.quotes = page, len(page), {'"', "'"}

    def after(self, at: int) -> int:
        """The place of the ``>``, or -1 where none follows."""
        plain = self.page.find(">", at) if at < self.none_after else -1
        if plain < 0:
            self.none_after = min(self.none_after, at)
            return -1
        place = at
        while self.quotes:
            m = _ENDS.search(self.page, place)
            if m is None:
                self.quotes.clear()
                break
            place = m.end()
            if m[0] == ">":
                return m.start()
            if m[0] in self.quotes and self.page[max(at, m.start() - 64) : m.start()].rstrip().endswith("="):
                shut = self.page.find(m[0], place)
                if shut < 0:
                    self.quotes.discard(m[0])
                else:
                    place = shut + 1
        return plain


def _scanned(page: str) -> tuple[str, dict]:
    """Plain text and description of a page, in one pass from left to right."""
    text: list[str] = []
    head: int | None = None  # number of pieces before an open <head>
    title = lang = None
    titles = True
    links: list[dict[str, str]] = []
    ends, at = _TagEnds(page), 0
    while (start := page.find("<", at)) >= 0:
        text.append(page[at:start])
        if page.startswith("<!--", start):
            shut = page.find("-->", start + 4)
            at = len(page) if shut < 0 else shut + 3
            text.append(" ")
            continue
        m = _OPENED.match(page, start)
        declared = m is None and page[start + 1 : start + 2] in ("!", "?")
        end = page.find(">", start) if declared and start < ends.none_after else ends.after(m.end()) if m else -1
        if end < 0:
            if declared:
                ends.none_after = min(ends.none_after, start)
            text.append("<")
            at = start + 1
            continue
        at = end + 1
        if m is None:
            text.append(" ")
            continue
        closing, name = bool(m[1]), m[2].lower()
        if closing:
            if name == "head" and head is not None:
                del text[head:]
                text.append("\n")
                head = None
        elif name == "title":
            shut = _CLOSED["title"].search(page, at) if titles else None
            titles = shut is not None
            if shut:
                if title is None:
                    title = _unescaped(page[at : shut.start()]).strip()
                text.append(page[at : shut.start()].replace("<", "&lt;"))
                at = shut.end()
        elif name in _CLOSED:
            shut = _CLOSED[name].search(page, at)
            at = shut.end() if shut else len(page)
            text.append(" ")
        elif name == "head" and head is None:
            head = len(text)
        elif name == "html" and lang is None:
            lang = _attributes(page[m.end() : end]).get("lang") or None
        elif name in _LINKS:
            found = _attributes(page[m.end() : end])
            url = found.get("href", found.get("src"))
            if url is not None:
                links.append({"path": name, "url": url})
        if name in _BLOCKS:
            text.append("\n")
    text.append(page[at:])
    lines = (" ".join(line.split()) for line in _unescaped("".join(text)).split("\n"))
    return "\n".join(line for line in lines if line), {"Title": title, "Language": lang, "Links": links}


def plain_text(page: str) -> str:
    """The page's text, a line for each block that has any, blanks put together."""
    return _scanned(page)[0]


def described(page: str) -> dict:
    """Title, language and links in page order."""
    return _scanned(page)[1]


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Response records (RECORD) from page_id, url, html; the block is an HTTP message."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, column="html"):
            out: list[list] = [[] for _ in range(5)]
            for page_id, url, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload = page.encode()
                block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
                payload_digest = digest(payload)
                own = f"<urn:uuid:{uuid.uuid5(NAMES, f'{page_id} {url} {payload_digest}')}>"
                headers = {"WARC-Date": date, "Content-Type": "application/http; msgtype=response", "WARC-Block-Digest": digest(block), "WARC-Payload-Digest": payload_digest}
                for c, v in zip(out, (page_id, own, url, list(headers.items()), block), strict=True):
                    c.append(v)
            yield _batch([out[0], ["response"] * len(out[0]), out[1], [None] * len(out[0]), out[2], out[3], out[4]])

    return pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).mapInArrow(run, RECORD)


def _batch(columns: list[list]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary()]
    names = [f.split(" ")[0] for f in RECORD.replace("map<string,string>", "map").split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def http_payload(block: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and body of an HTTP message."""
    head, _, body = block.partition(b"\r\n\r\n")
    lines = [x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:]]
    return {k.strip(): v.strip() for k, _, v in lines}, body


def _unchunked(body: bytes) -> bytes:
    """The data of a chunked transfer; a body that isn't one stays, a cut one gives what it has."""
    out, at = [], 0
    while (end := body.find(b"\r\n", at, at + 1024)) >= 0:
        size = body[at:end].split(b";")[0].strip()
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,8}", size):
            break
        if int(size, 16) == 0:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + int(size, 16)])
        at = end + 4 + int(size, 16)
    return b"".join(out) if out else body


def _inflate(body: bytes, wbits: int, limit: int) -> bytes | None:
    """What a compressed body gives before its end or its first fault; None beyond the limit."""
    out, size, reader = [], 0, zlib.decompressobj(wbits)
    for at in range(0, len(body), PIECE):
        left = body[at : at + PIECE]
        while left and not reader.eof:
            try:
                out.append(reader.decompress(left, PIECE))
            except zlib.error:
                return b"".join(out)
            left, size = reader.unconsumed_tail, size + len(out[-1])
            if size > limit:
                return None
    return b"".join(out)


def decoded_body(http: dict[str, str], body: bytes, limit: int = MAX_BODY) -> str | None:
    """A body's text by its transfer encoding, content encoding and charset; None where it can't be read.

    Read are chunked transfers, gzip, deflate, and the charsets of _CHARSET, named by a byte order mark, by Content-Type or by a
    meta tag among the first 1024 bytes, where the standard for HTML wants it; otherwise UTF-8.  Bytes that are no characters
    become U+FFFD.  A fault in compressed data ends the text there.
    """
    named = {k.lower(): v.lower() for k, v in http.items()}
    if "chunked" in named.get("transfer-encoding", ""):
        body = _unchunked(body)
    for coding in reversed([x.strip() for x in named.get("content-encoding", "").split(",")]):
        if coding in ("gzip", "x-gzip"):
            packed = body[:2] == GZIP[:2]
            inflated = _inflate(body, 31, limit) if packed else body
        elif coding == "deflate":
            inflated = _inflate(body, 15 if body[:1] == b"\x78" else -15, limit)
        else:
            inflated = body if coding in ("", "identity") else None
        if inflated is None:
            return None
        body = inflated
    for mark, charset in ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be")):
        if body.startswith(mark):
            return body[len(mark) :].decode(charset, "replace")
    found = re.search(r"charset\s*=\s*[\"']?([\w:.-]+)", named.get("content-type", "")) or re.search(r"<meta\b[^>]{0,1000}?charset\s*=\s*[\"']?([\w:.-]+)", body[:1024].decode("latin-1").lower())
    charset = found[1] if found and _CHARSET.fullmatch(found[1]) else "utf-8"
    try:
        return body.decode("cp1252" if charset in ("iso-8859-1", "latin1", "us-ascii", "ascii") else charset, "replace")
    except (LookupError, UnicodeError):
        return body.decode("utf-8", "replace")


def derivatives(records: DataFrame) -> DataFrame:
    """A metadata and a conversion record (RECORD) for each response record; other records give none."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, column="block"):
            out: list[list] = [[] for _ in range(7)]
            for page_id, source, uri, headers, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                headers = dict(headers)
                http, body = http_payload(block)
                page = decoded_body(http, body)
                text, description = _scanned(page or "")
                date = {"WARC-Date": headers["WARC-Date"]} if "WARC-Date" in headers else {}
                envelope = {
                    "WARC-Header-Metadata": {"WARC-Type": "response", "WARC-Record-ID": source, "WARC-Target-URI": uri, **headers},
                    "HTTP-Response-Metadata": {"Headers": http, "Entity-Length": len(body), "Entity-Digest": digest(body)},
                    "HTML-Metadata": description,
                }
                if page is None:
                    envelope["HTTP-Response-Metadata"]["Unread-Encoding"] = True
                made = (
                    ("metadata", "application/json", json.dumps({"Envelope": envelope}, ensure_ascii=False, separators=(",", ":")).encode()),
                    ("conversion", "text/plain; charset=utf-8", text.encode()),
                )
                for kind, content, data in made:
                    own = f"<urn:uuid:{uuid.uuid5(NAMES, f'{kind} {source}')}>"
                    head = [*date.items(), ("Content-Type", content), ("WARC-Block-Digest", digest(data)), ("WARC-Source-Payload-Digest", headers.get("WARC-Payload-Digest") or digest(body))]
                    for c, v in zip(out, (page_id, kind, own, source, uri, head, data), strict=True):
                        c.append(v)
            yield _batch(out)

    found = records.where("warc_type = 'response'").select("page_id", "record_id", "target_uri", "headers", F.coalesce("block", F.lit(b"")).alias("block"))
    return found.mapInArrow(run, RECORD)


def serialise(records: DataFrame) -> DataFrame:
    """page_id, warc_type, member (binary): each record as one gzip member."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, column="block"):
            members = []
            for kind, own, refers, uri, headers, block in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                head = [("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Refers-To", refers), ("WARC-Target-URI", uri), *headers, ("Content-Length", str(len(block)))]
                lines = "".join(f"{k}: {_LINE_ENDS.sub(' ', v)}\r\n" for k, v in head if v is not None)
                members.append(gzip.compress(f"WARC/1.0\r\n{lines}\r\n".encode() + block + b"\r\n\r\n", 6, mtime=0))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(members, pa.binary())], names=["page_id", "warc_type", "member"])

    wanted = records.select("page_id", "warc_type", "record_id", "refers_to", "target_uri", "headers", "block")
    return wanted.mapInArrow(run, "page_id long, warc_type string, member binary")


def _inflated(data: bytes) -> Iterator[bytes | None]:
    """A file's bytes in pieces, gzip or plain; None where a broken member ends, after which the next one is looked for."""
    if data[:2] != GZIP[:2]:
        yield from (data[at : at + PIECE] for at in range(0, len(data), PIECE))
        return
    start = 0
    while start >= 0:
        reader, at, left = zlib.decompressobj(31), start, b""
        try:
            while not reader.eof and (left or at < len(data)):
                if not left:
                    left, at = data[at : at + PIECE], at + PIECE
                yield reader.decompress(left, PIECE)
                left = reader.unconsumed_tail
            if not reader.eof:
                yield None
                return
            start = data.find(GZIP, min(at, len(data)) - len(reader.unused_data))
        except zlib.error:
            yield None
            start = data.find(GZIP, start + 1)


def _record_head(lines: bytes) -> dict[str, str]:
    """A record's headers; the names that are used here in their own spelling, a repeated one with its values joined by commas."""
    try:
        text = lines.decode()
    except UnicodeDecodeError:
        text = lines.decode("latin-1")
    head: dict[str, str] = {}
    for line in re.sub(r"\r?\n[ \t]+", " ", text).replace("\r\n", "\n").split("\n"):
        name, colon, value = line.partition(":")
        if colon:
            name = _KNOWN.get(name.strip().lower(), name.strip())
            head[name] = f"{head[name]}, {value.strip()}" if name in head else value.strip()
    return head


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record in a file's bytes, gzip or plain.

    The file is inflated piece by piece; no more than one record is held beside its bytes.  A record that is cut, lies in a
    broken member, has no length or a header beyond MAX_HEAD is left out, and reading goes on at the next line ``WARC/``.
    """
    buffer, head, size, looked = bytearray(), None, 0, 0
    for piece in _inflated(data):
        if piece is None:
            buffer, head, looked = bytearray(), None, 0
            continue
        buffer += piece
        while True:
            if head is not None:
                if len(buffer) < size:
                    break
                yield head, bytes(buffer[:size])
                del buffer[:size]
                head, looked = None, 0
            first = _VERSION.search(buffer) if not looked else None
            if first is None and not looked:
                line = buffer.rfind(b"\n") + 1
                if len(buffer) - line > 64:  # a long line that began as none of a record
                    buffer[:] = b"-"
                else:
                    del buffer[:line]
                break
            if first is not None:
                del buffer[: first.start()]
                looked = first.end() - first.start()
            end = _BLANK.search(buffer, max(looked - 3, 0))
            if end is None and len(buffer) <= MAX_HEAD:
                looked = len(buffer)
                break
            later = buffer.rfind(b"\nWARC/", 0, end.start() if end else len(buffer)) + 1
            if later:  # what began before has no end
                del buffer[:later]
                looked = 0
                continue
            version = buffer.find(b"\n") + 1
            found = _record_head(bytes(buffer[version : end.start()])) if end else {}
            length = found.get("Content-Length", "")
            if length.isascii() and length.isdigit() and len(length) < 16:
                head, size = found, int(length)
                del buffer[: end.end()]
            else:
                del buffer[:version]
                looked = 0


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """RECORD rows of all files at the path (page_id null)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ("WARC-Type", "WARC-Record-ID", "WARC-Refers-To", "WARC-Target-URI", "Content-Length")
        for batch in batches:
            for content in batch.column(0):
                for head, block in parse_records(content.as_py()):
                    rest = [(k, v) for k, v in head.items() if k not in own]
                    yield _batch([[None], *([head.get(k)] for k in own[:4]), [rest], [block]])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD)


def op8_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = derivatives(responses(table(spark, sf_dir, "pages")))
    header = F.col("headers")
    return made.select(
        "page_id", "warc_type", "record_id", "refers_to", "target_uri", header["Content-Type"].alias("content_type"), F.octet_length("block").cast("long").alias("content_length"),
        header["WARC-Block-Digest"].alias("block_digest"), header["WARC-Source-Payload-Digest"].alias("source_payload_digest"), F.sha2("block", 256).alias("block_sha256"),
    )
