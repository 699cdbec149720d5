"""op8: links between records, digests, text, files."""

import base64
import collections
import gzip
import hashlib
import html.parser
import json
import random
import time
import zlib

import pytest

from trawlmill.llm import op8_warc as op8

PAGE = """<!DOCTYPE html><html lang="fr"><head><title>A &amp; B</title><style>p{}</style><script>var t="</p><a href='/no'>";</script></head>
<body><nav><ul><li><a href="/x">One</a></li></ul></nav><!-- <a href="/hidden">h</a> --><p>First&nbsp; <b>bold</b> text<br>next 1 < 2<p>last &eacute;<img src=i.png></body></html>"""
PAGES = [(1, "http://a.example/", PAGE), (2, None, None), (3, "http://b.example/", ""), (None, "u", "<p>open <script>never closed"), (1, "http://a.example/", PAGE), (4, "http://c.example/", "<p>" + "long text " * 50000)]


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(i, u, h, "x", "y") for i, u, h in rows], "page_id long, url string, html string, headers string, block string")


def sha1(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_text_and_description():
    assert op8.plain_text(PAGE) == "One\nFirst bold text\nnext 1 < 2\nlast é"
    found = op8.described(PAGE)
    assert (found["Title"], found["Language"]) == ("A & B", "fr")
    assert [x["url"] for x in found["Links"]] == ["/x", "i.png"]
    assert op8.plain_text("<p>open <script>never closed") == "open" and op8.plain_text("") == ""


def test_records_refer_to_their_source(spark):
    source = op8.responses(pages(spark))
    made = op8.derivatives(source).collect()
    by_id = {r.record_id: r for r in source.collect()}
    assert len(made) == 2 * len(PAGES)
    assert collections.Counter(r.warc_type for r in made) == {"metadata": len(PAGES), "conversion": len(PAGES)}
    html = {(i, u): h or "" for i, u, h in PAGES}
    for r in made:
        origin = by_id[r.refers_to]
        page = html[r.page_id, r.target_uri]
        assert r.target_uri == origin.target_uri and r.headers["WARC-Date"] == origin.headers["WARC-Date"]
        assert r.headers["WARC-Block-Digest"] == sha1(bytes(r.block))
        assert r.headers["WARC-Source-Payload-Digest"] == sha1(page.encode()) == origin.headers["WARC-Payload-Digest"]
        if r.warc_type == "conversion":
            assert bytes(r.block).decode() == op8.plain_text(page)
        else:
            envelope = json.loads(bytes(r.block))["Envelope"]
            assert envelope["WARC-Header-Metadata"]["WARC-Record-ID"] == r.refers_to
            assert envelope["WARC-Header-Metadata"]["WARC-Block-Digest"] == origin.headers["WARC-Block-Digest"]
            assert envelope["HTTP-Response-Metadata"]["Headers"]["Content-Length"] == str(len(page.encode()))
            assert envelope["HTML-Metadata"] == op8.described(page)
    assert op8.derivatives(op8.responses(pages(spark, []))).collect() == []


def test_files_read_back(spark, tmp_path):
    records = op8.responses(pages(spark)).unionByName(op8.derivatives(op8.responses(pages(spark))))
    members = [bytes(r.member) for r in op8.serialise(records).collect()]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(members[:9]))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(members[9:]))
    back = op8.read_records(spark, str(tmp_path))
    key = lambda r: (r.warc_type, r.record_id, r.refers_to, r.target_uri, tuple(sorted(r.headers.items())), bytes(r.block))
    assert collections.Counter(map(key, back.collect())) == collections.Counter(map(key, records.collect()))
    again = op8.derivatives(back)
    assert {r.record_id for r in again.collect()} == {r.record_id for r in records.collect() if r.warc_type != "response"}


class Plain(html.parser.HTMLParser):
    """A page's text and links by the standard library's parser."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.out, self.links, self.hidden, self.title, self.in_title = [], [], 0, None, False
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        named = dict(reversed(attrs))
        if tag in ("head", "script", "style"):
            self.hidden += 1
        if tag in ("a", "img", "link") and ("href" in named or "src" in named):
            self.links.append({"path": tag, "url": named.get("href", named.get("src")) or ""})
        self.in_title = tag == "title"
        self.out += ["\n"] * (tag in op8._BLOCKS)

    def handle_comment(self, data):
        self.out.append(" ")  # what is left out parts words

    def handle_endtag(self, tag):
        self.out += [" "] * (tag in ("script", "style"))
        self.hidden -= tag in ("head", "script", "style")
        self.in_title = False
        self.out += ["\n"] * (tag in op8._BLOCKS)

    def handle_data(self, data):
        if self.in_title and self.title is None:
            self.title = data.strip()
        if not self.hidden:
            self.out.append(data)

    def text(self):
        lines = (" ".join(x.split()) for x in "".join(self.out).split("\n"))
        return "\n".join(x for x in lines if x)


def test_scanner_against_the_standard_parser():
    draw = random.Random(3)
    parts = ["<p>", "</p>", "word ", "more words, ", "<b>", "</b>", "&amp;", "&eacute;", "&#65;", "<br/>", "<a href='/x?a=1&amp;b=2'>", "</a>", '<a title="1 > 0" href=y>', "<img alt='a' src=\"i.png\">", "<!-- <p>no</p> -->",
             "<script>if (a<b) document.write('<p>x</p>')</script>", "<style>p{}</style>", "<div class=c>", "</div>", "\n", "é中", "<LI>", "<A HREF=Z>", "<img src>"]
    for _ in range(300):
        body = "".join(draw.choices(parts, k=draw.randint(0, 40)))
        page = f"<!DOCTYPE html><html lang=en><head><title>T &lt; {draw.random()}</title><link href=s.css><script>1</script></head><body>{body}</body></html>"
        plain, found = Plain(page), op8.described(page)
        assert op8.plain_text(page) == plain.text(), page
        assert (found["Title"], found["Language"], found["Links"]) == (plain.title, "en", plain.links), page


@pytest.mark.parametrize("piece", ["<a ", "<title>", "<head>", "<!--", "<script>", "<script ", "<a b='>' ", '<a b="', "<a \"'", "<!x", "</title ", '<a b=">', "&#99999999", "<a b=" + " " * 90 + "'"])
def test_hostile_markup_takes_linear_time(piece):
    for tail in ("", ">", "'>", '">'):
        began = time.process_time()
        op8.plain_text(piece * (1_000_000 // len(piece)) + tail)
        assert time.process_time() - began < 4


def test_markup_that_never_ends():
    assert op8.plain_text("a <b c") == "a <b c" and op8.plain_text("<") == "<" and op8.plain_text("1 < 2 <!-- open") == "1 < 2"
    assert op8.plain_text("<head>kept <p>too") == "kept\ntoo" and op8.described("<title>open")["Title"] is None
    assert op8.plain_text("<a b='>' c") == "' c" and op8.described("<a href='x>y'>")["Links"] == [{"path": "a", "url": "x>y"}]
    assert op8.plain_text("&#" + "0" * 5000 + "65; &#" + "9" * 5000 + ";") == "A \ufffd"


def test_bodies_by_encoding():
    page = "<p>żółw</p>"
    raw = zlib.compressobj(wbits=-15)
    for http, body in [
        ({"Content-Encoding": "gzip"}, gzip.compress(page.encode())),
        ({"content-encoding": "deflate"}, zlib.compress(page.encode())),
        ({"Content-Encoding": "deflate"}, raw.compress(page.encode()) + raw.flush()),
        ({"Content-Encoding": "gzip"}, page.encode()),
        ({"Transfer-Encoding": "chunked"}, b"3\r\n<p>\r\n" + f"{len('żółw'.encode()):x}".encode() + b";x=1\r\n" + "żółw".encode() + b"\r\n4\r\n</p>\r\n0\r\n\r\n"),
        ({"Transfer-Encoding": "chunked"}, page.encode()),
        ({"Content-Type": "text/html; charset=ISO-8859-2"}, page.encode("iso-8859-2")),
        ({"Content-Type": "text/html; charset=no-such"}, page.encode()),
        ({}, b"\xff\xfe" + page.encode("utf-16-le")),
        ({}, b"\xef\xbb\xbf" + page.encode()),
    ]:
        assert op8.decoded_body(http, body) == page, (http, body)
    assert op8.plain_text(op8.decoded_body({}, b"<meta charset=windows-1250>" + page.encode("cp1250"))) == "żółw"
    assert op8.decoded_body({"Content-Type": "text/html; charset=latin1"}, b"\x93caf\xe9\x94") == "“café”"
    assert op8.decoded_body({"Content-Encoding": "br"}, b"?") is None
    assert op8.decoded_body({"Content-Encoding": "gzip"}, gzip.compress(b"a" * 5_000_000), limit=4_000_000) is None
    assert op8.decoded_body({"Content-Encoding": "gzip"}, gzip.compress(random.Random(1).randbytes(9000).hex().encode())[:-4000]).startswith(random.Random(1).randbytes(9000).hex()[:2000])


def record(i, block, name="Content-Length", size=None):
    return f"WARC/1.0\r\nwarc-type: response\r\nWARC-Record-ID: <{i}>\r\n{name}: {len(block) if size is None else size}\r\n\r\n".encode() + block + b"\r\n\r\n"


def ids(data):
    return [h["WARC-Record-ID"] for h, _ in op8.parse_records(data)]


def test_broken_files():
    a, b, c = (record(i, block) for i, block in enumerate((b"one\r\n\r\nWARC/1.0\r\n", b"", b"three" * 600_000)))
    packed = [gzip.compress(x) for x in (a, b, c)]
    assert ids(a + b + c) == ids(b"".join(packed)) == ids(gzip.compress(a + b + c)) == ["<0>", "<1>", "<2>"]
    assert [x for _, x in op8.parse_records(a + c)] == [b"one\r\n\r\nWARC/1.0\r\n", b"three" * 600_000]
    assert ids(a + c[:-10]) == ids(packed[0] + packed[2][:-20]) == ["<0>"]
    assert ids(packed[0][:20] + packed[1]) == ["<1>"] and ids(packed[0] + b"\x1f\x8b\x08noise" * 9 + packed[1]) == ["<0>", "<1>"]
    assert ids(packed[0] + b"\0" * 50 + packed[1]) == ["<0>", "<1>"]
    assert ids(a + record(7, b"x", size="many") + b) == ids(a + record(7, b"x", size="-1") + b) == ids(a + record(7, b"x", name="No-Length") + b) == ["<0>", "<1>"]
    assert ids(record(1, b"x", name="content-length")) == ["<1>"] and list(op8.parse_records(record(1, b"xyz", name="CONTENT-LENGTH")))[0][1] == b"xyz"
    head = next(op8.parse_records(b"WARC/1.0\r\nX: caf\xe9\r\nY: a\r\n b\r\nY: c\r\nContent-Length: 0\r\n\r\n\r\n\r\n"))[0]
    assert head == {"X": "café", "Y": "a b, c", "Content-Length": "0"}
    assert ids(b"") == ids(b"\x1f\x8b\x08") == ids(b"noise") == ids(b"\n" * 3_000_000) == ids(b"-" * 3_000_000) == []
    began = time.process_time()
    assert ids(b"WARC/1.0\r\n" * 300_000 + b) == ["<1>"]
    assert time.process_time() - began < 20


def test_addresses_with_line_ends_stay_in_their_header(spark, tmp_path):
    records = op8.responses(pages(spark, [(1, "http://a/\r\nContent-Length: 1\r\n\r\n", "<p>x")]))
    (tmp_path / "a.warc.gz").write_bytes(bytes(op8.serialise(records).head().member))
    [back] = op8.read_records(spark, str(tmp_path)).collect()
    assert bytes(back.block) == bytes(records.head().block) and back.target_uri == "http://a/ Content-Length: 1"
