import gzip
import hashlib
import io
import random
import time
from html.parser import HTMLParser

import pytest

from tidelog.llm import warc

SCHEMA = "page_id bigint, url string, html string, type string, headers string, block string"
HTML = '<!DOCTYPE html><html lang="fr"><head><title>A &amp; B</title><script>var t="</p>";</script><style>p{}</style></head><body><!-- no --><p>One <b>two</b>&nbsp;three<br>four</p><p title="a>b">five &lt;six&gt;</p><a href="/x?a=1&amp;b=2">link</a> <a href=\'http://o.example/\'>o</a><a href=bad:/>z</a></body></html>'
PAGES = [(1, "http://e.example/d/", HTML), (2, None, "<p>no url <a href='/rel'>r</a>"), (3, "http://e.example/", None), (4, "http://e.example/", ""), (None, "http://e.example/n", "text only"), (5, "http://e.example/l", "<p>" + "long text " * 30_000), (1, "http://e.example/d/", HTML), (6, "http://bad\r\nurl", "<script>never closed"), (7, "http://[bad", "<a href='/y'>y</a>")]


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "t", None, "b") for r in rows], SCHEMA)


def test_text_title_language_and_links():
    text, title, language, links = warc.extract(HTML)
    assert text == "One two three\nfour\nfive <six>\nlink oz"
    assert (title, language, links) == ("A & B", "fr", ["/x?a=1&b=2", "http://o.example/", "bad:/"])
    assert warc.extract("<!-- open <p>x") == ("", "", "", []) and warc.extract("a < b and c > d")[0] == "a < b and c > d"
    assert warc.extract("<p" * 20_000)[0] is not None  # in linear time


def test_quoted_values_of_any_length():
    for n in (10, 5_000, 300_000):
        for q in "\"'":
            text, _, _, links = warc.extract(f"<p>a <a data-x={q}{'x' * n}<b>secret{q} href=/l>go</a> b</p>")
            assert (text, links) == ("a go b", ["/l"])
    assert warc.extract("<p class=it's>one</p> <i>don't</i>")[0] == "one\ndon't"
    assert warc.extract('<a href="/m>open</a> <b>two</b>')[0] == "open two"  # never closed
    assert warc.extract("<i a='1'>x</i>" * 50_000 + "<a b='" + "<i>y</i>" * 50_000)[0].startswith("xxx")  # in linear time


def test_records_round_trip():
    headers, block = {"WARC-Type": "x", "WARC-Record-ID": "<a>", "Note": "two\r\n lines"}, b"\r\n\r\nbody\x00"
    raw = warc.encoded(headers, block) * 3
    got = list(warc.decoded(io.BytesIO(raw)))
    assert len(got) == 3 and got[0][1] == block and got[0][0]["Note"] == "two lines"
    with pytest.raises(ValueError, match="ends inside"):
        list(warc.decoded(io.BytesIO(raw[:-8])))
    with pytest.raises(ValueError, match="no WARC"):
        list(warc.decoded(io.BytesIO(b"hello\r\n")))


def test_files_round_trip_and_derivatives(spark, tmp_path):
    made = warc.responses(pages(spark))
    manifest = warc.write_warc(made, f"file://{tmp_path}/in")
    back = warc.read_warc(manifest)
    plain = lambda df: sorted((r["record_id"], r["type"], bytes(r["block"])) for r in df.collect())
    assert plain(back) == plain(made) and back.count() == len(PAGES)
    derived = warc.derive(back)
    again = warc.read_warc(warc.write_warc(derived, str(tmp_path / "out"))).collect()
    assert len(again) == 2 * len(PAGES) and sorted(r["record_id"] for r in again) == sorted(r["record_id"] for r in derived.collect())
    sources = {r["record_id"]: r for r in made.collect()}
    for r in again:
        h, source = r["headers"], sources[r["headers"]["WARC-Refers-To"]]
        assert h["WARC-Block-Digest"] == warc.digest(bytes(r["block"])) and h["WARC-Date"] == warc.DATE
        assert h["WARC-Source-Payload-Digest"] == source["headers"]["WARC-Payload-Digest"]
        assert h.get("Page-Id") == source["headers"].get("Page-Id") and ("WARC-Target-URI" in h) == ("WARC-Target-URI" in source["headers"])
        body = bytes(source["block"]).split(b"\r\n\r\n", 1)[1]
        if r["type"] == "conversion":
            assert bytes(r["block"]).decode() == warc.extract(body.decode())[0]
        else:
            about = bytes(r["block"]).decode()
            assert f"source-payload-digest: {source['headers']['WARC-Payload-Digest']}\r\n" in about and "http-status: HTTP/1.1 200 OK" in about
            if h.get("Page-Id") == "1":
                assert "outlink: http://e.example/x?a=1&b=2 L a/@href" in about and "title: A & B" in about and "language: fr" in about
    straight = warc.derive_files(warc.write_responses(pages(spark), str(tmp_path / "in2")), str(tmp_path / "out2"))
    assert plain(warc.read_warc(straight)) == plain(derived)
    with gzip.open(next((tmp_path / "in").glob("*.gz"))) as f:
        assert f.readline() == b"WARC/1.1\r\n"
    assert warc.digest(b"x") != warc.digest(b"y") and hashlib.sha1(b"").digest_size == 20


def test_links_resolve_as_urljoin_does():
    from urllib.parse import urljoin

    links = ["/a", "/", "//h.example/x", "b?c", "../d", "/e/../f", "#g", "http://i.example/j", "mailto:k", "", "/l?m=/n"]
    for base in ("http://e.example/d/p", "https://e.example:80"):
        assert warc.resolved(base, links) == [j for j in (urljoin(base, x) for x in links) if "://" in j]
    assert warc.resolved(None, links) == ["http://i.example/j"] == warc.resolved("http://[bad", links)


def test_members_of_any_size():
    records = [warc.encoded({"WARC-Type": "x", "WARC-Record-ID": f"<{i}>"}, bytes(i * 1000)) for i in range(30)]
    apart, whole = b"".join(map(gzip.compress, records)), gzip.compress(b"".join(records))
    for data in (apart, whole, gzip.compress(b"".join(records[:20])) + gzip.compress(b"".join(records[20:]))):
        assert [len(b) for _, b in warc.records_of(lambda data=data: io.BytesIO(data))] == [i * 1000 for i in range(30)]
    assert len(list(warc.members(io.BytesIO(apart)))) == 30 and list(warc.members(io.BytesIO(b""))) == []
    with pytest.raises(OverflowError):
        list(warc.members(io.BytesIO(whole), 1000))
    with pytest.raises(ValueError, match="ends inside"):
        list(warc.members(io.BytesIO(whole[:-9])))


def test_nothing(spark, tmp_path):
    assert warc.derive(warc.read_warc(warc.write_warc(warc.responses(pages(spark, [])), str(tmp_path)))).count() == 0


#: Pages that never end what they begin; n letters each.
HOSTILE = {
    "name": lambda n: "<" + "a" * n, "tags": lambda n: "<a " * (n // 3), "tags, one end": lambda n: "<a " * (n // 3) + ">", "script": lambda n: "<script " * (n // 8), "scripts": lambda n: "<script>" * (n // 8) + "</script " * (n // 9), "declarations": lambda n: "<!" * (n // 2),
    "comments": lambda n: "<!-- -" * (n // 6), "links": lambda n: "<a " + "href = " * (n // 7) + ">", "quotes": lambda n: '<a x="' * (n // 6), "ends in quotes": lambda n: "<a x='>' " * (n // 9), "ends in either quotes": lambda n: "<a x='>' <b y=\">\" " * (n // 18), "equals": lambda n: "<a " + "=" * n + ">", "blanks": lambda n: "<a x=" + " " * n + "'>",
    "quoted blanks": lambda n: '<a b=">"' + " =" * (n // 2), "references": lambda n: "&#" + "9" * n + ";&#" + "0" * n + "65;", "titles": lambda n: "<title>x</title" * (n // 15), "bare": lambda n: "<a b='>'" + "<c=d" * (n // 4) + "><e" + "=f" * (n // 2),
}


@pytest.mark.parametrize("shape", HOSTILE)
def test_time_grows_as_the_length(shape):
    def least(n):
        page, took = HOSTILE[shape](n), []
        for _ in range(3):
            began = time.process_time()
            warc.extract(page)
            took.append(time.process_time() - began)
        return min(took)

    small, large = least(250_000), least(1_000_000)
    assert large < 12 * max(small, 0.01), (small, large)  # 4 times in proportion, 16 times as a square


def test_loose_tags_end_alike_however_they_are_found():
    """The scanner that remembers where no end was against one that looks anew for each tag."""
    rng = random.Random(1)
    bits = ["<a", "<p", "<", ">", '="', '"', "'", "='", '">"', "'>'", "=", " ", "x", "b=c", "</a"]
    for _ in range(3000):
        page = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 40)))
        end = page.rfind(">") + 1
        ends = warc._Ends(page, end)
        for m in warc._NEXT.finditer(page, 0, end):
            if m["name"]:
                assert ends.after(m.end()) == warc._Ends(page, end).after(m.end())
        text, _, _, links = warc.extract(page)
        assert isinstance(text, str) and isinstance(links, list)


class Plain(HTMLParser):
    """Text, title and links by the standard library, for pages without broken markup."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.title, self.links, self.quiet = [], "", [], []

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "noscript", "template", "title"):
            self.quiet.append(tag)
        if tag in warc._LINES:
            self.out.append("\n")
        if tag == "a" and (href := dict(attrs).get("href")):
            self.links.append(href.strip())

    def handle_endtag(self, tag):
        if self.quiet and self.quiet[-1] == tag:
            self.quiet.pop()
        elif tag in warc._LINES:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.quiet:
            self.out.append(data)
        elif self.quiet == ["title"] and not self.title:
            self.title = " ".join(data.split())


def test_pages_against_the_standard_parser(spark):
    read = 0
    for (page,) in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").filter("html is not null").collect():
        plain = Plain()
        plain.feed(page)
        plain.close()
        text, title, _, links = warc.extract(page)
        read += 1
        assert text == "\n".join(filter(None, (" ".join(line.split()) for line in "".join(plain.out).split("\n"))))
        assert (title, links) == (plain.title, plain.links)
    assert read > 50


def test_texts_written_out_by_hand():
    for page, wanted in [
        ("<h1>A</h1><p>b <i>c</i></p>d", "A\nb c\nd"),
        ("a<!-- <p>x</p> -->b<!-- c", "ab"),
        ("a<script>if (x < y) {}</script>b<STYLE>p{}</STYLE>c", "abc"),
        ("a<script>b", "a"),
        ("<ul><li>one<li>two</ul>", "one\ntwo"),
        ("1 < 2 & 3 > 2 <", "1 < 2 & 3 > 2 <"),
        ("x<br/>y&nbsp;z&eacute;&#233;&#xe9;&#99999999999;", "x\ny zééé\ufffd"),
        ("<p title='a > b'>c</p <p>d", "c\nd"),
        ("t <b", "t <b"),
        ("t > u <!-- v", "t > u"),
    ]:
        assert warc.extract(page)[0] == wanted, page
    assert warc.extract("<title>a <b>c</b></title>d<title>e</title>")[:2] == ("d", "a <b>c</b>")
    assert warc.extract("x<title>never &amp; closed > y")[:2] == ("x", "never & closed > y")
