import gzip
import random
import time
import zlib
from html.parser import HTMLParser

import duckdb

from tests.llm.helpers import corpus, empty, words
from tidemark.llm import decontamination, warc
from tidemark.llm.queries import ORACLES, QUERIES

PAGE = """<!DOCTYPE html><html lang="fr"><head><title>A &amp; B</title><style>p{a:b}</style><script>var t="</p>";</script></head>
<body><!-- no > comment --><p title="a > b">One <b>two</b></p><div>3 &lt; 4<br>five</div><a href="/x?a=1&amp;b=2">link</a></body></html>"""


def test_plain_text():
    assert warc.plain_text(PAGE) == "A & B\nOne two\n3 < 4\nfive\nlink"
    assert warc.plain_text("") == "" and warc.plain_text("a < b <unclosed 'quote") == "a < b <unclosed 'quote"
    assert len(warc.plain_text("<" * 20000 + '<a "' * 2000)) > 0


SHAPES = ["<script>", "<!--", "<title>", "<a ", "<html ", "<![CDATA[", "<a \"", "<a '\">", "<a \"'>", "</script ", "<svg\t", "<", "&#9", "<a href=", "<p x=\"<p y='", "a='\" ", "<style><!--<a href='"]


def test_pages_are_read_in_linear_time():
    for shape in SHAPES:
        for page in (shape * (2_000_000 // len(shape)), shape * (1_000_000 // len(shape)) + ">", "<a href='" + shape * (1_000_000 // len(shape)) + "'>"):
            began = time.process_time()
            warc.Page(page)
            assert time.process_time() - began < 4, (shape, len(page))


def test_attributes_and_entities():
    page = warc.Page("<HTML data-lang=x LANG = 'de-AT'><a title='<a href=no>' HREF=yes>1</a><a>2</a><!-- <a href=hidden> --><a href=\"p &amp;\nq\">3</a>&#" + "9" * 5000 + ";&#0000065;")
    assert (page.language, page.links, page.title) == ("de-AT", ["yes", "p & q"], None)
    assert page.text == "123\ufffdA"


class Reader(HTMLParser):
    """Text by the standard library's parser."""

    def __init__(self):
        super().__init__()
        self.out, self.hidden = [], None

    def handle_starttag(self, tag, attrs):
        if self.hidden is None and tag in warc.HIDDEN:
            self.hidden = tag
        elif self.hidden is None and tag in warc.BLOCKS:
            self.out.append("\n")

    def handle_endtag(self, tag):
        if tag == self.hidden:
            self.hidden = None
        elif self.hidden is None and tag in warc.BLOCKS:
            self.out.append("\n")

    def handle_data(self, data):
        if self.hidden is None:
            self.out.append(data)


def test_text_is_that_of_the_librarys_parser(spark):
    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        reader = Reader()
        reader.feed(r.html or "")
        reader.close()
        lines = (" ".join(x.split()) for x in "".join(reader.out).split("\n"))
        assert warc.plain_text(r.html or "") == "\n".join(x for x in lines if x)


def test_encoded_bodies():
    text = b"<html lang=en><title>T</title><p>hello</p></html>"
    chunked = b"".join(b"%x\r\n%s\r\n" % (len(part), part) for part in (text[:20], text[20:])) + b"0\r\n\r\n"
    raw = zlib.compressobj(wbits=-15)
    bodies = {
        "Content-Encoding: gzip": gzip.compress(text),
        "Content-Encoding: deflate": zlib.compress(text),
        "content-encoding: Deflate": raw.compress(text) + raw.flush(),
        "Transfer-Encoding: chunked": chunked,
        "Transfer-Encoding: chunked\r\nX: joined already": text,
        "Content-Type: text/html; charset=undefined": text,
        "Content-Encoding: gzip\r\nTransfer-Encoding:\r\n chunked": b"%x\r\n%s\r\n0\r\n\r\n" % (len(z := gzip.compress(text)), z),
    }
    for headers, body in bodies.items():
        block = b"HTTP/1.1 200 OK\r\n" + headers.encode() + b"\r\nSet-Cookie: a\r\nSet-Cookie: b\r\n\r\n" + body
        record = warc.serialized([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x>"), ("WARC-Concurrent-To", "<1>"), ("WARC-Concurrent-To", "<2>"), ("WARC-Payload-Digest", warc.sha1(body))], block)
        meta, conversion = (dict(zip(warc.NAMES, row, strict=True)) for row in warc.derived(record))
        assert conversion["content"] == "T\nhello" and meta["digest_ok"], headers
        assert "http-header-set-cookie: a\r\nhttp-header-set-cookie: b\r\n" in meta["content"] and "title: T\r\nlanguage: en\r\n" in meta["content"]
    for headers, body in {"Content-Encoding: br": text, "Content-Encoding: gzip": b"nonsense"}.items():
        block = b"HTTP/1.1 200 OK\r\n" + headers.encode() + b"\r\n\r\n" + body
        assert [r[0] for r in warc.derived(warc.serialized([("WARC-Type", "response")], block))] == ["invalid"]


def test_derivatives(spark):
    pages = spark.createDataFrame([(1, "http://a/\n b", PAGE, "x"), (2, None, None, "y"), (3, "http://é", "日本" * 9000, "z"), (1, "http://a/\n b", PAGE, "x")], "page_id long, url string, html string, record string")
    responses = warc.responses(pages)
    rows = [r.asDict() for r in warc.derive(responses).collect()]
    assert len(rows) == 8 and len({r["record_id"] for r in rows}) == 8 and len({r["refers_to"] for r in rows}) == 4
    assert sorted(map(tuple, warc.derive_pages(pages).collect())) == sorted(map(tuple, warc.derive(responses).collect()))
    by_id = {warc.parse(bytes(x.record))[0]["warc-record-id"]: x.record for x in responses.collect()}
    assert all(" " not in r["target_uri"] for r in rows)
    for r in rows:
        source = by_id[r["refers_to"]]
        headers, block = warc.parse(bytes(source))
        assert r["refers_to"] == headers["warc-record-id"] and r["target_uri"] == headers["warc-target-uri"] and r["warc_date"] == headers["warc-date"]
        assert r["source_block_digest"] == headers["warc-block-digest"] == warc.sha1(block) and r["digest_ok"]
        other = next(x for x in rows if x["refers_to"] == r["refers_to"] and x["record_type"] != r["record_type"])
        assert r["concurrent_to"] == other["record_id"]
        again, content = warc.parse(warc.record_of(r))
        assert content.decode() == r["content"] and again["warc-refers-to"] == r["refers_to"] and again["warc-block-digest"] == warc.sha1(content)
    meta = next(r for r in rows if r["page_id"] == 1 and r["record_type"] == "metadata")["content"]
    assert "title: A & B\r\n" in meta and "language: fr\r\n" in meta and "outlink: /x?a=1&b=2\r\n" in meta and "http-header-content-type: text/html; charset=utf-8\r\n" in meta
    assert next(r for r in rows if r["page_id"] == 2 and r["record_type"] == "conversion")["content"] == ""
    assert warc.as_records(warc.derive(responses)).count() == 8
    assert warc.derive(warc.responses(pages.limit(0))).count() == 0


def test_bad_records(spark):
    good = warc.response_record("1", "u", "x", warc.DATE)
    broken = good.replace(b"x\r\n\r\n", b"y\r\n\r\n")
    df = spark.createDataFrame([(1, bytearray(b"nonsense")), (2, None), (3, bytearray(good[:-20])), (4, bytearray(broken)), (5, bytearray(good.replace(b"WARC-Type: response", b"WARC-Type: request")))], "page_id long, record binary")
    rows = warc.derive(df).collect()
    assert sorted((r.page_id, r.record_type) for r in rows) == [(1, "invalid"), (2, "invalid"), (3, "invalid"), (4, "conversion"), (4, "metadata"), (5, "invalid")]
    assert not any(r.digest_ok for r in rows)


def shingles(text, width=5):
    import regex

    w = regex.findall(r"[\p{L}\p{N}]+", (text or "").lower())
    return {" ".join(w[i : i + width]) for i in range(len(w) - width + 1)} if width else w


def test_containment_against_all_pairs(spark):
    rnd = random.Random(1)
    items = [words(rnd, n) for n in (4, 5, 6, 14, 40, 200)]
    texts = []
    for w in items:
        for lost in (0, 0.1, 0.19, 0.25):
            part = w[: len(w) - int(lost * len(w))]
            texts.append(", ".join(words(rnd, rnd.randint(0, 3000)) + [x.upper() for x in part] + words(rnd, 50)))
    rows = [(i, " ".join(w), "n") for i, w in enumerate(items)] + [(90, None, "n"), (91, "", "n"), (92, " ".join(items[3]), "n")]
    bench = spark.createDataFrame(rows, "item_id long, text string, s string")
    df = corpus(spark, texts)
    got = sorted(tuple(r) for r in decontamination.contained_items(df, bench).collect())
    want = []
    for d in {r.doc_id: r.text for r in df.collect()}.items():
        for i, text, _ in rows:
            w = min(5, len(shingles(text, 0)))
            s = shingles(text, w) if w else set()
            if s and len(s & shingles(d[1], w)) >= 0.8 * len(s) - 1e-9:
                want.append((d[0], i, len(s & shingles(d[1], w)), len(s), len(s & shingles(d[1], w)) / len(s)))
    assert got == sorted(want) and len(want) > 8 and any(w[1] == 0 for w in want)
    clean = decontamination.without_items(df, bench)
    assert clean.columns == df.columns and {r.doc_id for r in clean.collect()} == {r.doc_id for r in df.collect()} - {w[0] for w in want}
    assert decontamination.contained_items(empty(spark), bench).count() == 0 and decontamination.contained_items(df, bench.limit(0)).count() == 0


def test_contaminated_rows_without_id_go(spark):
    item = "one two three four five six seven eight nine ten"
    rows = [(None, f"x {item} y", 1), (None, "clean text", 2), (None, None, 3), (4, f"a b {item}", 4), (4, "more", 5), (6, "x", 6), (7, "the answer: Forty, TWO", 7), (8, "forty and two", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, other long")
    bench = spark.createDataFrame([(1, item), (None, "forty two"), (3, "...")], "item_id long, text string")
    assert sorted(r.other for r in decontamination.without_items(df, bench).collect()) == [2, 3, 6, 8]
    found = decontamination.contained_items(df, bench).collect()
    assert sorted(((r.doc_id, r.item_id, r.containment) for r in found), key=str) == sorted([(None, 1, 1.0), (4, 1, 1.0), (7, None, 1.0)], key=str)


def test_sql(spark):
    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "conversations"):
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    for name, sql in ORACLES.items():
        got = sorted(map(tuple, (d := QUERIES[name](spark, sf)).select(*sorted(d.columns)).collect()), key=repr)
        rel = c.sql(sql)
        want = sorted(rel.project(", ".join(sorted(rel.columns))).fetchall(), key=repr)
        assert len(got) == len(want) and [tuple(map(str, r)) for r in got] == [tuple(map(str, r)) for r in want], name
