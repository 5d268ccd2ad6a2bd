"""Operators over pages: extraction and archives."""

import base64
import hashlib
import random
import time

import pytest

from basalt.llm import html, warc
from basalt.llm.common import scratch


def test_extract():
    page = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t="</p>";</script></head><body><!-- c --><header>Site</header><nav><ul><li><a href="/x">x</a></ul></nav>
    <div class="ad">buy</div><main><article><header><h1>The &amp; title</h1><p>by me</header><p>One  <b>bo</b>ld<br>line&nbsp;here<p>Two<ul><li>a<li>b</ul><div class="comments"><article>c</article></div><form>f</form><aside>s</aside><p hidden>no</p></article></main>
    <div id="cookie-notice">ok?</div><footer>&copy;</footer></body></html>"""
    assert html.extract(page) == "The & title One bold line here Two a b"
    assert html.extract(None) == html.extract("") == html.extract("<nav>x</nav>") == ""
    assert html.extract("plain &lt;text&gt; < 5") == "plain <text> < 5"
    assert html.extract("<p>a<div>b<p>c</div>d") == "a b c d"
    assert html.extract("<div>" * 3000 + "deep") == "deep"
    assert html.extract("<article><p>unclosed <b>x") == "unclosed x"


def test_extract_deep_and_unclosed():
    assert html.extract("<div>" * 450 + "<nav>menu</nav>deep") == "deep"
    assert html.extract("<article>" + "<section>" * 5000 + "<p>in</p><aside>out</aside>") == "in"
    assert html.extract("a <b") == "a" and html.extract("a < b <") == "a < b <"
    assert html.extract("<p title='it>one</p><p>two</p>") == "one two" == html.extract('<p>one</p><p class="x>two</p>')


@pytest.mark.parametrize("unit, n", [("<a ", 300000), ('<a "', 200001), ('<a ">" ', 100000), ("<b>", 200000), ("<b><p></p>", 80000), ("<p><table>", 80000), ("<li>", 200000), ("<!", 400000), ("</x>", 200000), ("<script>", 100000)])
def test_extract_is_linear(unit, n):
    began = time.time()
    html.extract(unit * n)
    assert time.time() - began < 20  # a rescan for each tag takes hours


def test_site_templates(spark):
    rng = random.Random(5)
    make = lambda n: " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(1000)}" for _ in range(n))
    texts = [make(60) for _ in range(30)]
    long = make(60)
    # Outside an article, under one title; in an article: a short notice, a long shared passage and a shared heading.
    rows = [(i, f"http://h.example/{i}", f"<title>same</title><body><div><span>Our site</span> since 1999</div><p>{texts[i]}</p><p>shared by all</p></body>") for i in range(30)]
    rows += [(100 + i, "http://other.example/", f"<article><h1>Same</h1><p>{texts[i]}</p><p>{long}</p><p>Please subscribe now.</p><p>{texts[i][::-1]}</p></article>") for i in range(30)]
    # Copies, and near copies of one text: what they share is content.
    rows += [(200 + i, "http://copy.example/", "<body><p>one text, copied</p></body>") for i in range(30)]
    base = make(400).split()
    near = []
    for i in range(40):
        w = list(base)
        w[rng.randrange(400)] = f"x{i}"
        near.append(" ".join(w))
    rows += [(400 + i, "http://near.example/", f"<article><p>short lead</p><p>{t}</p></article>") for i, t in enumerate(near)]
    rows += [(500 + i, "http://few.example/", f"<body><p>{texts[i]}</p><p>shared by nine</p></body>") for i in range(9)]
    rows += [(None, None, None), (300, None, "<p>x</p>"), (300, None, "<p>x</p>"), (301, None, "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS key", "2 AS templates", "3 AS host")
    for limit in (html.SMALL, 0):  # templates broadcast, and joined
        out = html.main_text(pages, limit).collect()
        got = {(r.page_id, r.url): (r.text, r.n_chars) for r in out}
        assert len(out) == len(rows)
        assert all(got[i, f"http://h.example/{i}"][0] == texts[i] for i in range(30))
        assert all(got[100 + i, "http://other.example/"][0] == f"Same {texts[i]} {long} {texts[i][::-1]}" for i in range(30))
        assert all(got[200 + i, "http://copy.example/"][0] == "one text, copied" for i in range(30))
        assert all(got[400 + i, "http://near.example/"][0] == f"short lead {t}" for i, t in enumerate(near))
        assert all(got[500 + i, "http://few.example/"][0] == f"{texts[i]} shared by nine" for i in range(9))
        assert got[None, None] == ("", 0) == got[301, None] and got[300, None] == ("x", 1)
    assert html.main_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_templates_against_brute_force(spark, monkeypatch):
    """Subtrees, contents and names counted plainly, on the given pages."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").filter("page_id < 2000")
    seen, hosts = {}, {}
    for r in pages.collect():
        page = html.Page(r.html)
        text = page.text(page.parts())
        hosts.setdefault(html.host_of(r.url), set()).add(text)
        for part in page.parts():
            for digest in page.subtrees(part).values():
                contents, names = seen.setdefault((html.host_of(r.url), digest), (set(), set()))
                contents.add(text)
                names.add(html.name_of(text))
    for least in (html.MIN_SHARE, 0.0):
        monkeypatch.setattr(html, "MIN_SHARE", least)
        want = {k for k, (contents, names) in seen.items() if len(names) >= html.MIN_NAMES and len(names) >= html.MIN_VARIETY * len(contents) and (k[1] % 2 == 0 or len(contents) >= least * len(hosts[k[0]]))}
        assert {(r.host, r.subtree) for r in html.site_templates(pages).collect()} == want
    assert want


def test_warc_round_trip(spark, tmp_path):
    rows = [(5, "http://a/\r\nx", "héllo\r\n\r\nworld"), (3, None, "same"), (9, "u", "same"), (4, "u", None), (6, "u", ""), (None, "u", "same"), (None, "v", "alone"), (3, "again", "same"), (7, "u", "long " * 50000), (8, "data:" + "x" * 120000, "alone too")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS first_id", "2 AS n")
    index = warc.write_archives(pages, scratch(spark, "warc"))
    got = sorted((tuple(r) for r in warc.read_records(index).collect()), key=str)
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = []
    for i, _, h in rows:
        raw, low = (h or "").encode(), first.get(h or "")
        again = low is not None and i != low
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", low if again else None))
    assert got == sorted(want, key=str)
    some = warc.read_records(index.filter("page_id IN (5, 7)")).collect()
    assert sorted(r.page_id for r in some) == [5, 7]
    assert warc.read_records(warc.write_archives(pages.limit(0), scratch(spark, "warc"))).collect() == []
    assert warc.records(pages, least=5).filter("record_type = 'revisit'").count() == 0


def test_archives_are_read_by_several_tasks(spark):
    pages = spark.range(200).selectExpr("id AS page_id", "'http://a/' AS url", "repeat(uuid(), 500) AS html")
    index = warc.write_archives(pages, scratch(spark, "warc"))
    tasks = warc.read_records(index).selectExpr("spark_partition_id() AS p").distinct().count()
    assert warc.read_records(index).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and tasks >= 1


def test_base32(spark):
    got = spark.createDataFrame([(bytearray(b""),), (bytearray(b"abc"),)], "b binary").select(warc.base32_sha1(__import__("pyspark").sql.functions.col("b"))).collect()
    assert [r[0] for r in got] == [base64.b32encode(hashlib.sha1(x).digest()).decode() for x in (b"", b"abc")]
