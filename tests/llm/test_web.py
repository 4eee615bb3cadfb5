"""WARC round trips and main-text extraction."""

from __future__ import annotations

import base64
import hashlib
import html
import random
import re

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import dom, main_text, warc

PAGES = [(5, "http://a/1", "<p>x</p>"), (2, "http://a/2", "<p>x</p>"), (9, None, None), (4, "http://b\r\nX: y", ""), (None, "u", "<p>x</p>"), (7, "u", "é" * 70_000), (8, "u", "\x1f\x8b\x08 WARC/1.1 bait")]


def _want(least=0):
    lead, out = {}, []
    for i, _, h in sorted(PAGES, key=lambda p: (p[0] is None, p[0])):
        b = (h or "").encode()
        sha = base64.b32encode(hashlib.sha1(b).digest()).decode()
        first = lead.setdefault(sha, i) if len(b) >= least else i
        out.append((i, len(b), sha, "response" if first == i else "revisit", None if first == i else first))
    return sorted(out, key=str)


@pytest.mark.parametrize("split", [64, 1 << 20])
@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, tmp_path, split, least):
    pages = spark.createDataFrame([(*p, "clash", 1) for p in PAGES], "page_id long, url string, html string, sha string, row int").repartition(3)
    got = warc.round_trip(pages, f"file://{tmp_path}/w", least, split)
    assert sorted(map(tuple, got.collect()), key=str) == _want(least)


def test_ranges_are_dealt_to_many_tasks(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", "".join(random.Random(i).choices("abcdefgh <>", k=4000))) for i in range(60)], "page_id long, url string, html string")
    files = warc.write_archives(pages.repartition(1), f"file://{tmp_path}/w")
    got = warc.read_archives(files, split_bytes=5000)
    assert got.select(F.spark_partition_id()).distinct().count() > 4 and got.count() == 60


def test_repeated_ids(spark, tmp_path):
    rows = [(1, "u", "x"), (1, "v", "x"), (1, "w", "y"), (2, "u", "x")]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string"), f"file://{tmp_path}/w").collect()
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in got) == [(1, "response", None), (1, "response", None), (1, "response", None), (2, "revisit", 1)]


def test_a_lost_or_damaged_record_is_an_error(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"page {i}") for i in range(20)], "page_id long, url string, html string").repartition(1)
    files = warc.write_archives(pages, f"file://{tmp_path}/w")
    warc.check_records(files, warc.read_archives(files))
    archive = next((tmp_path / "w/archives").iterdir())
    data = bytearray(archive.read_bytes())
    data[40:50] = bytes(10)
    archive.write_bytes(bytes(data))
    with pytest.raises(ValueError, match="20 records were written"):
        warc.check_records(files, warc.read_archives(files))


def test_no_pages(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(none, f"file://{tmp_path}/w").count() == 0


class _File:
    def __init__(self, data):
        self.data = data

    def read_at(self, n, at):
        return self.data[at : at + n]


def test_each_record_is_owned_once_and_damage_is_passed():
    records = [warc.record(i, "u", bytes([65 + i]) * (i * 997), warc.base32_sha1(bytes([65 + i]) * (i * 997)), None, False) for i in range(12)]
    members = [warc.member(r, level=0 if i % 3 == 0 else 6) for i, r in enumerate(records)]
    bait = warc.member(b"not a record") + warc.MAGIC + b"junk"  # valid gzip that is none, and a false magic
    data = b"".join(members[:5]) + bait + b"".join(members[5:])
    for step in (1, 7, 100, 1000, len(data)):
        got = [r for a in range(0, len(data), step) for r in warc.owned(_File(data), len(data), a, min(a + step, len(data)))]
        assert got == records
    broken = data[:40] + bytes(10) + data[50:]
    assert list(warc.owned(_File(broken), len(broken), 0, len(broken))) == records[1:]


def test_labelled_pages_held_out():
    model, right, total = main_text.trained(), 0, 0
    for seed in range(20_000, 20_150):
        nodes, texts, marks = main_text._labelled(main_text.lesson(seed))
        for x, p, y in zip(nodes, model.marginals(nodes, texts), marks):
            if x.blocks:
                right, total = right + ((p > 0.5) == y), total + 1
    assert right > 0.98 * total


def test_marginals_are_exact():
    """Against the sum over all labellings of a small tree."""
    from itertools import product

    page = '<div class="x"><p>some words here.</p><ul><li><a href="/">link</a></li></ul></div><footer>&copy; end</footer>'
    nodes, blocks = dom.parse(page)
    texts, model = main_text.texts_of(nodes, blocks), main_text.trained()
    odds = [sum(model.weights.get(f, 0) for f in main_text.features(x, t)) for x, t in zip(nodes, texts)]
    total, ones = 0.0, [0.0] * len(nodes)
    for y in product((0, 1), repeat=len(nodes)):
        w = 1.0
        for i, x in enumerate(nodes):
            p = 1 / (1 + 2.718281828459045 ** -odds[i])
            w *= p if y[i] else 1 - p
            if i:
                w *= model.edges[main_text.group(nodes[x.parent])][y[x.parent]][y[i]]
        total += w
        ones = [a + w * b for a, b in zip(ones, y)]
    assert model.marginals(nodes, texts) == pytest.approx([a / total for a in ones], abs=1e-9)


def test_test_pages_give_the_article(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r for r in main_text.main_text(pages).collect()}
    for r in pages.collect():
        article = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]
        blocks = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>|<br>", " ", article))
        want = "\n".join(b for b in (" ".join(html.unescape(x).split()) for x in blocks) if b)
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want)


#: Written by hand: page and main text, in shapes that other sites have.
SHAPES = {
    "comments inside the article": ("<html><body><header><a href='/'>Site</a></header><article><h1>Rivers rise</h1><p>After a week of rain the rivers rose by two metres, officials said.</p><p>Schools stay closed on Monday.</p><section id='comments'><h3>3 comments</h3><div class='comment'><p>I saw it from my window, terrible.</p></div><div class='comment'><p>Stay safe everyone!</p></div></section></article><footer>Copyright 2024 Site</footer></body></html>",
     "Rivers rise\nAfter a week of rain the rivers rose by two metres, officials said.\nSchools stay closed on Monday."),
    "related box inside the article": ("<body><main><article class='post'><h1>On bread</h1><p>Good bread needs four things: flour, water, salt and time.</p><aside class='related'><h4>Related</h4><ul><li><a href='/1'>On butter</a></li><li><a href='/2'>On jam</a></li></ul></aside><p>Leave the dough in a cool place over night, then bake it hot.</p></article></main></body>",
     "On bread\nGood bread needs four things: flour, water, salt and time.\nLeave the dough in a cool place over night, then bake it hot."),
    "text directly in a div": ("<body><div id='nav'><a href='/a'>Home</a> | <a href='/b'>News</a> | <a href='/c'>Contact</a></div><div id='content'>The old mill was built in 1780 and burnt down twice.<br>It was rebuilt by the village each time, stone by stone.</div><div id='footer'>All rights reserved.</div></body>",
     "The old mill was built in 1780 and burnt down twice. It was rebuilt by the village each time, stone by stone."),
    "a table in the text": ("<body><nav><ul><li><a href='/'>Start</a></li><li><a href='/x'>Results</a></li></ul></nav><div class='entry-content'><h2>Results of the race</h2><p>Nineteen boats started in a strong westerly wind.</p><table><tr><th>Boat</th><th>Time</th></tr><tr><td>Swift</td><td>3:10</td></tr></table><p>The next race is in May.</p></div><div class='sidebar'><p>Subscribe to our newsletter.</p></div></body>",
     "Results of the race\nNineteen boats started in a strong westerly wind.\nBoat\nTime\nSwift\n3:10\nThe next race is in May."),
    "unnamed blocks": ("<body><div><div><a href='/'>Home</a><a href='/n'>News</a><a href='/s'>Sport</a></div><div><h1>A quiet village</h1><p>Nothing has happened here since the bridge fell in 1911, and people like it that way.</p><p>Visitors come for the walks.</p></div><div><a href='/p'>Privacy</a> <a href='/t'>Terms</a></div></div></body>",
     "A quiet village\nNothing has happened here since the bridge fell in 1911, and people like it that way.\nVisitors come for the walks."),
    "list and quote": ("<body><div class='cookie-banner'><p>We use cookies to make this site better.</p><button>Accept</button></div><article><header><h1>How to plant garlic</h1></header><ol><li>Break the bulb into cloves.</li><li>Plant them two inches deep.</li></ol><blockquote><p>Garlic is as good as ten mothers.</p></blockquote></article><form><label>Search</label><input></form></body>",
     "How to plant garlic\nBreak the bulb into cloves.\nPlant them two inches deep.\nGarlic is as good as ten mothers."),
    "share links and an advert between paragraphs": ("<body><div id='main'><h1>Night trains return</h1><p>From spring on, sleeper trains will run again between the two capitals.</p><div class='ad'>Buy the best shoes today! Click here.</div><p>Tickets are on sale from March.</p><ul class='share'><li><a href='#'>Facebook</a></li><li><a href='#'>Twitter</a></li></ul></div></body>",
     "Night trains return\nFrom spring on, sleeper trains will run again between the two capitals.\nTickets are on sale from March."),
    "no content": ("<body><nav><a href='/'>Home</a></nav><footer>Copyright</footer></body>",""),
}


@pytest.mark.parametrize("shape", SHAPES)
def test_other_shapes(shape):
    page, text = SHAPES[shape]
    assert main_text.extract(main_text.trained(), page) == text


def test_repeated_page_ids(spark):
    rows = [(1, "u", "<article><p>One text of some length stands here.</p></article>"), (1, "v", None), (None, None, "<article><p>Another text of some length.</p></article>")]
    got = main_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((str(r.page_id), r.text) for r in got) == [("1", ""), ("1", "One text of some length stands here."), ("None", "Another text of some length.")]


@pytest.mark.parametrize("page", ["", None, "<p>", "<div class=", "<script>x", "<!-- x", "<style>p{}</style>", "<p" * 500, "</p></div>", "<" * 5000, '<a href="' * 300])
def test_odd_markup(spark, page):
    rows = spark.createDataFrame([(1, "u", page, "clash")], "page_id long, url string, html string, text string")
    got = main_text.main_text(rows).first()
    assert got.page_id == 1 and got.n_chars == len(got.text)


def test_tree_shapes():
    shape = lambda page: [(x.tag, x.parent) for x in dom.parse(page)[0]][1:]
    assert shape("<ul><li>a<li>b</ul><p>c<p>d") == [("ul", 0), ("li", 1), ("li", 1), ("p", 0), ("p", 0)]
    assert shape("<table><tr><td>a<td>b<tr><td>c</table>") == [("table", 0), ("tr", 1), ("td", 2), ("td", 2), ("tr", 1), ("td", 5)]
    assert dom.parse("<p>a &amp;&nbsp;b\n <b>c</b><br>d</p>")[1] == [(1, "a & b c d")]
    assert dom.parse("<script>var t='</p>';</script>x<title>gone</title>")[1] == [(0, "x")]


def test_empty_pages(spark):
    assert main_text.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
