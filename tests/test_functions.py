from __future__ import annotations

import math
import random
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.functions import edit, filing_text as ft
from palimpsest.functions.dates import formation_month_end
from palimpsest.functions.hac import hac_fit
from palimpsest.functions.words import jaccard, normalized_lines, tokens, word_count

DATES = {date(2024, 3, 15): date(2024, 3, 31), date(2024, 3, 28): date(2024, 3, 31), date(2024, 3, 29): date(2024, 4, 30), date(2024, 3, 30): date(2024, 4, 30), date(2024, 2, 29): date(2024, 3, 31)}


def test_formation_dates(spark):
    rows = spark.createDataFrame([(d,) for d in DATES], "d date").select("d", formation_month_end(F.col("d")).alias("f")).collect()
    assert {r.d: r.f for r in rows} == DATES


def _dp(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_distance_equals_dynamic_programming():
    rng = random.Random(7)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 70))] for _ in range(2))
        assert edit.distance(a, b) == _dp(a, b)


def test_measures_by_hand(spark):
    assert edit.similarity(["risk", "risk", "growth"], ["risk", "growth", "growth", "debt"]) == 0.5
    assert edit.similarity([], ["a"]) is None
    row = spark.createDataFrame([("risk risk growth", "Risk growth, growth 2024 debt")], "a string, b string").select(jaccard(tokens(F.col("a")), tokens(F.col("b"))).alias("j"), edit.edit_similarity("a", "b").alias("e"), word_count(F.col("b")).alias("n")).first()
    assert (row.j, row.e, row.n) == (pytest.approx(2 / 3), 0.5, 4)


def test_normalized_lines_match_python(spark):
    texts = ["a b​c \t d\r\n\n 12 \nPage 3 of 9\nTABLE OF CONTENTS\n- 7 -\n  keep 12\n", "", "　x　", "1234\n-12"]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", normalized_lines(F.col("t")).alias("l")).collect()
    assert {r.i: "\n".join(r.l) for r in got} == {i: ft.normalized(t) for i, t in enumerate(texts)}


PAGE = b"""<?xml version="1.0" encoding="utf-8"?><html><head><title>gone</title><style>p{}</style></head><body>
<div style="display: none">hidden facts</div><ix:header><p>hidden too</p></ix:header>
<table><tr><td>Prose in a cell</td><td>and another</td></tr><tr><td><table><tr><td>1,234</td><td>5,678</td></tr></table></td></tr></table>
<table><tr><td>2024</td><td>99.5</td><td>USD</td></tr></table>
<p>A paragraph that
wraps&nbsp;here</p><p>17</p><pre>kept
apart</pre><p>Item <b>1A</b>. Risk Factors<p>""" + b"<p>".join(b"Peril %d may hurt us." % i for i in range(40)) + b"<p>Item 1B. Unresolved</p><p>Item 7. Management's Discussion</p><p>Sales went up by a fifth</p><p>Item 8. Statements</p></body></html>"


def test_html_filing():
    out = ft.parsed(PAGE)
    lines = out["full"].split("\n")
    assert "A paragraph that wraps here" in lines and "kept" in lines and "apart" in lines
    assert "Prose in a cell and another" in lines
    for gone in ("hidden", "1,234", "99.5", "gone", "17"):
        assert all(gone != x and (gone == "17" or gone not in x.split()) for x in lines), gone
    assert out["item1a"].startswith("Peril 0 may") and out["item1a"].endswith("Peril 39 may hurt us.")
    assert out["item7"] == "Sales went up by a fifth"


def test_named_characters_need_their_semicolon():
    """As in the SQL and the original's parser, so a reference that was cut short stays as it is."""
    page = "<title>les&amp;&amp</title><p>&lt;b&gt; &amp;lt; &ampx; &copy 1 &copy; &nosuch; AT&T &#38; &</p><div style='display: none'>gone &amp</div>"
    assert ft.html_text(page) == "les&&amp\n<b> &lt; &ampx; &copy 1 © &nosuch; AT&T & &"


def test_headings_and_sections():
    assert [h[1] for h in ft.headings(["Item 1 Business", "Items 7 and 7A. Both", "Part II, Item 7.", "Item 1A | Risk Factors", "see Item 7", "Item 7" + "x" * 200])] == ["1", "7", "7", "1a"]
    lines = ["Item 7. Management's view", "Item 8.", "Item 7 of this report describes more", "Item 7. Management's view", "long " * 60 + "text here", "Item 7. Management's view", "more words still", "Item 8. End"]
    assert ft.section(lines, ft.headings(lines), "item7").split("\n") == [("long " * 60 + "text here"), "more words still"]
    assert ft.section(["Item 1A. Risk Factors", "text"], [(0, "1a", "Risk Factors")], "item1a") == ""
    crossed = ["Item 1A. Risk Factors", "Item 7. x", "words " * 50, "Item 2. y", "Item 1A. Risk Factors", "few words", "Item 1B. z"]
    assert ft.section(crossed, ft.headings(crossed), "item1a") == "few words"  # clean beats longer


def test_submission_wrapper_and_encodings():
    body = b"<SEC>\n<DOCUMENT><TYPE>EX-1<TEXT>exhibit</TEXT></DOCUMENT><DOCUMENT>\n<TYPE>10-K405\n<TEXT>\nThe report \x93itself\x94\n</TEXT>\n</DOCUMENT>"
    assert ft.parsed(body)["full"] == "The report “itself”"
    assert ft.parsed(b"") == {"full": "", "item1a": "", "item7": ""}


def test_passages():
    text = "\n".join(["one two", "a " * 500, "b " * 60, "c " * 70])
    got = ft.passages(text)
    assert all(8 <= len(p.split()) <= 180 for p in got) and sum(len(p.split()) for p in got) == 630


def _passages_by_steps(text, target=120, most=180, least=8):
    """Passages as a state machine over lines."""
    out, open_ = [], []
    for line in text.split("\n"):
        words = line.split()
        if len(words) > most:
            out.append(open_)
            open_ = []
        while len(words) > most:
            out.append(words[:most])
            words = words[most:]
        if len(open_) + len(words) > most:
            out.append(open_)
            open_ = []
        open_ = open_ + words
        if len(open_) >= target:
            out.append(open_)
            open_ = []
    return [" ".join(p) for p in [*out, open_] if len(p) >= least]


def test_passages_equal_the_steps():
    rng = random.Random(2)
    for _ in range(400):
        sizes = [rng.choice((0, 1, 5, 60, 119, 120, 179, 180, 181, 359, 360, 361, 500, rng.randint(0, 400))) for _ in range(rng.randint(0, 12))]
        n = iter(range(10**6))
        text = "\n".join(" ".join(f"w{next(n)}" for _ in range(k)) for k in sizes)
        assert ft.passages(text) == _passages_by_steps(text), sizes


def test_hac_against_sums():
    rng = np.random.default_rng(1)
    x, e = rng.normal(size=(240, 2)), rng.normal(size=240)
    y = 0.004 + 0.5 * x[:, 0] - 0.3 * x[:, 1] + e * 0.01
    got = hac_fit(y, np.column_stack([np.ones(240), x]), 6)
    assert got["beta"] == pytest.approx([0.004, 0.5, -0.3], abs=0.003) and got["r2"] > 0.99
    mean = hac_fit(y, np.ones((240, 1)), 6)
    u = y - y.mean()
    v = sum(u * u) + 2 * sum((1 - k / 7) * sum(u[k:] * u[:-k]) for k in range(1, 7))
    assert mean["t"][0] == pytest.approx(y.mean() * 240 / math.sqrt(v))
    assert mean["p"][0] == pytest.approx(math.erfc(abs(mean["t"][0]) / math.sqrt(2)))
