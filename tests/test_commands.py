"""The command line over a made-up home folder, and the readers behind it."""

from __future__ import annotations

import gzip
import io
import json
import zipfile

import numpy as np
import pandas as pd
import pytest

from palimpsest.__main__ import main
from palimpsest.operators import semantic
from palimpsest.sources import readers

FIRMS = [(i, f"F{i:02d}") for i in range(1, 13)]
BLOCK = ("accessionNumber", "filingDate", "reportDate", "acceptanceDateTime", "form", "primaryDocument")


@pytest.fixture(scope="module")
def home(tmp_path_factory):
    top = tmp_path_factory.mktemp("home")
    rng = np.random.default_rng(4)
    words = [f"{a}{b}" for a in ("alpha", "beta", "gamma", "delta") for b in "abcdefghij"]
    (top / "universe.csv").write_text("Symbol,Security,GICS Sector,CIK\n" + "".join(f"{t},Firm {i},S,{i}\n" for i, t in FIRMS) + "LOST,Firm 99,S,99\n")
    (top / "submissions").mkdir()
    for i, _ in FIRMS:
        rows = [(f"{i}-{y}", f"{y + 1}-02-{i:02d}", f"{y}-12-31", "", "10-K", "a.htm") for y in (2018, 2019, 2020)]
        block = {k: [r[j] for r in rows] for j, k in enumerate(BLOCK)}
        (top / f"submissions/CIK{i:010d}.json").write_text(json.dumps({"cik": f"{i:010d}", "filings": {"recent": block, "files": []}}))
        (top / f"raw/{i}").mkdir(parents=True)
        for a, *_ in rows:
            if a == "1-2020":
                continue  # not there yet
            say = lambda n: " ".join(rng.choice(words, n))
            page = f"<p>Item 1. Business</p><p>{say(6000)}</p><p>Item 1A. Risk Factors</p><p>{say(700)}</p><p>Item 1B. None</p><p>Item 7. Management view</p><p>{say(900)}</p><p>Item 8. End</p>"
            (top / f"raw/{i}/{a}.html.gz").write_bytes(gzip.compress(page.encode()))
    days = pd.bdate_range("2018-12-01", "2022-06-30")
    closes = pd.DataFrame([(t, d.date(), 100 * float(np.exp(rng.normal(0, 0.2)))) for _, t in FIRMS for d in days[::5]], columns=["ticker", "date", "close"])
    closes.to_parquet(top / "closes.parquet")
    months = pd.date_range("2018-12-31", "2022-06-30", freq="ME")
    line = lambda d, n: f"{d:%Y%m}," + ",".join(f"{x:.2f}" for x in rng.normal(0.5, 3, n))
    (top / "factors").mkdir()
    for name, head, n in (("five", "Mkt-RF,SMB,HML,RMW,CMA,RF", 6), ("momentum", "Mom", 1)):
        raw = io.BytesIO()
        with zipfile.ZipFile(raw, "w") as z:
            z.writestr("x.csv", f"made up\n\n,{head}\n" + "\n".join(line(d, n) for d in months) + "\n\n")
        (top / f"factors/{name}.zip").write_bytes(raw.getvalue())
    return top


def test_all_commands(spark, home, capsys):
    run = lambda *a: (main([*a, "--home", str(home)], spark), capsys.readouterr().out)[1]
    assert "36 filings of 12 companies; 1 companies without" in run("ingest") and "1-2020" in {r.accession for r in spark.read.parquet(f"{home}/tables/to_download").collect()}
    assert "| 2019 | 12 | 0 |" in run("parse")
    assert "23 pairs of filings of 12 companies" in run("similarity")
    assert "| semantic | 46 |" in run("semantic")
    assert "1 tickers without a return" in run("market")
    run("report", "--min-names", "5")
    text = (home / "RESULTS.md").read_text()
    assert text.count("\n## ") == 7 and "full_cosine" in text and "item1a_semantic" in text
    assert spark.read.parquet(f"{home}/tables/portfolio_returns").count() > 0


def test_failed_companies(spark, home, tmp_path):
    companies = spark.createDataFrame([(1, "F01"), (2, "BAD"), (3, "NONE")], "cik long, ticker string")
    good = (home / "submissions/CIK0000000001.json").read_text()
    (tmp_path / "CIK1.json").write_text(good)
    (tmp_path / "CIK0000000002.json").write_text("{not json")
    got = {tuple(r) for r in readers.failed_companies(spark, str(tmp_path), companies).collect()}
    assert got == {(2, "BAD", "unreadable"), (3, "NONE", "missing")}


def test_embeddings_are_cached(spark, tmp_path):
    pieces = spark.createDataFrame([("a", "item7", 0, 2, "x y"), ("a", "item7", 1, 2, "y z"), ("b", "item7", 0, 1, "z")], "accession string, section string, passage_no int, words int, passage string")
    first = {(r.accession, r.passage_no): r.embedding for r in semantic.cached_embeddings(pieces, str(tmp_path / "c")).collect()}
    assert first == {(r.accession, r.passage_no): r.embedding for r in semantic.embed(pieces).collect()}

    def other(texts):
        return np.full((len(texts), semantic.DIMENSIONS), 0.5, np.float32)

    again = semantic.cached_embeddings(pieces, str(tmp_path / "c"), other)
    assert {(r.accession, r.passage_no): r.embedding for r in again.collect()} == first  # nothing encoded anew
    more = pieces.union(spark.createDataFrame([("b", "item7", 1, 1, "w")], pieces.schema))
    got = {(r.accession, r.passage_no): r.embedding for r in semantic.cached_embeddings(more, str(tmp_path / "c"), other).collect()}
    assert got["a", 0] == first["a", 0] and got["b", 0] == got["b", 1] == [0.5] * semantic.DIMENSIONS  # b has another number of passages now


def test_texts_round_trip(spark, tmp_path):
    parsed = spark.createDataFrame([(1, "a", "f", "r", "m", ""), (1, "b", None, None, None, "E: x")], "cik long, accession string, full string, item1a string, item7 string, error string")
    readers.write_texts(parsed, str(tmp_path / "t"))
    assert [tuple(r) for r in readers.texts(spark, str(tmp_path / "t")).collect()] == [("a", "f", "r", "m")]
    assert all(p.name.endswith(".json.gz") for p in (tmp_path / "t").glob("part-*"))
