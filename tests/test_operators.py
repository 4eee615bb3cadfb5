from __future__ import annotations

import gzip
import io
import json
import zipfile
from datetime import date

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from palimpsest.functions.dates import formation_month_end
from palimpsest.functions.edit import similarity as similarity_of
from palimpsest.operators import filings, market, portfolio, semantic, similarity
from palimpsest.operators import performance as perf
from palimpsest.plans import research
from palimpsest.sources import readers
from palimpsest.sources.views import Views

MONTHS = [d.date() for d in pd.date_range("2020-01-31", periods=36, freq="ME")]
SIGNAL = "ticker string, filing_date date, value double, accession string, signal string"


@pytest.fixture(scope="module")
def returns(spark):
    rng = np.random.default_rng(0)
    wide = rng.normal(0, 0.05, (36, 100))
    wide[4, :] = np.where(np.arange(100) >= 80, 0.06, np.where(np.arange(100) < 20, -0.04, 0))  # May 2020: the planted month
    rows = [(MONTHS[i], f"T{j:03d}", float(wide[i, j])) for i in range(36) for j in range(100)]
    return spark.createDataFrame(rows, "date date, ticker string, ret double").persist()


def _signal(spark, filed, order, name="a"):
    return spark.createDataFrame([(f"T{j:03d}", filed, float(v), f"{name}{j}", "sig") for j, v in enumerate(order)], SIGNAL)


def test_no_look_ahead_and_hold(spark, returns):
    out = portfolio.run_sort(_signal(spark, date(2020, 3, 16), range(100)), returns).orderBy("date").collect()
    assert out[0].date == date(2020, 4, 30) and len(out) == 12 and out[-1].date == date(2021, 3, 31)
    assert out[1].LS == pytest.approx(0.10)  # formed in April, earned in May
    assert out[0].turnover_long == pytest.approx(1) and out[0].LS_net == pytest.approx(out[0].LS - 0.002)


def test_newer_filing_replaces_older(spark, returns):
    both = _signal(spark, date(2020, 3, 16), range(100)).union(_signal(spark, date(2021, 3, 15), range(99, -1, -1), "b"))
    live = portfolio.live_signal(both, returns).join(market.calendar(returns), "pos")
    value = {r.date: r.value for r in live.filter("ticker = 'T000'").collect()}
    assert value[date(2021, 2, 28)] == 0 and value[date(2021, 3, 31)] == 99
    sizes = portfolio.quantiles(portfolio.live_signal(both, returns)).groupBy("pos", "q").count().select("count").distinct().collect()
    assert [r[0] for r in sizes] == [20]


def test_thin_months_and_empty(spark, returns):
    thin = _signal(spark, date(2020, 3, 16), range(10))
    assert portfolio.quantiles(portfolio.live_signal(thin, returns)).count() == 0
    assert portfolio.run_sort(thin, returns).count() == 0
    assert portfolio.live_signal(_signal(spark, date(2030, 1, 1), range(10)), returns).count() == 0
    clamped = portfolio.live_signal(_signal(spark, date(2001, 1, 1), range(3)), returns)
    assert clamped.agg(F.min("pos"), F.max("pos")).first() == (0, 11)


def test_quantiles_are_not_ntile(spark):
    live = spark.createDataFrame([("s", 0, f"T{j:02d}", 1.0) for j in range(52)], "signal string, pos long, ticker string, value double")
    got = portfolio.quantiles(live).groupBy("q").count().orderBy("q").collect()
    assert [r["count"] for r in got] == [10, 10, 11, 10, 11]
    assert portfolio.quantiles(live).filter("q = 1").agg(F.max("ticker")).first()[0] == "T09"  # ties by ticker


def _brute_turnover(members, ret):
    """members: month -> set; the traded weight of each month."""
    out, old = {}, None
    for i in sorted(members):
        new = {t: 1 / len(members[i]) for t in members[i]}
        if old is None or i - 1 not in members:
            out[i] = 1.0
        else:
            drift = {t: w * (1 + ret[i, t]) for t, w in old.items()}
            total = sum(drift.values())
            out[i] = sum(abs(new.get(t, 0) - drift.get(t, 0) / total) for t in {*new, *drift})
        old = new
    return out


def test_turnover_with_gap(spark):
    rng = np.random.default_rng(3)
    dates = MONTHS[:6]
    ret = {(i, f"T{j}"): float(rng.normal(0, 0.1)) for i in range(6) for j in range(6)}
    returns = spark.createDataFrame([(dates[i], t, r) for (i, t), r in ret.items()], "date date, ticker string, ret double")
    members = {0: {"T0", "T1"}, 1: {"T1", "T2"}, 3: {"T1", "T2"}, 4: {"T3"}}
    rows = [("s", i, t, q, 6) for i, m in members.items() for q in (1, 2) for t in (m if q == 1 else {f"T{j}" for j in range(6)} - m)]
    quantiled = spark.createDataFrame(rows, "signal string, pos long, ticker string, q long, n_names long")
    got = {r.pos: r.turnover for r in portfolio.turnover(quantiled, returns).filter("leg = 'short'").collect()}
    assert got == pytest.approx(_brute_turnover(members, ret))


def test_factor_recovery(spark):
    rng = np.random.default_rng(5)
    dates = [d.date() for d in pd.date_range("2000-01-31", periods=240, freq="ME")]
    f = rng.normal(0, 0.04, (240, 6))
    y = 0.004 + 0.5 * f[:, 0] - 0.3 * f[:, 2] + rng.normal(0, 0.002, 240)
    factors = spark.createDataFrame([(d, *map(float, r), 0.002) for d, r in zip(dates, f)], "date date, MKT_RF double, SMB double, HML double, RMW double, CMA double, MOM double, RF double")
    rows = [("s", "all", name, d, float(v)) for name, extra in (("LS", 0), ("Q1", 0.002)) for d, v in zip(dates, y + extra)]
    series = spark.createDataFrame(rows, "signal string, sample string, series string, date date, ret double")
    got = {(r.series, r.model): r for r in perf.factor_regression(series, factors).collect()}
    full = got["LS", "FF5+MOM"]
    assert full.alpha_monthly_bps == pytest.approx(40, abs=5) and full.beta_MKT_RF == pytest.approx(0.5, abs=0.02) and full.beta_HML == pytest.approx(-0.3, abs=0.02) and full.alpha_t > 5
    assert got["Q1", "FF5+MOM"].alpha_monthly_bps == pytest.approx(full.alpha_monthly_bps)  # excess of RF
    capm = perf.capm(series.filter("series = 'LS'"), factors).first()
    one = got["LS", "CAPM"]
    assert (capm.alpha_t, capm.beta_MKT_RF, capm.r2) == pytest.approx((one.alpha_t, one.beta_MKT_RF, one.r2))
    short = perf.factor_regression(series.filter("date < '2000-09-01'"), factors).first()
    assert short.months == 8 and short.alpha_t is None


def test_performance(spark):
    r = [0.01, -0.02, 0.03] * 8
    rows = [("s", "all", "LS", MONTHS[i], v) for i, v in enumerate(r)]
    got = perf.performance(spark.createDataFrame(rows, "signal string, sample string, series string, date date, ret double")).first()
    wealth = np.cumprod(1 + np.array(r))
    assert got.months == 24 and got.hit_rate == pytest.approx(2 / 3) and got.ann_return == pytest.approx(np.mean(r) * 12)
    assert got.max_drawdown == pytest.approx((wealth / np.maximum.accumulate(wealth) - 1).min()) and got.sharpe == pytest.approx(got.ann_return / got.ann_vol)
    few = perf.performance(spark.createDataFrame(rows[:11], "signal string, sample string, series string, date date, ret double")).first()
    assert few.months == 11 and few.ann_return is None


def test_monthly_returns(spark):
    days = [d.date() for d in pd.bdate_range("2024-01-01", "2024-04-10")]
    closes = spark.createDataFrame([("AAA", d, 100.0 + i) for i, d in enumerate(days)] + [("BBB", date(2024, 1, 31), 5.0), ("BBB", date(2024, 3, 28), 6.0)], "ticker string, date date, close double")
    got = {(r.ticker, r.date): r.ret for r in market.monthly_returns(closes).collect()}
    assert set(got) == {("AAA", date(2024, 2, 29)), ("AAA", date(2024, 3, 31))}  # April is open; BBB skipped February


FRENCH = "This file was made up\n\n,Mkt-RF,SMB,HML,RMW,CMA,RF\n196307,-0.39,-0.41,-0.97,0.68,-1.18,0.27\n196308,5.07,-0.80,1.80,0.36,-0.35,-99.99\n196309,-1.57,-0.52,0.13,-0.71,0.29,0.27\n\n Annual Factors\n,Mkt-RF,SMB,HML,RMW,CMA,RF\n1964,12.5,1,1,1,1,1\n"


def test_factor_files(spark, tmp_path):
    for name, text in (("five.zip", FRENCH), ("mom.zip", "Momentum\n,Mom\n196307,0.90\n196308,1.01\n\n")):
        raw = io.BytesIO()
        with zipfile.ZipFile(raw, "w") as z:
            z.writestr("x.csv", text)
        (tmp_path / name).write_bytes(raw.getvalue())
    got = readers.factors(spark, str(tmp_path), "five.zip", "mom.zip").orderBy("date").collect()
    assert [r.date for r in got] == [date(1963, 7, 31), date(1963, 8, 31)]
    assert got[1].MKT_RF == pytest.approx(0.0507) and got[1].RF is None and got[1].MOM == pytest.approx(0.0101)
    bad = spark.createDataFrame([("a", "no block here"), ("b", "196307,1\n")], "name string, text string")
    assert market.factor_block(bad).count() == 0


def test_filing_index(spark, tmp_path):
    block = lambda rows: {k: [r[i] for r in rows] for i, k in enumerate(("accessionNumber", "filingDate", "reportDate", "acceptanceDateTime", "form", "primaryDocument"))}
    recent = [("1-1-1", "2024-02-01", "2023-12-31", "", "10-K", "a.htm"), ("1-1-2", "2024-03-01", "", "", "8-K", "b.htm"), ("1-1-3", "2023-02-01", "x", "", "10-K", ""), ("1-1-4", "2023-03-01", "", "", "10-K/A", "d.htm")]
    older = [("1-1-5", "2006-01-02", "2005-12-31", "", "10-K", "e.htm"), ("1-1-6", "2004-01-02", "", "", "10-K405", "f.htm")]
    (tmp_path / "top").mkdir()
    (tmp_path / "old").mkdir()
    (tmp_path / "top/CIK1.json").write_text(json.dumps({"cik": "0000001", "filings": {"recent": block(recent), "files": [{"name": "o1.json", "filingTo": "2008-01-01"}, {"name": "o2.json", "filingTo": "2001-01-01"}]}}))
    (tmp_path / "old/o1.json").write_text(json.dumps(block(older)))
    (tmp_path / "old/o2.json").write_text(json.dumps(block([("1-1-7", "2020-01-01", "", "", "10-K", "never.htm")])))
    companies = spark.createDataFrame([(1, "AAA")], "cik long, ticker string")
    got = {r.accession: r for r in readers.filing_index(spark, str(tmp_path / "top"), str(tmp_path / "old"), companies, "2005-01-01").collect()}
    assert set(got) == {"1-1-1", "1-1-3", "1-1-5"}
    assert got["1-1-3"].url.endswith("/1/113/1-1-3.txt") and got["1-1-3"].report_date is None and got["1-1-1"].url.endswith("/1/111/a.htm")


def test_universe(spark, tmp_path):
    (tmp_path / "u.csv").write_text("Symbol,Security,GICS Sector,CIK\nGOOGL,A,T,5\nGOOG,A,T,5\nBRK.B,B,F,6\n")
    got = {r.ticker: r.yahoo_ticker for r in readers.universe(spark, str(tmp_path / "u.csv")).collect()}
    assert got == {"GOOGL": "GOOGL", "BRK.B": "BRK-B"}
    assert readers.universe(spark, str(tmp_path / "u.csv"), [" brk.b "]).count() == 1
    with pytest.raises(ValueError, match="NOPE"):
        readers.universe(spark, str(tmp_path / "u.csv"), ["NOPE"])


def test_pairs(spark):
    rows = [("a", date(2020, 12, 31), date(2021, 2, 1)), ("b", date(2021, 12, 31), date(2022, 2, 1)), ("c", date(2023, 12, 31), date(2024, 2, 1)), ("d", None, date(2024, 12, 30)), ("e", date(2021, 12, 31), date(2022, 5, 1))]
    got = similarity.consecutive_pairs(spark.createDataFrame([(1, *r) for r in rows], "cik long, accession string, report_date date, filing_date date")).collect()
    assert {(r.prev_accession, r.accession) for r in got} == {("a", "b"), ("c", "d")}


def test_panel_gates_and_zero_overlap(spark):
    index = spark.createDataFrame([(1, "T", a, date(y + 1, 2, 1), date(y, 12, 31)) for a, y in (("a", 2000), ("b", 2001), ("c", 2002), ("d", 2003))], "cik long, ticker string, accession string, filing_date date, report_date date")
    qa = spark.createDataFrame([("a", "", True, True, False), ("b", "", True, False, False), ("c", "", True, True, False), ("d", "E: x", False, False, False)], "accession string, error string, full_ok boolean, item1a_ok boolean, item7_ok boolean")
    texts = spark.createDataFrame([("a", "full", "risk risk growth"), ("b", "full", "risk growth growth debt"), ("c", "full", "other words"), ("a", "item1a", "one"), ("b", "item1a", "two words"), ("c", "item1a", "three more words")], "accession string, section string, text string")
    got = {r.accession: r for r in similarity.similarity_panel(index, qa, texts).collect()}
    assert set(got) == {"b", "c"}  # d failed to parse
    b, c = got["b"], got["c"]
    assert (b.full_cosine, b.full_jaccard, b.full_edit) == pytest.approx((4 / 30**0.5, 2 / 3, 0.5))
    assert (b.full_words, b.full_prev_words, b.item1a_words, b.item1a_prev_words) == (4, 3, 0, 1) and b.item1a_cosine is None
    assert (c.full_cosine, c.full_jaccard, c.full_edit) == (0, 0, 0)
    assert similarity.long_signals(similarity.similarity_panel(index, qa, texts)).count() == 6


def test_parse_incremental_and_gates(spark, tmp_path):
    (tmp_path / "7").mkdir()
    (tmp_path / "7/x-1.html.gz").write_bytes(gzip.compress(b"<p>Hello filing text</p>"))
    (tmp_path / "7/x-2.html.gz").write_bytes(b"\x1f\x8bbroken")
    raw = readers.raw_filings(spark, str(tmp_path))
    got = {r.accession: r for r in filings.parse_filings(raw).collect()}
    assert got["x-1"].full == "Hello filing text" and got["x-1"].error == "" and got["x-2"].error and got["x-2"].full is None
    qa = filings.quality_gates(filings.parse_filings(raw), 3, 1)
    assert {r.accession: (r.n_words_full, r.full_ok, r.item1a_ok) for r in qa.collect()} == {"x-1": (3, True, False), "x-2": (None, False, False)}
    assert filings.parse_filings(raw, qa).count() == 0
    index = spark.createDataFrame([("x-1", date(2020, 1, 1)), ("x-2", date(2020, 5, 1))], "accession string, filing_date date")
    card = filings.scorecard(qa, index).first()
    assert (card.year, card.filings, card.parse_errors, card.full_ok, card.median_words) == (2020, 2, 1, 0.5, 3)


def test_semantic(spark):
    keys = ["pair"]
    now = spark.createDataFrame([(1, 0, 100, [1.0, 0.0, 0.0]), (1, 1, 100, [0.0, 1.0, 0.0]), (1, 2, 200, [0.0, 0.6, 0.8])], "pair int, passage_no int, words int, embedding array<float>")
    before = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0])], "pair int, embedding array<float>")
    best = semantic.best_match(now, before, keys)
    got = semantic.semantic_scores(best, keys).first()
    assert got.semantic == pytest.approx(0.25 + 0.25 + 0.5 * 0.6, abs=1e-6) and got.novel_share == 0  # 0.6 as float is over 0.60
    same = semantic.semantic_scores(semantic.best_match(now, now.select("pair", "embedding"), keys), keys).first()
    assert same.semantic == pytest.approx(1, abs=1e-6) and same.novel_share == 0
    assert [r.passage_no for r in semantic.top_changes(best, keys, 1).collect()] == [2]


def test_research_identities(spark, returns):
    rng = np.random.default_rng(9)
    both = None
    for y in (2020, 2021):
        rows = _signal(spark, date(y, 2, 3), rng.normal(size=100), f"{y}-").withColumn("signal", F.lit("full_cosine"))
        both = rows if both is None else both.union(rows)
    factors = spark.createDataFrame([(d, *map(float, rng.normal(0, 0.03, 6)), 0.001) for d in MONTHS], "date date, MKT_RF double, SMB double, HML double, RMW double, CMA double, MOM double, RF double")
    out = research.run(both, returns, factors)
    assert out.performance.count() == 4 and out.quintiles.count() == 2 and out.attribution.count() == 14 and out.robustness.count() == 3
    q = out.quintiles.filter("sample = 'Full sample'").first()
    p = {r.series: r for r in out.performance.filter("sample = 'Full sample'").collect()}
    assert q.Q5 - q.Q1 == pytest.approx(p["LS"].mean_monthly_bps)
    assert p["LS"].mean_monthly_bps - p["LS_net"].mean_monthly_bps == pytest.approx(2 * q.avg_monthly_turnover * 10)
    text = research.markdown(out.quintiles.orderBy("sample"), "signal", "sample", "Q1")
    assert text.startswith("| signal | sample | Q1 |\n| --- | --- | --- |\n| full_cosine |")


def test_download_is_idempotent(spark):
    index = spark.createDataFrame([("a",), ("b",)], "accession string")
    assert [r.accession for r in readers.to_download(index, index.filter("accession = 'a'")).collect()] == ["b"]
    assert readers.to_download(index, index).count() == 0




def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_texts_equal_brute_force(spark):
    """Sections that one side lacks, empty and null texts; words are counted where the two texts
    meet, so no row a term is made."""
    rng = np.random.default_rng(4)
    text = lambda: " ".join(f"w{'abcdefghij'[k]}" for k in rng.integers(10, size=rng.integers(1, 30)))
    texts = {(f"a{i}", s): (None if i == 3 else "" if i == 4 else "12 ?" if i == 5 else text()) for i in range(30) for s in ("full", "item1a", "item7") if s == "full" or i % 3}
    pairs = spark.createDataFrame([(f"a{i}", f"a{i - 1}") for i in range(1, 30)], "accession string, prev_accession string")
    frame = spark.createDataFrame([(*k, t) for k, t in texts.items()], "accession string, section string, text string")
    words = {k: (t or "").split() if t != "12 ?" else [] for k, t in texts.items()}
    bags, edits = {}, {}
    for i in range(1, 30):
        for s in ("full", "item1a", "item7"):
            a, b = words.get((f"a{i}", s), []), words.get((f"a{i - 1}", s), [])
            if a or b:
                count = lambda x, t: x.count(t)
                every = {*a, *b}
                dot, aa, bb = (sum(count(x, t) * count(y, t) for t in every) for x, y in ((a, b), (a, a), (b, b)))
                bags[f"a{i}", s] = (dot / (aa**0.5 * bb**0.5), len({*a} & {*b}) / len(every), len(a), len(b)) if a and b else (None, None, len(a), len(b))
            if {(f"a{i}", s), (f"a{i - 1}", s)} <= set(texts):
                edits[f"a{i}", s] = similarity_of(a, b)
    got = similarity.cosine_jaccard(pairs, frame)
    rows = {(r.accession, r.section): (r.cosine, r.jaccard, r.words, r.prev_words) for r in got.collect()}
    assert set(rows) == set(bags) and all(rows[k] == (pytest.approx(v) if v[0] is not None else v) for k, v in bags.items())
    assert {(r.accession, r.section): r.edit for r in similarity.edit(pairs, frame).collect()} == pytest.approx(edits)
    assert "regexp_extract_all" not in _plan(got) and "Aggregate" not in _plan(got)


def test_no_text_moves_for_the_gates(spark, sf):
    """Words are counted where documents are read."""
    assert "Exchange" not in _plan(filings.quality_gates(Views(spark, sf).parsed()))


def test_lines_are_dealt_once_for_returns(spark, sf):
    """Daily closes, month ends and returns of a ticker are made in one place."""
    spark.catalog.clearCache()  # else the plan shows what other tests have kept
    v = Views(spark, sf)
    assert _plan(market.monthly_returns(v.closes(), v.close_dates())).count("Exchange hashpartitioning") == 1


def test_passages_are_embedded_in_one_worker(spark):
    """Cut and encoded in one step, with the rows that the two steps give."""
    long = "\n".join(" ".join(f"word{i}x{j}" for j in range(50)) for i in range(40))
    texts = spark.createDataFrame([("a", "item7", long), ("b", "item7", None), ("c", "item1a", "short")], "accession string, section string, text string")
    got = semantic.embedded_passages(texts, size=5)
    assert _plan(got).count("MapInArrow") == 1
    rows = sorted(map(tuple, got.collect()))
    assert len(rows) > 5 and rows == sorted(map(tuple, semantic.embed(semantic.split_passages(texts)).collect()))
    index = [(1, "T", a, date(y + 1, 2, 1), date(y, 12, 31)) for a, y in (("a", 2000), ("d", 2001))]
    panel = spark.createDataFrame([(*r[:3], "a", r[3], 0.5, 0.5) for r in index[1:]], "cik long, ticker string, accession string, prev_accession string, filing_date date, item1a_cosine double, item7_cosine double")
    scores, _ = semantic.semantic_panel(panel, texts.union(spark.createDataFrame([("d", "item7", long)], texts.schema)))
    plan = _plan(scores)
    assert plan.count("MapInArrow") <= 2 and scores.first().semantic == pytest.approx(1, abs=1e-3)


def test_portfolios_equal_brute_force(spark):
    """Filings that replace each other, ties, gaps in returns, holds that run out; a name and
    month is made once, where a ticker's filings and returns have met."""
    rng = np.random.default_rng(11)
    dates = MONTHS[:18]
    ret = {(i, f"T{j}"): float(rng.normal(0, 0.1)) for i in range(18) for j in range(12) if rng.random() < 0.9}
    returns = spark.createDataFrame([(dates[i], t, r) for (i, t), r in ret.items()], "date date, ticker string, ret double")
    filed = [(f"T{rng.integers(13)}", date(2020, int(rng.integers(1, 13)), int(rng.integers(1, 28))), float(rng.integers(5)), f"a{k:02d}") for k in range(60)]  # T12 has no return
    signals = spark.createDataFrame([(*f, "sig") for f in filed], SIGNAL)
    formed = {r.filing_date: r.f for r in signals.select("filing_date", formation_month_end(F.col("filing_date")).alias("f")).distinct().collect()}
    live: dict = {}
    for t, day, value, name in filed:
        start = sum(d < formed[day] for d in dates)
        for pos in range(start, min(start + 3, 18)):
            if t != "T12":
                live.setdefault((pos, t), []).append((day, name, value))
    live = {k: max(v)[2] for k, v in live.items()}
    got = portfolio.live_signal(signals, returns, 3)
    assert {(r.pos, r.ticker): r.value for r in got.collect()} == live and "Aggregate" not in _plan(got).split("Generate")[0]
    with_ret = {(r.pos, r.ticker): (r.value, r.ret) for r in portfolio.live_with_returns(signals, returns, 3).collect()}
    assert with_ret == {(pos, t): (v, ret.get((pos + 1, t))) for (pos, t), v in live.items()}
    want, old = {}, {}
    for pos in range(17):
        names = sorted((v, t) for (p, t), v in live.items() if p == pos)
        n = len(names)
        if n < 4:
            old = {}
            continue
        of = {q: [t for i, (_, t) in enumerate(names, 1) if -(-i * 5 // n) == q and (pos + 1, t) in ret] for q in range(1, 6)}
        mean = {q: float(np.mean([ret[pos + 1, t] for t in m])) for q, m in of.items() if m}
        moved, now = {}, {}
        for leg, q in (("short", 1), ("long", 5)):
            w = {t: 1 / len(of[q]) for t in of[q]}
            before = old.get(leg, {})
            moved[leg] = sum(abs(w.get(t, 0) - before.get(t, 0)) for t in {*w, *before})
            grown = {t: x * (1 + ret[pos + 1, t]) for t, x in w.items()}
            now[leg] = {t: g / sum(grown.values()) for t, g in grown.items()}
        old = now
        want[dates[pos + 1]] = (n, *[mean.get(q) for q in range(1, 6)], moved["short"], moved["long"])
    out = portfolio.run_sort(signals, returns, 3, min_names=4)
    rows = {r.date: (r.n_names, r.Q1, r.Q2, r.Q3, r.Q4, r.Q5, r.turnover_short, r.turnover_long) for r in out.collect()}
    assert set(rows) == set(want) and len(want) > 8
    for d, r in rows.items():
        assert r == pytest.approx(want[d]) if None not in r else [x is None for x in r] == [x is None for x in want[d]]
