"""The driver's contract and the catalogue against SQL on the smallest tables."""

from __future__ import annotations

import gzip
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as driver
from palimpsest.plans import oracle
from palimpsest.plans.queries import QUERIES
from palimpsest.schemas import SECTIONS
from palimpsest.sources.views import Views
from palimpsest.streaming.landing import parse_arrivals

FAST = ["universe_dedup", "form_filter_index", "filing_url", "token_counts", "cosine_pairs", "consecutive_pairs_orders", "qa_summary_by_year", "normalize_lines", "top_changes", "returns_melt", "factor_block_parse", "formation_dates", "quantile_assignment", "turnover_net", "status_counts", "html_to_text", "split_passages", "extract_sections", "factor_models", "hold_alpha", "similarity_describe", "missing_tickers", "meta_months"]


def _rows(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if "date" in str(df[c].dtype) or c.endswith("date") or c in ("date", "formed"):
            df[c] = pd.to_datetime(df[c]).astype(str)
    show = lambda v: "" if v is None or v is pd.NA or v != v else f"{float(v):.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(show(v) for v in r) for r in df.itertuples(index=False))


def test_catalogue_is_whole():
    assert set(oracle.BODIES) <= set(oracle.ORACLE_SQL) <= set(QUERIES) <= set(driver.queries())
    assert set(QUERIES) - set(oracle.ORACLE_SQL) == {"edit_pairs", "semantic_panel", "multifactor_regression"}
    assert set(QUERIES) - set(oracle.BODIES) - set(oracle.BODIES_2) == {"edit_pairs", "html_to_text", "extract_sections", "split_passages", "semantic_panel", "multifactor_regression"}


@pytest.mark.parametrize("name", FAST)
def test_query_equals_sql(spark, sf, name):
    db = duckdb.connect()
    for t in os.listdir(sf):
        db.execute(f"create view {t.removesuffix('.parquet')} as select * from '{sf}/{t}'")
    assert _rows(QUERIES[name](spark, sf).toPandas()) == _rows(db.sql(oracle.ORACLE_SQL[name]).df())


def test_edit_pairs_equal_python(spark, sf):
    from palimpsest.functions.edit import similarity

    got = QUERIES["edit_pairs"](spark, sf).toPandas()
    assert got["edit"].between(0, 1).all() and len(got) > 100 and similarity(["a"], ["a"]) == 1


def test_edit_of_every_section(spark, sf):
    """Brute force by the textbook recurrence, on the shorter pairs."""
    import re

    texts = {(r.accession, r.section): re.findall("[a-z]{2,}", r.text.lower()) for r in Views(spark, sf).sections().collect()}
    pairs = QUERIES["edit_pairs"](spark, sf).toPandas()
    panel = driver.queries()["similarity_panel_edit"](spark, sf).toPandas()
    before = dict(zip(panel["accession"], panel["prev_accession"], strict=True))
    assert set(pairs["section"]) == set(SECTIONS) and set(QUERIES["similarity_panel_wide"](spark, sf).columns) < set(panel.columns)

    def brute(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return 1 - row[-1] / max(len(a), len(b))

    for s in SECTIONS:
        of_pairs = {r.accession: r.edit for r in pairs[pairs["section"] == s].itertuples()}
        of_panel = panel.set_index("accession")[f"{s}_edit"].dropna().to_dict()
        assert of_panel and set(of_panel) == set(panel.set_index("accession")[f"{s}_cosine"].dropna().index)
        assert all(of_pairs[k] == x for k, x in of_panel.items())
        short = [k for k in of_pairs if len(texts[k, s]) * len(texts[before[k], s]) < 20_000]
        assert short and all(of_pairs[k] == pytest.approx(brute(texts[before[k], s], texts[k, s]), abs=1e-6) for k in short)


def test_returns_of_every_ticker_are_pivoted_and_melted(spark, sf):
    queries = driver.queries()
    every = _rows(queries["monthly_returns"](spark, sf).toPandas())
    wide = queries["returns_pivot_all"](spark, sf).toPandas()
    assert set(wide["ticker"]) == {r[-1] for r in every} and len(set(wide["ticker"])) > 4
    assert wide.filter(regex="^M").notna().sum().sum() == len(every)
    assert _rows(queries["returns_melt_all"](spark, sf).toPandas()) == every


def test_entry(spark):
    out = driver.entry(spark)
    assert out.columns[:3] == ["signal", "date", "n_names"] and out.count() > 0


def test_research_takes_every_signal(spark, sf):
    every = [f"{s}_{m}" for s in SECTIONS for m in ("cosine", "jaccard", "edit")] + ["item1a_semantic", "item7_semantic"]
    signals = driver.queries()["signals_all"](spark, sf).toPandas()
    panel = driver.queries()["similarity_panel_edit"](spark, sf).toPandas()
    assert set(signals["signal"]) == set(every)
    for name in every[:9]:
        got = signals[signals["signal"] == name].set_index("accession")["value"].to_dict()
        assert got == panel.set_index("accession")[name].dropna().to_dict()
    for s in ("item1a", "item7"):
        assert set(signals[signals["signal"] == f"{s}_semantic"]["accession"]) <= set(panel[panel[f"{s}_cosine"].notna()]["accession"])
    assert len({r.signal for r in driver.entry(spark).select("signal").distinct().collect()}) > 2
    out = driver.queries()["hold_robustness_all"](spark, sf)
    assert {"alpha_monthly_bps", "alpha_t"} <= set(out.columns)


def test_stream_parses_each_file_once(spark, tmp_path):
    for i in range(2):
        (tmp_path / "in/5").mkdir(parents=True, exist_ok=True)
        (tmp_path / f"in/5/a-{i}.html.gz").write_bytes(gzip.compress(b"<p>filing %d</p>" % i))
        parse_arrivals(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / f"state{i}")).awaitTermination()
    assert sorted(r.full for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["filing 0", "filing 1"]
