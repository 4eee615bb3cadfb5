"""Declared schemas of the tables that stages exchange, as DDL."""

from __future__ import annotations

UNIVERSE = "ticker string, name string, sector string, cik long, yahoo_ticker string"
FILING_INDEX = "cik long, ticker string, accession string, filing_date date, report_date date, acceptance_datetime string, form string, primary_document string, url string"
FILING_TEXT = "cik long, accession string, full string, item1a string, item7 string"
PARSE_QA = "cik long, accession string, error string, n_words_full long, n_words_item1a long, n_words_item7 long, full_ok boolean, item1a_ok boolean, item7_ok boolean, parser_version int"
MONTHLY_RETURNS = "date date, ticker string, ret double"
FACTORS = "date date, MKT_RF double, SMB double, HML double, RMW double, CMA double, MOM double, RF double"
SIGNALS = "cik long, ticker string, accession string, filing_date date, signal string, value double"
PASSAGES = "accession string, section string, passage_no int, words int, passage string"
ATTRIBUTION_FACTORS = ("MKT_RF", "SMB", "HML", "RMW", "CMA", "MOM")
ATTRIBUTION = "signal string, sample string, series string, model string, months long, alpha_monthly_bps double, alpha_ann double, alpha_t double, alpha_p double, r2 double, " + ", ".join(f"beta_{f} double, t_{f} double" for f in ATTRIBUTION_FACTORS)

SECTIONS = ("full", "item1a", "item7")
MEASURES = ("cosine", "jaccard", "edit")
