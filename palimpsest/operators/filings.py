"""Raw filings to text tables, quality gates and the parser's scorecard."""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import filing_text as ft
from palimpsest.functions.batches import sized_slices
from palimpsest.functions.words import word_count

PARSED = "cik long, accession string, full string, item1a string, item7 string, error string"


def _parsed(raw: bytes | None) -> tuple[str | None, str | None, str | None, str]:
    """full, item1a, item7, error of one filing; a bad one is a row with its error."""
    try:
        out = ft.parsed(gzip.decompress(raw) if raw is not None and raw[:2] == b"\x1f\x8b" else raw)
        return out["full"], out["item1a"], out["item7"], ""
    except Exception as bad:  # recorded, so that one filing doesn't stop the rest
        return None, None, None, f"{type(bad).__name__}: {bad}"[: ft.MAX_ERROR]


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, raws in sized_slices(batch.column("content")):
            rows = [_parsed(raw) for raw in raws]
            keys = [batch.column(c)[first : first + len(rows)] for c in ("cik", "accession")]
            yield pa.RecordBatch.from_arrays([*keys, *(pa.array(c, pa.string()) for c in zip(*rows, strict=True))], [c.split()[0] for c in PARSED.split(", ")])


def parse_filings(raw: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """PARSED rows of raw filings (cik, accession, content: bytes, gzipped or not).

    done: rows of an earlier run (accession, parser_version); those of this version stay out.
    """
    if done is not None:
        raw = raw.join(done.filter(F.col("parser_version") == ft.PARSER_VERSION).select("accession"), "accession", "left_anti")
    return raw.select(F.col("cik").cast("long").alias("cik"), "accession", "content").mapInArrow(_parse, PARSED)


def quality_gates(parsed: DataFrame, min_full: int = ft.MIN_FULL_WORDS, min_section: int = ft.MIN_SECTION_WORDS, max_share: float = ft.MAX_SECTION_SHARE) -> DataFrame:
    """Word counts and gates of parsed filings, in built-in expressions; a row with an
    error has null counts and fails every gate."""
    counts = parsed.select("cik", "accession", "error", *[word_count(F.col(s)).alias(f"n_words_{s}") for s in ("full", "item1a", "item7")])
    n = F.col("n_words_full")
    ok = lambda s: (F.col(f"n_words_{s}") >= min_section) & (n > 0) & (F.col(f"n_words_{s}") <= max_share * n)
    gates = {"full_ok": n >= min_full, "item1a_ok": ok("item1a"), "item7_ok": ok("item7")}
    return counts.select("*", *[F.coalesce(g, F.lit(False)).alias(k) for k, g in gates.items()], F.lit(ft.PARSER_VERSION).alias("parser_version"))


def scorecard(qa: DataFrame, index: DataFrame) -> DataFrame:
    """By filing year: filings, parse_errors, shares that pass, exact median words; filings
    without a date are left out."""
    dated = qa.join(index.select("accession", "filing_date"), "accession", "left")
    rate = lambda c: F.avg(F.col(c).cast("int")).alias(c)
    return (
        dated.withColumn("year", F.year("filing_date").cast("long")).filter("year is not null").groupBy("year")
        .agg(F.count("*").alias("filings"), F.sum(F.when(F.coalesce("error", F.lit("")) != "", 1).otherwise(0)).alias("parse_errors"), rate("full_ok"), rate("item1a_ok"), rate("item7_ok"), F.median("n_words_full").alias("median_words"))
    )


def long_texts(parsed: DataFrame) -> DataFrame:
    """(accession, section, text) of parsed filings."""
    return parsed.unpivot(["accession"], ["full", "item1a", "item7"], "section", "text").dropna(subset=["text"])
