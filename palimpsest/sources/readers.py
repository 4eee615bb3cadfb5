"""Readers and writers of the tables and files the engine works on."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import market

_BLOCK = ("accessionNumber", "filingDate", "reportDate", "acceptanceDateTime", "form", "primaryDocument")
_COLUMNS = ", ".join(f"{c}: array<string>" for c in _BLOCK)
_SUBMISSION = f"cik string, filings struct<recent: struct<{_COLUMNS}>, files: array<struct<name: string, filingTo: string>>>"


def parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path, compression="zstd")


def write_csv(df: DataFrame, path: str) -> None:
    """A result table, which is small, as one CSV file."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def universe(spark: SparkSession, path: str, tickers: list[str] | None = None) -> DataFrame:
    """One row a company from a constituents CSV with Symbol, Security, GICS Sector, CIK."""
    raw = spark.read.csv(path, header=True).withColumn("position", F.monotonically_increasing_id())
    return market.universe(raw, tickers)


def _rows(blocks: DataFrame, block: str) -> DataFrame:
    """A column-wise block as rows; a missing or empty column is empty strings."""
    n = F.size(F.coalesce(F.col(f"{block}.accessionNumber"), F.array().cast("array<string>")))
    filled = {c: F.when(F.size(F.col(f"{block}.{c}")) > 0, F.col(f"{block}.{c}")).otherwise(F.array_repeat(F.lit(""), n)) for c in _BLOCK}
    rows = blocks.withColumns(filled).select("cik", "part", F.posexplode(F.arrays_zip(*_BLOCK)).alias("position", "f"))
    return rows.select("cik", "part", "position", "f.*")


def filing_index(spark: SparkSession, submissions: str, extra: str | None, companies: DataFrame, start_date: str) -> DataFrame:
    """Index of annual filings from local submission files, one JSON document a file.

    submissions: one a company (cik, filings); extra: older blocks, named as the
    submission's files entry says.  An extra file that ends before start_date is not used.
    """
    top = spark.read.schema(_SUBMISSION).json(submissions, multiLine=True).withColumn("cik", F.col("cik").cast("long"))
    rows = _rows(top.select("cik", F.lit(0).alias("part"), F.col("filings.recent").alias("block")), "block")
    if extra:
        named = top.select("cik", F.posexplode("filings.files").alias("part", "file")).select("cik", (F.col("part") + 1).alias("part"), F.col("file.name").alias("name"), F.coalesce("file.filingTo", F.lit("9999")).alias("until"))
        wanted = named.filter(F.col("until") >= start_date)
        block = ", ".join(f"{c} array<string>" for c in _BLOCK)
        older = spark.read.schema(block).json(extra, multiLine=True).withColumn("name", F.element_at(F.split(F.input_file_name(), "/"), -1))
        older = older.select("name", F.struct(*_BLOCK).alias("block")).join(wanted, "name").select("cik", "part", "block")
        rows = rows.unionByName(_rows(older, "block"))
    rows = rows.withColumn("position", F.struct("part", "position")).join(companies.select("cik", "ticker"), "cik")
    return market.annual_filings(rows, start_date)


def failed_companies(spark: SparkSession, submissions: str, companies: DataFrame) -> DataFrame:
    """(cik, ticker, reason) of companies (cik, ticker) that filing_index() has nothing to
    read for: 'missing' without a submission file, 'unreadable' where a file named
    CIK<number>.json is there but is no JSON of the expected form."""
    files = spark.read.schema(f"{_SUBMISSION}, _corrupt_record string").json(submissions, multiLine=True).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    named = F.regexp_extract("file", r"(\d+)[^/]*$", 1).try_cast("long")
    seen = files.select(F.coalesce(F.col("cik").try_cast("long"), named).alias("cik"), (F.col("_corrupt_record").isNull() & F.col("filings.recent.accessionNumber").isNotNull()).alias("ok"))
    seen = seen.filter("cik is not null").groupBy("cik").agg(F.bool_or("ok").alias("ok"))
    joined = companies.select("cik", "ticker").join(seen, "cik", "left")
    return joined.filter("ok is null or not ok").select("cik", "ticker", F.when(F.col("ok").isNull(), "missing").otherwise("unreadable").alias("reason"))


def write_texts(parsed: DataFrame, folder: str) -> None:
    """Parsed filings as {folder}/part-*.json.gz, one JSON object (accession, full, item1a,
    item7) a line; those with an error are left out."""
    parsed.filter("error = ''").select("accession", "full", "item1a", "item7").write.mode("overwrite").json(folder, compression="gzip")


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """What write_texts() wrote."""
    return spark.read.schema("accession string, full string, item1a string, item7 string").json(folder)


def raw_filings(spark: SparkSession, path: str) -> DataFrame:
    """(cik, accession, content) of files laid out as {cik}/{accession}.html.gz."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.html.gz").option("recursiveFileLookup", "true").load(path)
    parts = F.split("path", "/")
    return files.select(F.element_at(parts, -2).try_cast("long").alias("cik"), F.regexp_replace(F.element_at(parts, -1), r"\.html\.gz$", "").alias("accession"), "content")


def to_download(index: DataFrame, there: DataFrame) -> DataFrame:
    """Index rows whose file is not there yet; running it again fetches nothing new."""
    return index.join(there.select("accession"), "accession", "left_anti")


def daily_closes(spark: SparkSession, *paths: str) -> DataFrame:
    """(ticker, date, close) from long Parquet chunks; columns a chunk lacks are null."""
    out = None
    for path in paths:
        chunk = spark.read.parquet(path).select("ticker", F.col("date").cast("date").alias("date"), F.col("close").cast("double").alias("close"))
        out = chunk if out is None else out.unionByName(chunk)
    return out


def _unzip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for raw in batch.column("content").to_pylist():
            with zipfile.ZipFile(io.BytesIO(raw)) as z:
                texts.append(z.read(z.namelist()[0]).decode("latin-1"))
        yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(texts, pa.string())], ["name", "text"])


def factors(spark: SparkSession, folder: str, five: str, momentum: str) -> DataFrame:
    """Monthly factors from the zipped five-factor and momentum files in a folder."""
    files = spark.read.format("binaryFile").load([f"{folder}/{five}", f"{folder}/{momentum}"])
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    return market.factor_table(market.factor_block(named.mapInArrow(_unzip, "name string, text string")), five, momentum)
