"""Monthly returns, factors, universe and filing index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.dates import business_month_end

#: Annual reports in the original; amendments and transition reports are out.
ANNUAL_FORMS = ("10-K", "10-K405")
ARCHIVE = "https://www.sec.gov/Archives/edgar/data/"
FACTOR_COLUMNS = ("MKT_RF", "SMB", "HML", "RMW", "CMA", "MOM")
MISSING_AT = -99.0


def month_end_close(closes: DataFrame, dates: DataFrame | None = None) -> DataFrame:
    """(ticker, date, close): last known close of each month, unfinished last month left out.

    closes: ticker, date, close.  The last date is taken over all tickers; dates: a table of
    the same dates (date) that is cheaper to read for it.
    """
    known = closes.filter("close is not null")
    monthly = known.groupBy("ticker", F.last_day("date").alias("month")).agg(F.max_by("close", "date").alias("close"))
    last = (dates or closes).agg(F.max("date").alias("last"))
    open_month = last.select(F.when(F.col("last") < business_month_end(F.col("last")), F.last_day("last")).alias("month")).filter("month is not null")
    return monthly.join(F.broadcast(open_month), "month", "left_anti").select("ticker", F.col("month").alias("date"), "close")  # at most one row


def monthly_returns(closes: DataFrame, dates: DataFrame | None = None) -> DataFrame:
    """(date, ticker, ret): month over month, null (dropped) where the month before has no close."""
    monthly = month_end_close(closes, dates)
    order = Window.partitionBy("ticker").orderBy("date")
    prev = F.lag(F.struct("date", "close")).over(order)
    out = monthly.withColumn("prev", prev).filter(F.col("prev.date") == F.last_day(F.add_months("date", -1)))
    return out.select("date", "ticker", (F.col("close") / F.col("prev.close") - 1).alias("ret"))


def missing_tickers(universe: DataFrame, returns: DataFrame) -> DataFrame:
    """Tickers of the universe (ticker) that have no return, each once."""
    return universe.select("ticker").distinct().join(returns.select("ticker").distinct(), "ticker", "left_anti")


def returns_wide(returns: DataFrame) -> DataFrame:
    """(ticker, year, M1..M12): every return of the long table (date, ticker, ret).

    The columns are months of the year, so the schema is fixed however many tickers and
    months of history there are.
    """
    months = returns.select("ticker", F.year("date").alias("year"), F.month("date").alias("month"), "ret")
    wide = months.groupBy("ticker", "year").pivot("month", list(range(1, 13))).agg(F.max("ret"))
    return wide.select("ticker", "year", *[F.col(f"`{m}`").alias(f"M{m}") for m in range(1, 13)])


def returns_long(wide: DataFrame) -> DataFrame:
    """(date, ticker, ret) of returns_wide(), months without a return left out."""
    cells = wide.unpivot(["ticker", "year"], [f"M{m}" for m in range(1, 13)], "month", "ret").dropna(subset=["ret"])
    date = F.last_day(F.make_date("year", F.substring("month", 2, 2).cast("int"), F.lit(1)))
    return cells.select(date.alias("date"), "ticker", "ret")


def calendar(returns: DataFrame) -> DataFrame:
    """(date, pos) of the months with returns, numbered from 0.  A row a month of history."""
    return returns.select("date").distinct().withColumn("pos", (F.row_number().over(Window.orderBy("date")) - 1).cast("long"))


def factor_block(files: DataFrame) -> DataFrame:
    """(name, yyyymm, factor, value) of the monthly block of factor files (name, text).

    The block starts at the first line of six digits and a comma, its header is the line
    before, and it ends at the first line of another form.  Values at or below -99 are
    missing; percent become decimals.  A file without block or header has no rows.
    """
    row = r"^\s*\d{6}\s*,"
    lines = files.select("name", F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n").alias("lines"))
    numbered = lines.withColumn("marks", F.transform("lines", lambda x: x.rlike(row)))
    first = F.array_position("marks", True)
    block = numbered.withColumn("first", first).filter("first > 1")
    rest = F.slice("marks", F.col("first").cast("int"), F.size("marks"))
    block = block.withColumn("n", F.when(F.array_position(rest, False) > 0, F.array_position(rest, False) - 1).otherwise(F.size(rest)))
    header = F.transform(F.split(F.element_at("lines", (F.col("first") - 1).cast("int")), ","), lambda x: F.trim(x))
    body = F.explode(F.slice("lines", F.col("first").cast("int"), F.col("n").cast("int")))
    rows = block.select("name", header.alias("header"), body.alias("line"))
    rows = rows.select("name", "header", F.transform(F.split("line", ","), lambda x: F.trim(x)).alias("parts"))
    cells = rows.select("name", F.get("parts", F.lit(0)).alias("yyyymm"), F.posexplode(F.slice("header", F.lit(2), F.size("header"))).alias("i", "factor"), "parts")
    value = F.get("parts", F.col("i") + 1).try_cast("double")
    return cells.filter("factor <> ''").select("name", "yyyymm", "factor", (F.when(value > MISSING_AT, value) / 100).alias("value"))


def factor_table(block: DataFrame, five: str, momentum: str) -> DataFrame:
    """Factors by month end: the five-factor file joined with the momentum file's one column."""
    date = F.last_day(F.to_date("yyyymm", "yyyyMM")).alias("date")
    names = ["Mkt-RF", "SMB", "HML", "RMW", "CMA", "RF"]
    wide = block.filter(F.col("name") == five).groupBy(date).pivot("factor", names).agg(F.max("value")).withColumnRenamed("Mkt-RF", "MKT_RF")
    mom = block.filter(F.col("name") == momentum).select(date, F.col("value").alias("MOM"))
    return wide.join(mom, "date").select("date", *FACTOR_COLUMNS, "RF")


def universe(raw: DataFrame, tickers: list[str] | None = None) -> DataFrame:
    """One row a company: the first listed class of each cik.

    raw: position, Symbol, Security, GICS Sector, CIK.  An unknown ticker is an error.
    """
    named = raw.select("position", F.col("Symbol").alias("ticker"), F.col("Security").alias("name"), F.col("GICS Sector").alias("sector"), F.col("CIK").cast("long").alias("cik"))
    first = Window.partitionBy("cik").orderBy("position")
    out = named.withColumn("rn", F.row_number().over(first)).filter("rn = 1").drop("rn", "position")
    out = out.withColumn("yahoo_ticker", F.replace("ticker", F.lit("."), F.lit("-")))
    if tickers:
        wanted = sorted({t.strip().upper() for t in tickers})
        out = out.filter(F.col("ticker").isin(wanted))
        there = {r.ticker for r in out.select("ticker").collect()}  # no more than were asked for
        if missing := [t for t in wanted if t not in there]:
            raise ValueError(f"Tickers not in the universe: {missing}")
    return out


def filing_url(cik: Column, accession: Column, document: Column) -> Column:
    doc = F.coalesce(F.nullif(document, F.lit("")), F.concat(accession, F.lit(".txt")))
    return F.concat(F.lit(ARCHIVE), cik.cast("string"), F.lit("/"), F.replace(accession, F.lit("-"), F.lit("")), F.lit("/"), doc)


def annual_filings(rows: DataFrame, start_date: str) -> DataFrame:
    """Annual reports filed on or after start_date (ISO, compared as text), one an accession.

    rows: cik, ticker, position, accessionNumber, filingDate, reportDate,
    acceptanceDateTime, form, primaryDocument.
    """
    kept = rows.filter(F.col("form").isin(*ANNUAL_FORMS) & (F.col("filingDate") >= start_date))
    first = Window.partitionBy("cik", "accessionNumber").orderBy("position")
    kept = kept.withColumn("rn", F.row_number().over(first)).filter("rn = 1")
    return kept.select(
        "cik", "ticker", F.col("accessionNumber").alias("accession"), F.col("filingDate").cast("date").alias("filing_date"),
        F.col("reportDate").try_cast("date").alias("report_date"), F.col("acceptanceDateTime").alias("acceptance_datetime"), "form",
        F.col("primaryDocument").alias("primary_document"), filing_url(F.col("cik"), F.col("accessionNumber"), F.col("primaryDocument")).alias("url"),
    )
