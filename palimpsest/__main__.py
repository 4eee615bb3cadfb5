"""Command line: python -m palimpsest COMMAND --home FOLDER [...].

Commands, in order: index, download, parse, similarity, semantic, market, report; ingest is
index and download, analyze is parse, similarity, market and report.  Everything is read
from files below the home folder, as nothing is fetched from a network here:

  universe.csv            constituents (Symbol, Security, GICS Sector, CIK)
  submissions/*.json      one submission file a company; older blocks in submissions-more/
  raw/CIK/ACCESSION.html.gz   filings; `download` lists those of the index that are not there
  closes.parquet          ticker, date, close
  factors/FIVE.zip, factors/MOMENTUM.zip   factor files (--five, --momentum)

and tables are written as Parquet below {home}/tables, the report to {home}/RESULTS.md.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import filings, market, performance, semantic, similarity
from palimpsest.plans import research
from palimpsest.session import session
from palimpsest.sources import readers


class Home:
    """The files of a run."""

    def __init__(self, spark: SparkSession, options: argparse.Namespace) -> None:
        self.spark, self.options, self.path = spark, options, options.home.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return readers.parquet(self.spark, f"{self.path}/tables/{name}")

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        readers.write_parquet(df, f"{self.path}/tables/{name}")
        return self.table(name)

    def universe(self) -> DataFrame:
        return readers.universe(self.spark, f"{self.path}/universe.csv", self.options.tickers.split(",") if self.options.tickers else None)

    def raw(self) -> DataFrame:
        return readers.raw_filings(self.spark, f"{self.path}/raw")


def index(home: Home) -> None:
    companies, more = home.universe(), f"{home.path}/submissions-more"
    there = more if Path(more.removeprefix("file://")).is_dir() else None
    out = home.keep("index", readers.filing_index(home.spark, f"{home.path}/submissions", there, companies, home.options.start))
    failed = home.keep("failed", readers.failed_companies(home.spark, f"{home.path}/submissions", companies))
    n, ciks = out.agg(F.count("*"), F.countDistinct("cik")).first()
    print(f"{n} filings of {ciks} companies; {failed.count()} companies without a readable submission")


def download(home: Home) -> None:
    chosen = home.table("index").join(home.universe().select("ticker"), "ticker", "left_semi")
    todo = home.keep("to_download", readers.to_download(chosen, home.raw()))
    print(f"{todo.count()} filings are not below {home.path}/raw; their addresses are in tables/to_download")


def ingest(home: Home) -> None:
    index(home)
    download(home)


def parse(home: Home) -> None:
    parsed = home.keep("texts", filings.parse_filings(home.raw().join(home.table("index").select("accession"), "accession", "left_semi")))
    qa = home.keep("qa", filings.quality_gates(parsed))
    print(research.markdown(home.keep("scorecard", filings.scorecard(qa, home.table("index"))).orderBy("year")))


def describe(df: DataFrame, *endings: str) -> None:
    print(research.markdown(performance.describe(df, [c for c in df.columns if c.endswith(endings)]).orderBy("measure")))


def compare(home: Home) -> None:
    panel = home.keep("similarity", similarity.similarity_panel(home.table("index"), home.table("qa"), filings.long_texts(home.table("texts"))))
    n, ciks = panel.agg(F.count("*"), F.countDistinct("cik")).first()
    print(f"{n} pairs of filings of {ciks} companies")
    describe(panel, "_cosine", "_jaccard", "_edit")


def embed(home: Home) -> None:
    scores, changes = semantic.semantic_panel(home.table("similarity"), filings.long_texts(home.table("texts")), cache=f"{home.path}/tables/embeddings")
    describe(home.keep("semantic", scores), "semantic", "novel_share")
    home.keep("top_changes", changes)


def prices(home: Home) -> None:
    factors = home.keep("factors", readers.factors(home.spark, f"{home.path}/factors", home.options.five, home.options.momentum))
    returns = home.keep("returns", market.monthly_returns(readers.daily_closes(home.spark, f"{home.path}/closes.parquet")))
    missing = market.missing_tickers(home.universe().select(F.col("yahoo_ticker").alias("ticker")), returns)
    for name, df in (("Factors", factors), ("Returns", returns)):
        print(name, *df.agg(F.min("date"), F.max("date")).first(), sep=" ")
    print(f"{missing.count()} tickers without a return")


def report(home: Home) -> None:
    panel = home.table("similarity")
    names = home.universe().select("ticker", "yahoo_ticker")  # prices are by that name
    signals = similarity.long_signals(panel)
    if Path(f"{home.path}/tables/semantic".removeprefix("file://")).is_dir():
        keys = ["cik", "ticker", "accession", "filing_date"]
        more = home.table("semantic").filter("semantic is not null").join(panel.select(*keys), "accession")
        signals = signals.unionByName(more.select(*keys, F.concat("section", F.lit("_semantic")).alias("signal"), F.col("semantic").alias("value")))
    signals = signals.join(names, "ticker").drop("ticker").withColumnRenamed("yahoo_ticker", "ticker")
    results = research.run(signals, home.table("returns"), home.table("factors"), min_names=home.options.min_names)
    results.write(f"{home.path}/tables")
    about = research.meta(home.table("index"), home.table("qa"), panel, home.table("portfolio_returns"))
    Path(f"{home.path}/RESULTS.md".removeprefix("file://")).write_text(research.report(results, about, home.table("scorecard")))


def analyze(home: Home) -> None:
    for step in (parse, compare, prices, report):
        step(home)


COMMANDS: dict[str, Callable[[Home], None]] = {"index": index, "download": download, "ingest": ingest, "parse": parse, "similarity": compare, "semantic": embed, "market": prices, "report": report, "analyze": analyze}


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    reader = argparse.ArgumentParser(prog="palimpsest", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    reader.add_argument("command", choices=COMMANDS)
    reader.add_argument("--home", required=True)
    reader.add_argument("--tickers", help="comma-separated subset")
    reader.add_argument("--start", default="2005-01-01", help="earliest filing date")
    reader.add_argument("--five", default="five.zip")
    reader.add_argument("--momentum", default="momentum.zip")
    reader.add_argument("--min-names", type=int, default=50, help="names a month needs")
    options = reader.parse_args(arguments)
    COMMANDS[options.command](Home(spark or session(), options))


if __name__ == "__main__":
    main()
