"""The test tables in the shape of the domain: filings, closes, returns, factors.

Keys and dates are integer arithmetic only, so the same views can be written in SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.operators import market


class Views:
    """Views over one folder of test tables."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir, self.kept = spark, sf_dir, {}

    def once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A small derived table that several branches of a plan read; computed once."""
        if name not in self.kept:
            self.kept[name] = make().persist()
        return self.kept[name]

    def settled(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """As once(), but written to the checkpoint folder, if there is one: what is built on
        it has a short plan."""
        if name not in self.kept:
            there = self.spark.sparkContext.getCheckpointDir() or self.spark.sparkContext.getConf().get("spark.checkpoint.dir")
            self.kept[name] = make().checkpoint() if there else make().persist()
        return self.kept[name]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def firms(self) -> int:
        return max(1, self.table("supplier").count())

    def ticker(self, key) -> F.Column:
        return F.concat(F.lit("T"), F.lpad(key.cast("string"), 6, "0"))

    def all_filings(self) -> DataFrame:
        """cik, ticker, accession, report_date, filing_date, bad, of every document; no text."""
        n = self.firms()
        k = F.row_number().over(Window.partitionBy("cik").orderBy("doc_id"))
        rows = self.table("documents").select("doc_id", (F.col("doc_id") % n).alias("cik")).withColumn("k", k)
        return rows.select(
            "cik", self.ticker(F.col("cik")).alias("ticker"), F.col("doc_id").cast("string").alias("accession"),
            F.make_date(F.col("k") + 1993, F.lit(12), F.lit(31)).alias("report_date"),
            F.make_date(F.col("k") + 1994, (1 + F.col("doc_id") * 7 % 12).cast("int"), (1 + F.col("doc_id") * 13 % 28).cast("int")).alias("filing_date"),
            (F.col("doc_id") % 11 == 0).alias("bad"),
        )

    def filings(self) -> DataFrame:
        return self.all_filings().filter("not bad").drop("bad")

    def sections(self) -> DataFrame:
        """(accession, section, text): the document, its first three lines, the other lines."""
        parts = F.array(*[F.struct(F.lit(name).alias("section"), text.alias("text")) for name, text in self._parts().items()])
        return self.table("documents").select(F.col("doc_id").cast("string").alias("accession"), F.inline(parts))

    def _parts(self) -> dict[str, F.Column]:
        lines = F.split("text", "\n")
        return {"full": F.col("text"), "item1a": F.array_join(F.slice(lines, 1, 3), "\n"), "item7": F.array_join(F.slice(lines, 4, 1_000_000_000), "\n")}

    def parsed(self) -> DataFrame:
        """As parse_filings() returns: every eleventh document failed.  A row a document, made
        where it is read: no text moves."""
        bad, parts = F.col("doc_id") % 11 == 0, self._parts()
        return self.table("documents").select(
            (F.col("doc_id") % self.firms()).alias("cik"), F.col("doc_id").cast("string").alias("accession"), *[F.when(~bad, text).alias(name) for name, text in parts.items()],
            F.when(bad, F.lit("ValueError: made up")).otherwise(F.lit("")).alias("error"),
        )

    def closes(self) -> DataFrame:
        """(ticker, date, close).  Dealt by ticker once: the months and returns made of it follow
        without another shuffle."""
        key = F.col("l_suppkey") % self.firms()
        rows = self.table("lineitem").select(self.ticker(key).alias("ticker"), F.col("l_shipdate").cast("date").alias("date"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))
        return rows.repartition("ticker").groupBy("ticker", "date").agg(F.max("price").alias("close"))

    def close_dates(self) -> DataFrame:
        return self.table("lineitem").select(F.col("l_shipdate").cast("date").alias("date"))

    def returns(self) -> DataFrame:
        return self.once("returns", lambda: market.monthly_returns(self.closes(), self.close_dates()))

    def factors(self) -> DataFrame:
        """Monthly mean of all returns, differences of means between groups of tickers, a constant."""
        key = F.substring("ticker", 2, 6).cast("int")
        spread = lambda m: F.avg(F.when(key % m == 0, F.col("ret"))) - F.avg(F.when(key % m == 1, F.col("ret")))
        groups = zip(("SMB", "HML", "RMW", "CMA", "MOM"), (2, 3, 5, 7, 4), strict=True)
        return self.returns().groupBy("date").agg(F.avg("ret").alias("MKT_RF"), *[spread(m).alias(f) for f, m in groups]).withColumn("RF", F.lit(0.002))

    def order_periods(self) -> DataFrame:
        """Orders as filings: one a customer and date."""
        day = F.col("o_orderdate").cast("date")
        rows = self.table("orders").select(F.col("o_custkey").alias("cik"), day.alias("filing_date"), day.alias("report_date")).distinct()
        return rows.withColumn("accession", F.concat_ws("/", "cik", "filing_date"))

    def passages(self) -> DataFrame:
        """Embeddings as passages of editions: firm, edition, passage_no, words, embedding."""
        return self.table("embeddings").select(F.col("label").cast("long").alias("firm"), (F.col("vec_id") % 5).alias("edition"), F.col("vec_id").alias("passage_no"), (20 + F.col("vec_id") % 100).alias("words"), "embedding")
