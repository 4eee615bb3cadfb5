"""Filings that arrive in a folder, parsed as they come.

The engine is a batch one; this is its parse step over a file stream.  Each micro-batch is
parsed with the batch operator, less what is in the sink already, and appended; a batch
that is run again after a failure therefore adds nothing twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from palimpsest.functions.filing_text import PARSER_VERSION
from palimpsest.operators.filings import PARSED, parse_filings

_FILES = "path string, modificationTime timestamp, length long, content binary"


def parse_arrivals(spark: SparkSession, landing: str, sink: str, checkpoint: str) -> StreamingQuery:
    """Starts the query: {landing}/{cik}/{accession}.html.gz to PARSED rows at sink; handles
    what is there and stops."""

    def step(batch: DataFrame, _: int) -> None:
        try:
            done = spark.read.schema(PARSED).parquet(sink).select("accession", F.lit(PARSER_VERSION).alias("parser_version"))
        except Exception as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            done = None
        parts = F.split("path", "/")
        raw = batch.select(F.element_at(parts, -2).try_cast("long").alias("cik"), F.regexp_replace(F.element_at(parts, -1), r"\.html\.gz$", "").alias("accession"), "content")
        parse_filings(raw, done).write.mode("append").parquet(sink, compression="zstd")

    files = spark.readStream.format("binaryFile").schema(_FILES).option("pathGlobFilter", "*.html.gz").option("recursiveFileLookup", "true").load(landing)
    return files.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
