"""The corpus pipeline: documents in, token counts and digests of clean documents out.

Each stage takes what its predecessor kept, written as Parquet and read again.  All but
the last return the columns of documents.

Defined results: a null or empty text has no words, so the first stage takes its row away;
a null source is a host of its own; rows with a null or repeated doc_id are judged one by
one; of rows with one text only the one of smallest doc_id stays (nulls last); extra
columns are carried through (their names must not begin with _pq_); an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm.common import saved, shared_dir, table
from palimpsest.llm.minhash import one_of_each
from palimpsest.llm.pieces import encoded
from palimpsest.llm.pii import without_personal_data
from palimpsest.llm.quality import only_kept
from palimpsest.llm.queries import vocabulary
from palimpsest.llm.winnow import without_contaminated


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the document and host rules reject go."""
    return only_kept(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: shingles of five words, similarity 0.8 or more."""
    return one_of_each(docs, k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window of 13 words anywhere go."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark", "item_id", "text"), window=13, share=None)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind."""
    return without_personal_data(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text."""
    return encoded(docs, vocabulary("piece_bpe_32k.model")).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("personal data", personal_data),
    ("sentencepiece", pieces),
]

#: SQL can't express the signatures, the field or the encoder; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; every stage's result is written to the shared folder."""
    folder = shared_dir(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = saved(docs, folder, f"stage-{i}")
    return docs
