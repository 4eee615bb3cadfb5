"""The queries op1_.. to op10_.. over whole tables, and the SQL of those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm.common import shared_dir, table
from palimpsest.llm.main_text import main_text
from palimpsest.llm.minhash import duplicate_report
from palimpsest.llm.pieces import encoded
from palimpsest.llm.pii import personal_data
from palimpsest.llm.quality import SQL as QUALITY_SQL
from palimpsest.llm.quality import quality_report
from palimpsest.llm.suffixes import repeated_passages
from palimpsest.llm.token_count import count_tokens
from palimpsest.llm.token_store import read_store, write_store
from palimpsest.llm.warc import round_trip
from palimpsest.llm.winnow import decontaminate


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "text", *more)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_documents(spark, sf_dir), vocabulary("word_bpe_49k.json"), limit=2048)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(_documents(spark, sf_dir), vocabulary("piece_bpe_32k.model"))


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark)
    write_store(_documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), folder, end_id=2)
    return read_store(spark, folder)


def op4_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(_documents(spark, sf_dir), table(spark, sf_dir, "benchmark", "item_id", "text"), window=13, share=20)


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_report(_documents(spark, sf_dir), k=4, percent=80)


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(_documents(spark, sf_dir))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages", "page_id", "url", "html"), shared_dir(spark), least_bytes=0)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(_documents(spark, sf_dir, "source"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op10_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(_documents(spark, sf_dir), span=50)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_token_store": op3_token_store,
    "op4_winnowing": op4_winnowing,
    "op5_minhash": op5_minhash,
    "op6_personal_data": op6_personal_data,
    "op7_warc": op7_warc,
    "op8_quality": op8_quality,
    "op9_main_text": op9_main_text,
    "op10_suffixes": op10_suffixes,
    "pipeline": pipeline,
}

ORACLE_SQL: dict[str, str] = {
    "op8_quality": QUALITY_SQL,
}
