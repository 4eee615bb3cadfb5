"""Passages, their embeddings, and how well each has a counterpart in the edition before."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from palimpsest.functions.batches import sized_slices
from palimpsest.functions.filing_text import passages
from palimpsest.schemas import PASSAGES

#: Fixed values.
NOVEL_BELOW, TOP_CHANGES, PASSAGE_CHARS = 0.60, 3, 700
DIMENSIONS = 64


#: Characters of text whose passages are in memory at a time.
SLICE = 1 << 21


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, texts in sized_slices(batch.column("text"), SLICE):
            found = [passages(t or "") for t in texts]
            of = pa.array(np.repeat(np.arange(first, first + len(texts)), [len(f) for f in found]))
            each = [p for f in found for p in f]
            cols = [batch.column("accession").take(of), batch.column("section").take(of), pa.array([i for f in found for i in range(len(f))], pa.int32()), pa.array([p.count(" ") + 1 for p in each], pa.int32()), pa.array(each, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["accession", "section", "passage_no", "words", "passage"])


def split_passages(texts: DataFrame) -> DataFrame:
    """PASSAGES rows of texts (accession, section, text)."""
    return texts.select("accession", "section", "text").mapInArrow(_split, PASSAGES)


def hashed_words(batch: list[str]) -> np.ndarray:
    """The default encoder: signed hashed bags of words, unit length.  Deterministic."""
    out = np.zeros((len(batch), DIMENSIONS), np.float32)
    for i, text in enumerate(batch):
        for w in text.lower().split():
            h = zlib.crc32(w.encode())
            out[i, h % DIMENSIONS] += 1 if h >> 16 & 1 else -1
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm == 0, 1, norm)


def _encoder(encode: Callable[[list[str]], np.ndarray], size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), size):
                part = batch.slice(a, size)
                vectors = encode(part.column("passage").to_pylist()).astype(np.float16).astype(np.float32)
                column = pa.array(list(vectors), pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([*part.columns, column], [*part.schema.names, "embedding"])

    return run


def embed(pieces: DataFrame, encode: Callable[[list[str]], np.ndarray] = hashed_words, size: int = 64) -> DataFrame:
    """pieces (PASSAGES) with an embedding, encoded `size` at a time; half precision is kept
    as the reference store does."""
    return pieces.select("accession", "section", "passage_no", "words", "passage").mapInArrow(_encoder(encode, size), PASSAGES + ", embedding array<float>")


def embedded_passages(texts: DataFrame, encode: Callable[[list[str]], np.ndarray] = hashed_words, size: int = 64) -> DataFrame:
    """embed() of split_passages() in one Python worker a task, where two would stand in a row."""
    run = _encoder(encode, size)
    return texts.select("accession", "section", "text").mapInArrow(lambda batches: run(_split(batches)), PASSAGES + ", embedding array<float>")


def cached_embeddings(pieces: DataFrame, cache: str, encode: Callable[[list[str]], np.ndarray] = hashed_words) -> DataFrame:
    """embed(), but passages of sections that the cache folder has are taken from it.

    The cache is keyed by (accession, section) and counts if it has as many passages as the
    section has now; sections it lacks are encoded, appended in one generation more, and
    the youngest generation of a section is read.
    """
    spark, keys = pieces.sparkSession, ["accession", "section"]
    schema = PASSAGES + ", embedding array<float>, generation int"

    def stored() -> DataFrame:
        try:
            rows = spark.read.schema(schema).parquet(cache)
        except AnalysisException as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            rows = spark.createDataFrame([], schema)
        last = rows.groupBy(*keys).agg(F.max("generation").alias("generation"))
        return rows.join(last, [*keys, "generation"], "left_semi")

    there, now = (df.groupBy(*keys).agg(F.count("*").alias("n")) for df in (stored(), pieces))
    fresh = pieces.join(now.join(there, [*keys, "n"], "left_anti"), keys, "left_semi")
    generation = stored().agg(F.coalesce(F.max("generation"), F.lit(0))).first()[0] + 1
    embed(fresh, encode).withColumn("generation", F.lit(generation)).write.mode("append").parquet(cache, compression="zstd")
    return stored().join(now.select(*keys), keys, "left_semi").drop("generation")


def _vectors(column: pa.Array) -> np.ndarray:
    """An array column of equally long vectors as a matrix of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _best_of_pair(now: pa.Table, before: pa.Table) -> pa.Table:
    if not len(now) or not len(before):
        return now.drop_columns(["embedding"]).slice(0, 0).append_column("match_score", pa.array([], pa.float64()))
    other = _vectors(before.column("other").combine_chunks())
    mine = _vectors(now.column("embedding").combine_chunks())
    best = np.concatenate([(mine[a : a + 1024] @ other.T).max(axis=1) for a in range(0, len(mine), 1024)])
    return now.drop_columns(["embedding"]).append_column("match_score", pa.array(best))


def best_match(now: DataFrame, before: DataFrame, keys: list[str]) -> DataFrame:
    """Each passage of `now` (keys, passage_no, words, embedding) with its best cosine among
    the passages of `before` (keys, embedding) under the same keys; without any there it has
    no row.

    The keys name a pair of editions, so both sides of a key are of one document's length;
    a pair is one matrix product, and no row a pair of passages is made.
    """
    now = now.select(*keys, "passage_no", "words", "embedding")
    named = [f"of_{k}" for k in keys]  # both sides may come from one table
    other = before.select(*[F.col(k).alias(n) for k, n in zip(keys, named, strict=True)], F.col("embedding").alias("other"))
    schema = StructType([*now.drop("embedding").schema.fields, StructField("match_score", DoubleType())])
    return now.groupBy(*keys).cogroup(other.groupBy(*named)).applyInArrow(_best_of_pair, schema)


def semantic_scores(best: DataFrame, keys: list[str]) -> DataFrame:
    """keys, semantic (mean best match by words) and novel_share (words with a match under 0.60)."""
    w = F.col("words").cast("double")
    novel = F.sum(F.when(F.col("match_score") < NOVEL_BELOW, w).otherwise(0.0))
    return best.groupBy(*keys).agg((F.sum(F.col("match_score") * w) / F.sum(w)).alias("semantic"), (novel / F.sum(w)).alias("novel_share"))


def top_changes(best: DataFrame, keys: list[str], k: int = TOP_CHANGES) -> DataFrame:
    """The k passages of each pair with the weakest match; ties by passage_no."""
    order = Window.partitionBy(*keys).orderBy("match_score", "passage_no")
    return best.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k)


def semantic_panel(panel: DataFrame, texts: DataFrame, encode: Callable[[list[str]], np.ndarray] = hashed_words, sections: tuple[str, ...] = ("item1a", "item7"), cache: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(scores, changes) of the pairs of a similarity panel.

    scores: accession, section, semantic, novel_share - only where the section's cosine is
    known; a table of its own, joined to the panel when needed.  changes: the passages
    behind them, cut to 700 characters.  cache: a folder for cached_embeddings().
    """
    keys = ["accession", "section"]
    rated = panel.select("cik", "ticker", "accession", "prev_accession", "filing_date", F.explode(F.array(*[F.struct(F.lit(s).alias("section"), F.col(f"{s}_cosine").alias("cosine")) for s in sections])).alias("s"))
    rated = rated.filter("s.cosine is not null").select("cik", "ticker", "accession", "prev_accession", "filing_date", F.col("s.section").alias("section"))
    chosen = texts.filter(F.col("section").isin(*sections))
    pieces = split_passages(chosen)
    vectors = cached_embeddings(pieces, cache, encode) if cache else embedded_passages(chosen, encode)
    now = vectors.join(rated.select("accession", "section"), keys, "left_semi")
    before = vectors.withColumnRenamed("accession", "prev_accession").join(rated.select("accession", "prev_accession", "section"), ["prev_accession", "section"])
    best = best_match(now, before, keys)
    changes = top_changes(best, keys).join(pieces.select(*keys, "passage_no", "passage"), [*keys, "passage_no"]).join(rated, keys)
    changes = changes.select("cik", "ticker", "accession", "filing_date", "section", "match_score", F.substring("passage", 1, PASSAGE_CHARS).alias("passage"))
    return semantic_scores(best, keys), changes
