"""Repeated passages by a sparse suffix array over words.

1. Of each text only the suffixes at minimiser positions are retained: where the hash of
   `GRAM` words is least in some window of `SPREAD` positions.  Any passage of `span`
   words has its first minimiser at most SPREAD - 1 words in, and equal passages have it
   at the same place; from there at least span - SPREAD + 1 words of it follow.
2. Suffixes are sorted, by so many of their words (as a 64-bit key), over the cluster by
   ranges of (key, row): a passage in a third of all documents spreads over many tasks.
   Neighbours are compared as they stream by; suffixes that share their key with another
   document's stay.  Runs cut by a range border are settled by key afterwards.
3. From each suffix that stays the match is extended left and right, word by word, against
   all its partners at once: a passage of `span` words that begins d words left of the
   suffix ends span - d words right of its start, and each such extension is hashed (by two
   families, 128 bits) and counted over documents, combining before the shuffle.  Those in
   two or more documents are repeats, and their union in a document is the set of its
   maximal repeated spans.  Comparing with sort neighbours alone would lose spans whose
   longest partner to the left is not next in order.

Defined results: words are runs of anything but ASCII white space, compared by bytes;
null, empty and short texts have no passage and give no row; a passage repeated inside
one document only is no repeat; repeated rows count as documents of their own; the first
holder of a passage is that of smallest doc_id (nulls last), of equal texts one row only.

Equal texts are one text to the steps above: they repeat as a whole, and only the first of
them takes part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import as_text, dropped, saved, shared_dir
from palimpsest.llm.textkernel import gram_hash, separators, slabs, sliding_argmin, span_hash

GRAM, SPREAD = 5, 28
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28
WORD = r"[^\x20\x09-\x0D]+"


def anchors(words: np.ndarray, span: int) -> np.ndarray:
    """For each passage of `span` words of a text, the position of its first minimiser window's least gram."""
    return sliding_argmin(gram_hash(words, GRAM), SPREAD)[: max(0, len(words) - span + 1)]


def _suffixes(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sep = separators("space")
        for batch in batches:
            rows = batch.column("row").to_numpy()
            for slab in slabs(batch.column("text"), sep, False):
                prefix = gram_hash(slab.hash, span - SPREAD + 1)
                at, of = [], []
                for r in np.flatnonzero(slab.n_words >= span):
                    a, b = slab.word_lo[r], slab.word_lo[r + 1]
                    p = np.unique(anchors(slab.hash[a:b], span))
                    at.append(p + a)
                    of.append(np.full(len(p), r))
                if at:
                    at, of = np.concatenate(at), np.concatenate(of)
                    yield pa.RecordBatch.from_arrays([pa.array(prefix[at].view(np.int64)), pa.array(rows[slab.first + of]), pa.array((at - slab.word_lo[of]).astype(np.int32))], ["key", "row", "pos"])

    return run


def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted (key, row, pos), those whose key another row has next to it; edge: those
    of the partition's first and last key, if their one row may have company elsewhere."""
    held = None  # the rows of the current key, while all are of one row
    known = None  # the current key, once two rows have it
    first_key = None

    def out(key, row, pos, edge):
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(row), pa.array(pos), pa.array(np.full(len(key), edge))], ["key", "row", "pos", "edge"])

    for batch in batches:
        key, row, pos = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "row", "pos"))
        if not len(key):
            continue
        if first_key is None:
            first_key = key[0]
        if held is not None:
            key, row, pos = (np.concatenate([x, y]) for x, y in zip(held, (key, row, pos), strict=True))
            held = None
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(start, len(key)))
        shared = np.maximum.reduceat(row, start) != np.minimum.reduceat(row, start)
        if known is not None and key[0] == known:
            shared[0] = True
        known = key[-1] if shared[-1] else None
        keep = np.repeat(shared, size)
        if keep.any():
            yield out(key[keep], row[keep], pos[keep], False)
        if not shared[0] and key[0] == first_key and len(start) > 1:
            n = size[0]
            yield out(key[:n], row[:n], pos[:n], True)
        if not shared[-1]:
            held = key[start[-1] :], row[start[-1] :], pos[start[-1] :]
    if held is not None:
        yield out(*held, True)


def _passages(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sep = separators("space")
        for batch in batches:
            rows, kept = batch.column("row").to_numpy(), batch.column("kept")
            for slab in slabs(batch.column("text"), sep, False):
                first, second = gram_hash(slab.hash, span), gram_hash(span_hash(slab.data, slab.start, slab.end, second=True), span)
                parts = []
                for r in range(slab.n_rows):
                    a, b = slab.word_lo[r], slab.word_lo[r + 1]
                    s = np.flatnonzero(np.isin(anchors(slab.hash[a:b], span), kept[slab.first + r].values.to_numpy()))
                    parts.append((np.full(len(s), slab.first + r), s, first[a + s].view(np.int64), second[a + s].view(np.int64)))
                of, s, h, g = (np.concatenate(x) for x in zip(*parts, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(rows[of]), batch.column("doc_id").take(pa.array(of)), pa.array(s.astype(np.int32)), pa.array(h), pa.array(g)], ["row", "doc_id", "s", "h", "g"])

    return run


def _merged(starts: np.ndarray, span: int) -> list[tuple[int, int]]:
    if not len(starts):
        return []
    starts = np.sort(starts)
    cut = np.flatnonzero(np.diff(starts) > span)
    return list(zip(starts[np.concatenate([[0], cut + 1])].tolist(), (starts[np.append(cut, len(starts) - 1)] + span).tolist(), strict=True))


def _spans(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        write = lambda spans: ",".join(f"{a}:{b}" for a, b in spans)
        for batch in batches:
            rows = []
            for hits in batch.column("hits"):
                s, later = hits.values.field("s").to_numpy(), hits.values.field("later").to_numpy(zero_copy_only=False)
                every, cut = _merged(s, span), _merged(s[later], span)
                rows.append((sum(b - a for a, b in every), write(every), sum(b - a for a, b in cut), write(cut)))
            cols = [pa.array([x[j] for x in rows], k) for j, k in enumerate((pa.int64(), pa.string(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *cols], ["row", "n_repeated", "spans", "n_later", "later_spans"])

    return run


def _marks(rows: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of hashed row numbers, `bits` long."""
    bit = F.pmod(F.xxhash64("row"), F.lit(bits)).alias("bit")
    parts = rows.select(bit).groupBy(F.bitmap_bucket_number("bit").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    whole = np.zeros(bits // 8 + (1 << 12), np.uint8)
    for part, found in parts.toLocalIterator():  # bits / 32,768 + 1 rows of 4 KB
        whole[part * 4096 : part * 4096 + 4096] |= np.frombuffer(found, np.uint8)
    return whole


def _marked(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """docs less most of those whose row is not among rows, before they are shuffled.

    The bitmap has eight bits a row, but MOST_BITS (32 MB) at most: beyond some 50 million
    rows it lets more and more through, which costs shuffle and changes no result.
    """
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (8 * rows.count()).bit_length()))
    marks = docs.sparkSession.sparkContext.broadcast(_marks(rows, bits))
    at = docs.withColumn("bit", F.pmod(F.xxhash64("row"), F.lit(bits)))
    at = at.withColumn("part", F.bitmap_bucket_number("bit")).withColumn("place", F.bitmap_bit_position("bit")).drop("bit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, place = batch.column("part").to_numpy(), batch.column("place").to_numpy()
            hit = marks.value[part * 4096 + (place >> 3)] >> (place & 7).astype(np.uint8) & 1
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(hit.astype(bool))) for c in batch.columns[:-2]], batch.schema.names[:-2])

    return at.mapInArrow(run, docs.schema)


def repeated_passages(docs: DataFrame, span: int = 50) -> DataFrame:
    """One row for each document that shares a passage of `span` words or more.

    doc_id, n_words; n_repeated and spans: words in such passages and the maximal spans
    as start:end of words, end exclusive; n_later and later_spans: the same for passages
    whose first holder is another document, which deduplication may cut.
    """
    if span < SPREAD + GRAM - 1:
        raise ValueError(f"span must be at least {SPREAD + GRAM - 1}")
    folder = shared_dir(docs.sparkSession)
    text = as_text()
    docs = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.md5(text).alias("md5"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_words"))
    docs = saved(docs, folder, "rows")  # numbers that no later step draws anew
    lead = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "row"))
    equal = docs.filter(F.col("n_words") >= span).groupBy("md5", "n_words").agg(lead.alias("lead"), F.count("*").alias("copies")).filter("copies > 1")
    equal = saved(equal.select("md5", "n_words", F.col("lead.row").alias("first")), folder, "repeated")
    equal = docs.select("row", "md5", "n_words").join(equal, ["md5", "n_words"])
    equal = saved(equal.select("row", (F.col("row") == F.col("first")).alias("is_first")), folder, "equal")
    sparse = saved(docs.select("row", "text").mapInArrow(_suffixes(span), "key long, row long, pos int"), folder, "suffixes")
    sparse = sparse.join(equal.filter("not is_first").select("row"), "row", "left_anti")
    ordered = sparse.repartitionByRange("key", "row").sortWithinPartitions("key", "row", "pos").select("key", "row", "pos")
    near = saved(ordered.mapInArrow(neighbours, "key long, row long, pos int, edge boolean"), folder, "near")
    dropped(docs.sparkSession, folder, "suffixes")
    edge = near.filter("edge")
    settled = near.groupBy("key").agg(F.min("row").alias("a"), F.max("row").alias("b")).filter("a < b").join(edge.select("key").distinct(), "key", "left_semi")
    stay = near.filter("not edge").select("row", "pos").union(edge.join(settled, "key", "left_semi").select("row", "pos"))
    kept = saved(stay.groupBy("row").agg(F.sort_array(F.collect_set("pos")).alias("kept")), folder, "kept")  # of one document
    dropped(docs.sparkSession, folder, "near")
    texts = _marked(docs.select("row", "doc_id", "text"), kept.select("row"))
    passages = saved(texts.join(kept, "row").mapInArrow(_passages(span), "row long, doc_id long, s int, h long, g long"), folder, "passages")
    shared = passages.groupBy("h", "g").agg(F.min("row").alias("a"), F.max("row").alias("b"), F.min("doc_id").alias("first")).filter("a < b")
    shared = saved(shared.select("h", "g", "first"), folder, "shared")  # so that a passage in a third of all documents can be split below
    hits = passages.join(shared, ["h", "g"]).select("row", F.struct("s", (~F.col("doc_id").eqNullSafe(F.col("first"))).alias("later")).alias("hit"))
    spans = hits.groupBy("row").agg(F.collect_list("hit").alias("hits")).mapInArrow(_spans(span), "row long, n_repeated long, spans string, n_later long, later_spans string")  # of one document
    found = spans.join(equal, "row", "full_outer").join(docs.select("row", "doc_id", "n_words"), "row")
    whole, later = F.col("is_first").isNotNull(), F.coalesce(~F.col("is_first"), F.lit(False))
    every = F.concat(F.lit("0:"), F.col("n_words"))
    return found.select(
        "doc_id", "n_words", F.when(whole, F.col("n_words")).otherwise(F.col("n_repeated")).alias("n_repeated"), F.when(whole, every).otherwise(F.col("spans")).alias("spans"),
        F.when(later, F.col("n_words")).otherwise(F.coalesce("n_later", F.lit(0))).alias("n_later"), F.when(later, every).otherwise(F.coalesce("later_spans", F.lit(""))).alias("later_spans"),
    )
