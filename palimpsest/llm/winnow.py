"""Benchmark decontamination by winnowing.

Documents and test items keep the least k-gram hash of every window of w k-grams, with
k + w - 1 = the window length, so any shared run of that many words yields one common
fingerprint at the same place on both sides.  Fingerprints are joined, and each hit is
extended word by word to its whole run.  An item shorter than the window is one k-gram
of its own length (w = 1), so the guarantee also holds for it.

Two routes give the same rows.  While the test set is under `max_item_bytes` of text it
is packed once and read by every task, so documents are not shuffled at all.  Beyond
that the fingerprints of both sides meet in a shuffle join, and only documents with a
common fingerprint are read again.

Defined results: a null or empty text has no words (n_words 0, never contaminated); null
ids are kept as they are; items without words are left out; repeated items or rows each
count on their own; a null item_id counts and is written as an empty string; extra
columns of either table are ignored here.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import as_text, saved, shared_dir
from palimpsest.llm.textkernel import Slab, gram_hash, separators, slabs, sliding_argmin

SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
GRAM = 5


def fingerprints(words: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, word positions) kept by winnowing one text's word hashes."""
    grams = gram_hash(words, gram)
    at = np.unique(sliding_argmin(grams, window - gram + 1))
    return grams[at], at


@dataclass
class Items:
    """Packed test items: words of all, and their fingerprints sorted by hash."""

    window: int
    ids: list[str] = field(default_factory=list)
    words: np.ndarray = None
    raw: list[bytes] = field(default_factory=list)
    lo: np.ndarray = None
    prints: dict = field(default_factory=dict)  # gram length (window's own: 0) -> hashes, item, position

    @classmethod
    def pack(cls, ids: list, texts: list, window: int) -> Items:
        self = cls(window)
        found: dict[int, list] = {}
        words, lo, n = [], [0], 0
        for slab in slabs(pa.array(texts, pa.large_string()), separators("alnum"), True):
            for r in range(slab.n_rows):
                a, b = slab.word_lo[r], slab.word_lo[r + 1]
                if a == b:
                    continue
                own = slab.hash[a:b]
                k = 0 if b - a >= window else b - a
                hashes, at = fingerprints(own, window, GRAM) if not k else (gram_hash(own, k), np.zeros(1, np.int64))
                found.setdefault(k, []).append((hashes, np.full(len(at), len(self.ids)), at))
                item = ids[slab.first + r]
                self.ids.append("" if item is None else str(item))
                self.raw += [w.lower() for w in slab.words(a, b)]
                words.append(own)
                lo.append(n := n + len(own))
        self.words, self.lo = np.concatenate(words) if words else np.zeros(0, np.uint64), np.array(lo)
        for k, parts in found.items():
            h, i, p = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(h, kind="stable")
            self.prints[k] = h[order], i[order], p[order]
        return self

    def runs(self, slab: Slab, a: int, b: int) -> list[tuple[int, int, int]]:
        """(item, first word, word after the last) of every run shared with words a..b."""
        own, out, covered = slab.hash[a:b], [], {}
        for k, (hashes, items, places) in self.prints.items():
            need = k or self.window
            if len(own) < need:
                continue
            h, at = fingerprints(own, self.window, GRAM) if not k else (gram_hash(own, k), np.arange(len(own) - k + 1))
            left, right = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            for x in np.flatnonzero(right > left):
                p = int(at[x])
                for y in range(left[x], right[x]):
                    item, q = int(items[y]), int(places[y])
                    if covered.get((item, p - q), -1) > p:
                        continue
                    i0, i1 = self.lo[item], self.lo[item + 1]
                    back = min(p, q)
                    same = own[p - back : p][::-1] != self.words[i0 + q - back : i0 + q][::-1]
                    s = p - (int(same.argmax()) if same.any() else back)
                    ahead = min(len(own) - p, i1 - i0 - q)
                    same = own[p : p + ahead] != self.words[i0 + q : i0 + q + ahead]
                    e = p + (int(same.argmax()) if same.any() else ahead)
                    covered[item, p - q] = max(e, p + 1)
                    # equal by hash so far; the bytes decide
                    if e - s >= need and [w.lower() for w in slab.words(a + s, a + e)] == self.raw[i0 + q - (p - s) : i0 + q + (e - p)]:
                        out.append((item, s, e))
        return out


def _union(spans: list[tuple[int, int]]) -> int:
    total, end = 0, -1
    for s, e in sorted(spans):
        total += max(0, e - max(s, end))
        end = max(end, e)
    return total


def _row(n_words: int, hits: list[tuple[str, int, int]], n_items: int, item_ids: list[str], share: int | None) -> tuple:
    n_hit = _union([(s, e) for _, s, e in hits])
    return n_words, n_hit, n_items, hashlib.sha256(",".join(item_ids).encode()).hexdigest(), n_hit > 0 and (share is None or share * n_hit >= n_words)


def _scan(items: Items, share: int | None, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sep = separators("alnum")
        for batch in batches:
            rows = []
            for slab in slabs(batch.column("text"), sep, True):
                counts = slab.n_words
                busy = _rows_with_prints(items, slab)
                for r in range(slab.n_rows):
                    hits = items.runs(slab, slab.word_lo[r], slab.word_lo[r + 1]) if busy[r] else []
                    found = sorted({i for i, _, _ in hits})
                    rows.append(_row(int(counts[r]), [(i, s, e) for i, s, e in hits], len(found), sorted(items.ids[i] for i in found), share))
            names = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
            cols = [pa.array([x[j] for x in rows], kinds[j]) for j in range(5)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *cols], [*keep, *names])

    return run


def _rows_with_prints(items: Items, slab: Slab) -> np.ndarray:
    """Rows of the slab that keep a fingerprint of any item; whole slab at once."""
    busy = np.zeros(slab.n_rows, bool)
    row = slab.row_of_word()
    for k, (hashes, _, _) in items.prints.items():
        size = k or GRAM
        grams = gram_hash(slab.hash, size)
        if not len(grams):
            continue
        bits = np.zeros(1 << 20, bool)
        bits[hashes & np.uint64((1 << 20) - 1)] = True
        at = np.flatnonzero(bits[grams & np.uint64((1 << 20) - 1)])
        at = at[np.isin(grams[at], hashes)]
        at = at[row[at] == row[at + size - 1]]
        busy[row[at]] = True
    return busy


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 13, share: int | None = 20, max_item_bytes: int = 1 << 24) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    docs: doc_id, text; items: item_id, text.  contaminated: n_hit > 0 and share * n_hit
    >= n_words; with share None any hit counts.  max_item_bytes: above so much item text the shuffle route is taken.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_text().alias("text"))
    items = items.select(F.col("item_id").cast("string").alias("item_id"), as_text().alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if size <= max_item_bytes:
        got = items.toArrow()
        packed = docs.sparkSession.sparkContext.broadcast(Items.pack(got["item_id"].to_pylist(), got["text"].to_pylist(), window))
        return docs.mapInArrow(lambda batches: _scan(packed.value, share, ["doc_id"])(batches), SCHEMA)
    return _by_shuffle(docs, items, window, share)


def without_contaminated(docs: DataFrame, items: DataFrame, window: int = 13, share: int | None = 20, max_item_bytes: int = 1 << 24) -> DataFrame:
    """docs less the contaminated rows, columns unchanged.  Rows are judged one by one, so
    repeated or null ids don't matter."""
    size = items.agg(F.coalesce(F.sum(F.octet_length(as_text())), F.lit(0))).first()[0]
    if size > max_item_bytes:
        folder = shared_dir(docs.sparkSession)
        docs = saved(docs.withColumn("_pq_row", F.monotonically_increasing_id()), folder, "rows")
        bad = decontaminate(docs.select(F.col("_pq_row").alias("doc_id"), "text"), items, window, share, max_item_bytes).filter("contaminated")
        return docs.join(bad.select(F.col("doc_id").alias("_pq_row")), "_pq_row", "left_anti").drop("_pq_row")
    got = items.select(F.col("item_id").cast("string").alias("item_id"), as_text().alias("text")).toArrow()
    packed = docs.sparkSession.sparkContext.broadcast(Items.pack(got["item_id"].to_pylist(), got["text"].to_pylist(), window))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for judged in _scan(packed.value, share, [])([batch]):
                yield batch.filter(pc.invert(judged.column("contaminated")))

    return docs.mapInArrow(run, docs.schema)


def _prints_of(window: int, lengths: list[int], key: str):
    """(hash, key) rows of each text; lengths: those of items shorter than the window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sep = separators("alnum")
        for batch in batches:
            for slab in slabs(batch.column("text"), sep, True):
                keys = batch.column(key)
                hs, ks = [], []
                for r in range(slab.n_rows):
                    own = slab.hash[slab.word_lo[r] : slab.word_lo[r + 1]]
                    parts = [fingerprints(own, window, GRAM)[0]] if len(own) >= window else []
                    if key == "item_row":
                        parts = parts or ([gram_hash(own, len(own))] if len(own) else [])
                    else:
                        parts += [gram_hash(own, k) for k in lengths if len(own) >= k]
                    for p in parts:
                        p = np.unique(p)
                        hs.append(p.view(np.int64))
                        ks.append(np.full(len(p), keys[slab.first + r].as_py(), np.int64))
                if hs:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hs)), pa.array(np.concatenate(ks))], ["hash", key])

    return run


def _by_shuffle(docs: DataFrame, items: DataFrame, window: int, share: int | None) -> DataFrame:
    """The route for large test sets: no side is broadcast, no pair of texts is formed
    without a common fingerprint.  Rows are numbered, as ids may repeat or be null."""
    folder = shared_dir(docs.sparkSession)
    docs = saved(docs.withColumn("doc_row", F.monotonically_increasing_id()), folder, "docs")
    items = saved(items.withColumn("item_row", F.monotonically_increasing_id()), folder, "items")
    counted = items.mapInArrow(_count_words, "n int")
    lengths = sorted(r[0] for r in counted.filter((F.col("n") > 0) & (F.col("n") < window)).distinct().collect())  # under `window` values
    left = docs.mapInArrow(_prints_of(window, lengths, "doc_row"), "hash long, doc_row long")
    right = items.mapInArrow(_prints_of(window, lengths, "item_row"), "hash long, item_row long")
    pairs = left.join(right, "hash").select("doc_row", "item_row").distinct()
    found = pairs.join(items, "item_row").groupBy("doc_row").agg(F.collect_list(F.struct("item_row", "item_id", "text")).alias("items"))  # the candidates of one document; its text is sent once
    return docs.join(found, "doc_row", "left").select("doc_id", "text", "items").mapInArrow(_judged(window, share), SCHEMA)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for slab in slabs(batch.column("text"), separators("alnum"), True):
            yield pa.RecordBatch.from_arrays([pa.array(slab.n_words.astype(np.int32))], ["n"])


def _judged(window: int, share: int | None):
    """SCHEMA rows of documents (doc_id, text, items): each is scanned for its own candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sep, packed = separators("alnum"), {}
        for batch in batches:
            for slab in slabs(batch.column("text"), sep, True):
                rows, counts = [], slab.n_words
                for r in range(slab.n_rows):
                    own = batch.column("items")[slab.first + r].as_py()
                    if not own:
                        rows.append(_row(int(counts[r]), [], 0, [], share))
                        continue
                    own = {x["item_row"]: (x["item_id"], x["text"]) for x in sorted(own, key=lambda x: x["item_row"])}
                    key = tuple(own)
                    if key not in packed:
                        if len(packed) >= 64:
                            packed.clear()
                        packed[key] = Items.pack(*map(list, zip(*own.values(), strict=True)), window)
                    items = packed[key]
                    hits = items.runs(slab, slab.word_lo[r], slab.word_lo[r + 1])
                    found = sorted({i for i, _, _ in hits})
                    rows.append(_row(int(counts[r]), hits, len(found), sorted(items.ids[i] for i in found), share))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
                cols = [pa.array([x[j] for x in rows], kinds[j]) for j in range(5)]
                ids = batch.column("doc_id")[slab.first : slab.first + slab.n_rows]
                yield pa.RecordBatch.from_arrays([ids, *cols], [x.split()[0] for x in SCHEMA.split(", ")])

    return run
