"""Token counts by overlap resynchronisation.

A text over `chunk_chars` is encoded in overlapping chunks with offsets.  Neighbouring
chunks are spliced at a boundary that both encodings share and that is proven stable: a
white-space character at which this pre-tokeniser always restarts, followed by tokens
that agree in id and offset up to the next such character.  Where the overlap holds none,
it is widened until it does, in the end to the whole of both chunks.  What is held at a
time is a chunk or two, however long the text.

A text of one chunk is encoded as units that start at a space or line feed, or at an ASCII
mark after a letter.  The pre-tokeniser drops white space, matches nothing across it and
nothing that goes on from a letter or digit to a mark; normalisation composes nothing with
a space or with such a mark as the second; so the library's tokens of the units in turn are
its tokens of the text.  Texts where a special string may stand are encoded whole.  A
worker encodes a unit once while it remembers it.

Defined results: null or empty text: 0 bytes, 0 tokens; repeated rows and null ids are
kept as they are; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import as_text
from palimpsest.llm.units import AT_ONCE, PackedUnits, ascii_set, unit_slabs

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
BREAKS = " \n"


@lru_cache(2)
def tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class _Chunk:
    """The encoding of text[a:b]; places are those of the text."""

    def __init__(self, tok, text: str, a: int, b: int) -> None:
        self.a, self.b, self.got = a, b, tok.encode(text[a:b], add_special_tokens=False)
        self.ids = self.got.ids

    def word(self, x: int, y: int) -> tuple[int, list[tuple[int, int, int]]] | None:
        """The first token at or after the white space x, if it starts at x + 1, and from it
        on the (start, end, id) of those that end by y, the next white space."""
        i = self.got.char_to_token(x + 1 - self.a)
        if i is None or i and self.got.token_to_chars(i - 1)[1] + self.a > x:
            return None
        found = []
        for k in range(i, len(self.ids)):
            s, e = self.got.token_to_chars(k)
            if e + self.a > y:
                break
            found.append((s + self.a, e + self.a, self.ids[k]))
        return (i, found) if found and found[0][0] == x + 1 else None


def _boundary(text: str, left: _Chunk, right: _Chunk, breaks: str) -> tuple[int, int, int] | None:
    """(place, token of left, token of right) of a proven common boundary in the overlap."""
    at = [x for x in range(right.a + 1, left.b - 1) if text[x] in breaks]
    for x, y in zip(at, at[1:], strict=False):
        mine = left.word(x, y) if y > x + 1 else None
        theirs = right.word(x, y) if mine else None
        if theirs and mine[1] == theirs[1]:
            return x, mine[0], theirs[0]
    return None


def resynchronised(tok, text: str, size: int, overlap: int, breaks: str = BREAKS) -> list[int]:
    """Ids of a text of any length, encoded in chunks of `size` characters or more."""
    ids: list[int] = []
    left, first, a = _Chunk(tok, text, 0, min(size, len(text))), 0, 0  # its tokens from `first` on, which start after a, are not taken yet
    while left.b < len(text):
        back = min(overlap, size // 2)
        while True:
            c = max(a, left.b - back)
            right = _Chunk(tok, text, c, min(len(text), c + max(size, 2 * back)))
            if c == a:  # widened to all of the left chunk that is not taken
                left, first = right, 0
                break
            if (found := _boundary(text, left, right, breaks)) is not None:
                ids += left.ids[first : found[1]]
                left, first, a = right, found[2], found[0]
                break
            back *= 2
    return ids + left.ids[first:]


@lru_cache(1)
def _units(path: str) -> PackedUnits:
    """Of a Python worker, for all its tasks: how many tokens a unit has."""
    tok = tokenizer(path)

    def encode(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        n = [len(x) for i in range(0, len(units), AT_ONCE) for x in tok.encode_batch_fast(units[i : i + AT_ONCE], add_special_tokens=False)]
        return np.array(n, np.uint32), np.ones(len(n), np.int64)

    return PackedUnits(encode, np.uint32)


def _counts(tok, column: pa.Array, cache: PackedUnits) -> np.ndarray:
    """Tokens of each text, by its units."""
    n = np.zeros(len(column), np.int64)
    for slab in unit_slabs(column, ascii_set(BREAKS), cut_marks=True):
        counts, _, _, which = cache.of(slab)
        sums = np.concatenate([[0], np.cumsum(counts[which], dtype=np.int64)])
        n[slab.first : slab.first + slab.n_rows] = np.diff(sums[slab.lo])
        special = np.flatnonzero((slab.data[:-1] == ord("<")) & (slab.data[1:] == ord("|")))
        for r in set((np.searchsorted(slab.offsets, special, side="right") - 1).tolist()):
            n[slab.first + r] = len(tok.encode(slab.row(r).decode(), add_special_tokens=False))
    return n


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, chunk_chars: int = 4_000, overlap: int = 200) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, over_limit; path: a tokenizers .json file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, cache = tokenizer(path), _units(path)
        for batch in batches:
            texts = batch.column("text")
            long = pc.greater(pc.utf8_length(texts), chunk_chars)
            n = _counts(tok, pc.if_else(long, pa.scalar("", texts.type), texts), cache)
            for r in np.flatnonzero(long.to_numpy(zero_copy_only=False)).tolist():
                n[r] = len(resynchronised(tok, texts[r].as_py(), chunk_chars, overlap))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pc.binary_length(texts).cast(pa.int64()), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_text().alias("text")).mapInArrow(run, SCHEMA)
