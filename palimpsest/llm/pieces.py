"""SentencePiece encoding and decoding for merge-type vocabularies.

The encoder keeps an agenda of adjacent symbol pairs ordered by piece score, then by
place; it pops the best pair, skips it if either symbol has changed since, merges it and
posts the two new pairs.  What no piece covers falls back to bytes.  Its ids are what is
returned.

Texts are taken as units that start where a space follows another character.  That is
exact when no piece holds the space mark after another character, which is verified on
the vocabulary when it is loaded; a text with the mark itself is one unit.  A unit met lately
is not encoded again; each new one is encoded and, with the others of its Arrow batch that are new, checked
against the sentencepiece library; where they differ the library's ids are taken.  A unit
begins with a space piece, never a byte piece, so decoding unit by unit is decoding the
whole.

Defined results: null or empty text: no ids, empty decoded text; repeated rows and null
ids are kept as they are; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import as_text
from palimpsest.llm.units import UnitCache, ascii_set, unit_slabs

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_corrected long"
MARK = "▁"
CHECKED_TOGETHER = 16_384


class Pieces:
    """A merge-type vocabulary: ranks of its pieces by score, ids, byte pieces."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        usable = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {sp.id_to_piece(i): i for i in usable}
        order = {s: r for r, s in enumerate(sorted({-sp.get_score(i) for i in usable}))}
        self.rank = {sp.id_to_piece(i): order[-sp.get_score(i)] for i in usable}
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.unknown = sp.unk_id()
        self.byte_fallback = sp.is_byte(self.bytes[0])
        kept = sp.decode(sp.encode("a  b ")) == "a  b "
        self.splits = kept and all(MARK not in p.lstrip(MARK) for p in self.ids)

    def encode(self, text: str) -> list[int]:
        """Ids of marked text (spaces already replaced, dummy prefix set)."""
        symbols: list[str | None] = list(text)
        n, rank = len(symbols), self.rank.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = []
        for i in range(n - 1):
            pair = symbols[i] + symbols[i + 1]
            if (r := rank(pair)) is not None:
                agenda.append((r, i, pair))
        heapify(agenda)
        while agenda:
            _, i, pair = heappop(agenda)
            left = symbols[i]
            if left is None or (j := after[i]) >= n or left + symbols[j] != pair:
                continue
            symbols[i], symbols[j] = pair, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank(both := pair + symbols[k])) is not None:
                    heappush(agenda, (r, i, both))
            if (h := before[i]) >= 0 and (r := rank(both := symbols[h] + pair)) is not None:
                heappush(agenda, (r, h, both))
        ids: list[int] = []
        for s in symbols:
            if s is not None:
                if (i := self.ids.get(s)) is not None:
                    ids.append(i)
                elif self.byte_fallback:
                    ids += [self.bytes[b] for b in s.encode()]
                elif not ids or ids[-1] != self.unknown:
                    ids.append(self.unknown)
        return ids

    def checked(self, texts: list[str]) -> tuple[list[list[int]], list[bool]]:
        """Ids of plain texts; which ones the library had to correct."""
        own = [self.encode(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        theirs = self.library.encode(texts, num_threads=1)
        if own == theirs:
            return own, [False] * len(own)
        wrong = [a != b for a, b in zip(own, theirs, strict=True)]
        return [b if w else a for a, b, w in zip(own, theirs, wrong, strict=True)], wrong


@lru_cache(2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _unit_encoder(model: Pieces):
    def encode(units: list[bytes], heads: list[bool]) -> list:
        """Of each unit its ids as text; with what it decodes to and whether the agenda was
        wrong, where that is anything but its own text and no."""
        out = []
        for a in range(0, len(units), CHECKED_TOGETHER):
            part, head = units[a : a + CHECKED_TOGETHER], heads[a : a + CHECKED_TOGETHER]
            plain = [u.decode() if h else u[1:].decode() for u, h in zip(part, head, strict=True)]
            ids, wrong = model.checked(plain)
            # one space that ends a text: the library drops an empty input, the agenda doesn't
            ids = [x if t or h else model.encode(MARK) for x, t, h in zip(ids, plain, head, strict=True)]
            for x, back, t, h, w in zip(ids, model.library.decode(ids), plain, head, wrong, strict=True):
                csv = ",".join(map(str, x))
                out.append(csv if back == t and not w else (csv, back if h else " " + back, w))
        return out

    return encode


@lru_cache(1)
def _units(path: str) -> UnitCache:
    """Of a Python worker, for all its tasks: some 100 MB at most."""
    return UnitCache(_unit_encoder(pieces(path)), limit=200_000)


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256, and n_corrected, the
    units whose ids the library had to correct."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, cache, sep = pieces(path), _units(path), ascii_set(" ")
        for batch in batches:
            ids = batch.column("doc_id")
            for slab in unit_slabs(batch.column("text"), sep, mark_first=True):
                rows = []
                payload, which = cache.of(slab)
                which = which.tolist()
                csv = [x if type(x) is str else x[0] for x in payload]
                odd = {i: x for i, x in enumerate(payload) if type(x) is not str}
                marked = MARK.encode() in slab.raw
                for r in range(slab.n_rows):
                    own = which[slab.lo[r] : slab.lo[r + 1]]
                    raw = slab.row(r)
                    corrected = 0
                    if not model.splits or marked and MARK.encode() in raw:
                        (got,), (bad,) = model.checked([raw.decode()])
                        text, back, corrected = ",".join(map(str, got)), model.library.decode(got).encode(), int(bad)
                    else:
                        text, back = ",".join([csv[i] for i in own]), raw
                        if odd and not odd.keys().isdisjoint(own):
                            parts = zip(own, slab.start[slab.lo[r] : slab.lo[r + 1]].tolist(), slab.end[slab.lo[r] : slab.lo[r + 1]].tolist(), strict=True)
                            back = b"".join([odd[i][1].encode() if i in odd else slab.raw[s:e] for i, s, e in parts])
                            corrected = sum([odd[i][2] for i in own if i in odd])
                    rows.append((text.count(",") + 1 if text else 0, hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(back).hexdigest(), corrected))
                cols = [pa.array([x[j] for x in rows], k) for j, k in enumerate((pa.int64(), pa.string(), pa.string(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([ids[slab.first : slab.first + slab.n_rows], *cols], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_corrected"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_text().alias("text")).mapInArrow(run, SCHEMA)
