"""Measures of pairs of texts that stand in one row."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa

from palimpsest.functions.edit import similarity, words

MEASURED = "accession string, section string, cosine double, jaccard double, words long, prev_words long, edit double"


def bags(before: list[str], now: list[str]) -> tuple[float | None, float | None]:
    """Cosine of word counts and Jaccard of word sets; None if either side is empty."""
    if not before or not now:
        return None, None
    a, b = Counter(now), Counter(before)
    common = a.keys() & b.keys()
    dot = sum(a[t] * b[t] for t in common)
    aa, bb = (sum(n * n for n in x.values()) for x in (a, b))
    return dot / (math.sqrt(aa) * math.sqrt(bb)), len(common) / (len(a) + len(b) - len(common))


def measured(with_bags: bool, with_edit: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """MEASURED rows of batches (accession, section, prev_text, text); what is not asked for is
    null.  Beside the batch one pair of texts is in memory."""

    def one(before: pa.StringScalar, now: pa.StringScalar) -> tuple:
        a, b = words(before.as_py()), words(now.as_py())
        return *(bags(a, b) if with_bags else (None, None)), len(b), len(a), similarity(a, b) if with_edit else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.float64()]
        for batch in batches:
            rows = list(map(one, batch.column("prev_text"), batch.column("text")))
            cols = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("accession"), batch.column("section"), *cols], [c.split()[0] for c in MEASURED.split(", ")])

    return run
