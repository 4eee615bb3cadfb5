"""Word-level edit similarity: bit-parallel Levenshtein distance on big integers.

The row of the dynamic-programming table is kept as two bit vectors of vertical
differences, so a step per word of one text updates all words of the other at once.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from palimpsest.functions.words import TOKEN

_TOKEN = re.compile(TOKEN)


def distance(a: list, b: list) -> int:
    """Levenshtein distance of two sequences, unit costs."""
    first = 0  # shared ends don't matter
    while first < min(len(a), len(b)) and a[first] == b[first]:
        first += 1
    last = 0
    while last < min(len(a), len(b)) - first and a[-1 - last] == b[-1 - last]:
        last += 1
    a, b = a[first : len(a) - last], b[first : len(b) - last]
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    places: dict = {}
    for i, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << i
    full, top = (1 << len(b)) - 1, 1 << (len(b) - 1)
    plus, minus, score = full, 0, len(b)
    for x in a:
        equal = places.get(x, 0)
        diagonal = (((equal & plus) + plus) ^ plus) | equal | minus
        up = minus | ~(diagonal | plus) & full
        down = plus & diagonal
        score += bool(up & top) - bool(down & top)
        up = (up << 1 | 1) & full
        down = down << 1 & full
        plus = down | ~(diagonal | up) & full
        minus = up & diagonal
    return score


def similarity(a: list, b: list) -> float | None:
    """1 - distance / longer length; None if either is empty."""
    return 1 - distance(a, b) / max(len(a), len(b)) if a and b else None


def words(text: str | None) -> list[str]:
    """Tokens of a text, as functions.words.tokens has them."""
    return _TOKEN.findall(text.lower()) if text else []


@pandas_udf(DoubleType())
def edit_similarity(before: pd.Series, now: pd.Series) -> pd.Series:
    """Of two text columns."""
    return pd.Series([similarity(words(a), words(b)) for a, b in zip(before, now, strict=True)], dtype="float64")
