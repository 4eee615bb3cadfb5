"""Word expressions: tokens for similarity, word counts for quality gates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed patterns: tokens compare language and leave figures out; counts take raw text.
TOKEN = "[a-z]{2,}"
WORD = "[A-Za-z]{2,}"

#: Characters that vanish, characters that become a space.
ZERO_WIDTH = "\u200b\u200c\u200d\ufeff\u00ad"
SPACES = "\u00a0" + "".join(map(chr, range(0x2002, 0x200B))) + "\u202f\u3000"
#: Fixed patterns of page furniture, matched on whole lines.
NOISE_LINE = r"(?i)^(?:-?\s*\d{1,3}\s*-?|page\s+\d{1,3}(?:\s+of\s+\d+)?|table\s+of\s+contents)$"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def normalized_lines(text: Column) -> Column:
    """Array of trimmed, single-spaced lines without page furniture."""
    clean = F.translate(F.translate(text, SPACES, " " * len(SPACES)), ZERO_WIDTH, "")
    lines = F.split(F.replace(clean, F.lit("\r"), F.lit("\n")), "\n")
    # strip() of the other engine takes every Unicode white space, hence (?U)
    trimmed = F.transform(lines, lambda x: F.regexp_replace(F.regexp_replace(x, r"[ \t\f\x0B]+", " "), r"(?U)^\s+|\s+$", ""))
    return F.filter(trimmed, lambda x: (x != "") & ~x.rlike(NOISE_LINE))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two token arrays as sets; null if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / F.size(F.array_union(a, b)))
