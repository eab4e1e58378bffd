"""Text columns: cleaning, keys, keyword tests."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F



def _folded() -> tuple[str, str]:
    """Characters that decompose to one other character and marks, and that character of each."""
    found = []
    for c in map(chr, (*range(0xA0, 0x2000), *range(0xFF00, 0xFFF0))):  # alphabets, forms of other width
        plain = [x for x in unicodedata.normalize("NFKD", c) if not unicodedata.category(x).startswith("M")]
        if c.isalnum() and len(plain) == 1 and plain[0] != c:
            found.append((c, plain[0]))
    return "".join(c for c, _ in found), "".join(p for _, p in found)


ACCENTED, PLAIN = _folded()
#: Characters that stand for plainer ones, and those that only take up width.
FANCY, SIMPLE = "“”„‘’‚–—−•●▪·… ", "\"\"\"'''---****. "
ZERO_WIDTH = "\u200b\u200c\u200d\ufeff\u00ad"


def fold(c: Column) -> Column:
    """Letters and digits of any script without accents and other marks; variants of width and form
    as the plain character. What decomposes to several letters (ligatures, Hangul) stays."""
    return F.regexp_replace(F.translate(c, ACCENTED, PLAIN), r"\p{M}+", "")


def spaced(c: Column) -> Column:
    """Runs of spaces as one space, trimmed."""
    return F.trim(F.regexp_replace(c, r"[ \t\r\n]+", " "))


def norm_key(c: Column) -> Column:
    """Search key: lower case, no accents, no punctuation, single spaces. Letters and digits of all
    scripts stay, as does the underscore."""
    return F.trim(F.regexp_replace(fold(F.lower(c)), r"[^\p{L}\p{N}_]+", " "))


def any_word(c: Column, words: Sequence[str]) -> Column:
    """Whether one of the words stands in a text as a whole word."""
    return c.rlike(r"(?<![\p{L}\p{N}_])(?:" + "|".join(map(re.escape, words)) + r")(?![\p{L}\p{N}_])")


def any_part(c: Column, parts: Sequence[str]) -> Column:
    """Whether a text contains one of the parts."""
    return reduce(Column.__or__, [c.contains(p) for p in parts], F.lit(False))


def first_match(rules: Sequence[tuple[Column, object]], otherwise: object = None) -> Column:
    """Value of the first condition that holds."""
    out = F
    for condition, value in rules:
        out = out.when(condition, value)
    return out.otherwise(otherwise) if rules else F.lit(otherwise)


def similarity(a: Column, b: Column) -> Column:
    """Edit similarity from 0 to 1; two empty texts are alike."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1.0 - F.levenshtein(a, b) / longest)


def unique_in_order(items: Column) -> Column:
    """Items without later repeats that differ in case only."""
    keep = lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.concat(acc, F.array(x)))
    return F.aggregate(items, F.array().cast("array<string>"), keep)
