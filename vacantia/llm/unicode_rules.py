"""Unicode as the tokenizers library has it, where Python's tables or those of ``regex`` differ.

The library takes letters and numbers by Unicode 16, composes by Unicode 9 and lower-cases by
Unicode 17. Python's ``unicodedata`` (15.1) lacks the newest characters and knows marks that the
library's composition does not; ``regex`` calls characters letters that are none in Unicode 16. A
text without such characters, as nearly all are, is told from its distinct characters alone.
"""

from __future__ import annotations

import re
import unicodedata

# Ranges of code points.
#: Letters and numbers of Unicode 16 that 15.1 lacks.
NEW_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
NEW_NUMBERS = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))
#: Marks that have been given a combining class since Unicode 9, and the parts of a pair that composes since.
NEW_MARKS = (
    (0x7FD, 0x7FD), (0x898, 0x89F), (0x8CA, 0x8D3), (0x9FE, 0x9FE), (0xC3C, 0xC3C), (0xD3B, 0xD3C), (0xEBA, 0xEBA), (0x1715, 0x1715), (0x1ABF, 0x1ACE),
    (0x1DF6, 0x1DFA), (0xA82C, 0xA82C), (0x10D24, 0x10D27), (0x10EAB, 0x10EAC), (0x10EFD, 0x10EFF), (0x10F46, 0x10F50), (0x10F82, 0x10F85),
    (0x11070, 0x11070), (0x1133B, 0x1133B), (0x1145E, 0x1145E), (0x11839, 0x1183A), (0x11930, 0x11930), (0x11938, 0x11938), (0x1193D, 0x1193E),
    (0x11943, 0x11943), (0x119E0, 0x119E0), (0x11A34, 0x11A34), (0x11A47, 0x11A47), (0x11A99, 0x11A99), (0x11D42, 0x11D42), (0x11D44, 0x11D45),
    (0x11D97, 0x11D97), (0x11F41, 0x11F42), (0x16FF0, 0x16FF1), (0x1E08F, 0x1E08F), (0x1E130, 0x1E136), (0x1E2AE, 0x1E2AE), (0x1E2EC, 0x1E2EF),
    (0x1E4EC, 0x1E4EF),
)
#: Upper-case letters since 15.1, and how far on their lower case is.
NEW_CASES = (
    (0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, -0xA567), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1),
    (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, -0xA641), (0x10D50, 0x10D65, 0x20), (0x16EA0, 0x16EB8, 0x1B),
)

_LOWER = {c: c + far for a, b, far in NEW_CASES for c in range(a, b + 1)}
_BARRIERS = frozenset(chr(c) for a, b in NEW_MARKS for c in range(a, b + 1))
_KNOWN: dict[str, bool] = {}


def _within(c: str, ranges: tuple[tuple[int, int], ...]) -> bool:
    return any(a <= ord(c) <= b for a, b in ranges)


def _odd(c: str) -> bool:
    got = _KNOWN.get(c)
    if got is None:
        got = _KNOWN[c] = c in _BARRIERS or ord(c) in _LOWER or unicodedata.category(c) == "Cn" or _within(c, NEW_LETTERS) or _within(c, NEW_NUMBERS)
    return got


def odd_characters(text: str) -> set[str]:
    """The characters of a text for which the tables differ."""
    if text.isascii():
        return set()
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return {c for c in set(text) if c > "\xff" and _odd(c)}
    return set()


def normalized(text: str, odd: set[str]) -> str:
    """A text composed and in lower case; a final sigma is one like others."""
    if not odd:
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
    if barriers := odd & _BARRIERS:
        # to the library such a mark is a character like any other, which nothing is moved over
        text = "".join(unicodedata.normalize("NFC", x) for x in re.split("([" + "".join(sorted(barriers)) + "])", text))
    else:
        text = unicodedata.normalize("NFC", text)
    return text.replace("Σ", "σ").lower().translate(_LOWER)


def masked(text: str) -> tuple[str, dict[int, int]]:
    """A text whose characters that are neither letters nor numbers in Unicode 16 nor in 15.1 stand
    as characters of private use, which it doesn't hold, and how to put them back."""
    there = set(text)
    wanted = sorted(c for c in there if unicodedata.category(c) == "Cn" and not _within(c, NEW_LETTERS) and not _within(c, NEW_NUMBERS))
    free = (c for c in range(0x100000, 0x10FFFE) if chr(c) not in there)
    there_and_back = dict(zip(map(ord, wanted), free, strict=False))
    return text.translate(there_and_back), {b: a for a, b in there_and_back.items()}
