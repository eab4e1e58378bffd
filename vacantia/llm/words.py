"""Words of a column of texts as ranges of its bytes, found without a loop over texts or words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def byte_class(pattern_bytes: bytes, negated: bool = False) -> np.ndarray:
    """For each byte value whether it is among some (or, negated, not among them)."""
    out = np.zeros(256, dtype=bool)
    out[np.frombuffer(pattern_bytes, dtype=np.uint8)] = True
    return ~out if negated else out


#: Runs of anything but white space; runs of digits, letters and all code points beyond ASCII.
NOT_SPACE = byte_class(b" \t\n\v\f\r", negated=True)
LETTERS = byte_class(bytes([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]))
#: Each byte with A-Z in lower case.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


class Words:
    """Words of an array of texts (null: none).

    ``data`` holds the bytes of all texts, ``start`` and ``end`` the ranges of the words in it, in
    order, and ``first[i] : first[i + 1]`` are the words of text ``i``.
    """

    def __init__(self, texts: pa.Array, members: np.ndarray):
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        whole = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if len(texts) and texts.buffers()[2] is not None else np.empty(0, np.uint8)
        self.data = whole[offsets[0] : offsets[-1]]
        self.offsets = offsets - offsets[0]
        edges = self.offsets[(self.offsets > 0) & (self.offsets < len(self.data))]
        inside = members[self.data]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        begins[edges] = inside[edges]
        ends[edges - 1] = inside[edges - 1]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, self.offsets)

    def __len__(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        """Number of words of each text."""
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """The text that each word is in."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())
