"""BPE encoding and decoding with a compiled tokenization automaton.

The merge list is compiled into a deterministic automaton over token labels. It starts with
one state per base symbol and every arc present; each merge ``(u, v)`` is one gadget:

* the new label ``uv`` gets an arc wherever ``u`` has one,
* the state reached by ``uv`` is a copy of the state reached by ``v``,
* the state reached by ``u`` loses its arc ``v`` (and ``uv`` when ``u == v``).

After the last merge the automaton accepts exactly the label sequences that BPE produces, so a
word has a single accepted path. Encoding looks for it from left to right by table lookups: from
the state reached, the longest label that stands in the text and has an arc is taken, and a place
from which no arc leads on is left again and never re-entered. A word that is a label by itself is
taken at once, as no other path spells it. Decoding emits the labels of the arcs. The transition
table is a bit matrix, states by labels; states of word-final labels have no arcs and no row, and
labels with equal columns share one.

Characters on which Unicode versions differ count as the tokenizers library has them
(``unicode_rules``). Nulls encode as empty texts; empty texts give no ids. Rows are independent, so ties, repeated
rows and extra columns need nothing special: the text column alone goes to Python.
"""

from __future__ import annotations

import fcntl
import gc
import json
import re
import tempfile
from array import array
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacantia.llm.memory import kept, release, small_batches
from vacantia.llm.unicode_rules import masked, normalized, odd_characters

#: Entries of a worker's cache of words before it is emptied; longer words are not cached.
CACHE_WORDS, CACHE_LEN = 75_000, 48
#: Rows that are worked on at once.
ROWS = 256
#: Marks that often end a stretch without white space; none is a letter, digit or apostrophe.
MARKS = ",.;:!?"
#: Characters by which the longest label at a place is bounded.
HEAD = 4
#: White space of the vocabularies' patterns, as part of a character class.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def _byte_chars() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


class Automaton:
    """Transition table of a merge list with an end-of-word suffix."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.end: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.labels = [""] * (1 + max([*self.ids.values(), *self.special.values()]))
        for label, i in [*self.ids.items(), *self.special.items()]:
            self.labels[i] = label
        self.label_bytes = [x.encode() for x in self.labels]
        self.merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.row: list[int] = []
        #: The distinct columns of the bit matrix, each with a byte for eight states, and that of each label.
        self.bits, self.column, self.height = b"", [], 0
        cut = len(self.end)
        self.final = {x[: len(x) - cut]: i for x, i in self.ids.items() if x.endswith(self.end)}
        self.inner = {x: i for x, i in self.ids.items() if not cut or not x.endswith(self.end)}
        #: Of the first characters of longer labels: length of the longest label with them.
        self.reach: dict[str, int] = {}
        for x in (*self.final, *self.inner):
            if len(x) >= HEAD:
                self.reach[x[:HEAD]] = max(len(x), self.reach.get(x[:HEAD], 0))
        chars = _byte_chars()
        self._bytes = {b: chars[b] for b in range(256)}
        contractions = "'s|'t|'re|'ve|'m|'ll|'d"
        self._words = regex.compile(rf"\p{{L}}+|\p{{N}}|{contractions}|[^{_SPACE}\p{{L}}\p{{N}}]+")
        self._space = re.compile(f"[{_SPACE}]+")
        self._split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._cache: dict[str, bytes] = {}

    def compile(self) -> Automaton:
        """Builds the transition table, once; decoding does without it. While it is built it takes
        several times its size, so the workers of a machine build theirs one after another."""
        if not self.row:
            with open(f"{tempfile.gettempdir()}/bpe-compile.lock", "w") as turn:
                fcntl.flock(turn, fcntl.LOCK_EX)
                self._build()
        return self

    def _build(self) -> None:
        merges = [(self.ids[u], self.ids[v], self.ids[u + v]) for u, v in self.merges]
        made = [uv for _, _, uv in merges]
        if len(set(made)) < len(made):
            raise ValueError("two merges make the same label: this merge list has no gadget automaton")
        final = np.array([bool(self.end) and x.endswith(self.end) for x in self.labels])
        base = sorted(set(self.ids.values()) - set(made))
        order = [i for i in [*base, *made] if not final[i]]
        row = np.full(len(self.labels), -1, dtype=np.int32)
        row[order] = np.arange(len(order), dtype=np.int32)
        table = np.zeros(((len(order) + 7) // 8, len(self.labels)), dtype=np.uint8)
        filled = sum(not final[i] for i in base)
        first = np.packbits(np.arange(table.shape[0] * 8) < filled, bitorder="little")
        table[:, base] = first[:, None]
        rows = row.tolist()
        for u, v, uv in merges:
            table[:, uv] = table[:, u]
            if (r := rows[uv]) >= 0:
                source = rows[v]
                table[r >> 3] |= ((table[source >> 3] >> (source & 7)) & 1) << (r & 7)
            r = rows[u]
            keep = 255 ^ (1 << (r & 7))
            table[r >> 3, v] &= keep
            if u == v:
                table[r >> 3, uv] &= keep
        found: dict[bytes, int] = {}
        for at in range(0, len(self.labels), 4_096):
            part = np.ascontiguousarray(table[:, at : at + 4_096].T)
            self.column += [found.setdefault(x.tobytes(), len(found)) for x in part]
        self.row, self.height = rows, len(table)
        self.merges = []
        del table, part
        self.bits = b"".join(found)
        del found
        release()

    def allows(self, state: int, label: int) -> bool:
        """Whether the state reached by one label has an arc with the other."""
        r = self.row[state]
        return r >= 0 and bool(self.bits[self.column[label] * self.height + (r >> 3)] >> (r & 7) & 1)

    def encode_word(self, word: str) -> list[int]:
        """Ids of one pre-split word: the labels of the only accepted path. Longer arcs are tried
        first; a place from which no arc leads on is not entered again."""
        plain = word.isascii() and word.isprintable()
        text = word if plain else "".join(map(self._bytes.__getitem__, word.encode()))
        n, inner, final, row, bits, reach = len(text), self.inner, self.final, self.row, self.bits, self.reach
        column, height = self.column, self.height
        if (label := final.get(text)) is not None:
            return [label]
        path: list[tuple[int, int]] = []
        dead: set[int] = set()
        i, j, r = 0, min(n - 1, reach.get(text[:HEAD], HEAD - 1)), -1
        while True:
            while j > i:
                label = (inner if j < n else final).get(text[i:j])
                if label is not None and (r < 0 or bits[column[label] * height + (r >> 3)] >> (r & 7) & 1) and j not in dead:
                    break
                j -= 1
            else:
                dead.add(i)
                j = i - 1
                i, _ = path.pop()
                r = row[path[-1][1]] if path else -1
                continue
            path.append((i, label))
            if j == n:
                return [x for _, x in path]
            i, r = j, row[label]
            j = min(n, i + reach.get(text[i : i + HEAD], HEAD - 1))

    def _packed(self, stretch: str) -> bytes:
        """Ids of a stretch without white space."""
        core = stretch.rstrip(MARKS)
        if core.isalpha():
            return self._word(core) + (self._word(stretch[len(core) :]) if len(core) < len(stretch) else b"")
        return b"".join(map(self._word, self._words.findall(stretch)))

    def _word(self, word: str) -> bytes:
        got = self._cache.get(word)
        if got is None:
            got = array("I", self.encode_word(word)).tobytes()
            if len(word) <= CACHE_LEN:
                if len(self._cache) >= CACHE_WORDS:
                    self._cache.clear()
                self._cache[word] = got
        return got

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        for part in self._split.split(text) if self._split and "<" in text else (text,):
            if part in self.special:
                out.append(array("I", [self.special[part]]).tobytes())
                continue
            odd = odd_characters(part)
            part = normalized(part, odd)
            if odd:
                part, back = masked(part)
                out += [self._word(w.translate(back)) for w in self._words.findall(part)]
                continue
            # str.split also cuts at four control characters that are no white space here
            chunks = part.split() if not any(c in part for c in "\x1c\x1d\x1e\x1f") else self._space.split(part)
            get, packed = self._cache.get, self._packed
            for chunk in chunks:
                out.append(get(chunk) or packed(chunk))
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> bytes:
        """Arc labels in order, joined by one space, in UTF-8."""
        return b" ".join(map(self.label_bytes.__getitem__, ids.tolist()))


def read_vocabulary(path: str) -> str:
    """Text of a tokenizer file. Its size is bounded by the vocabulary, not by the data."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def automaton(vocabulary: str) -> Automaton:
    """A vocabulary's automaton; a Python worker keeps the last one."""
    return kept(sha256(vocabulary.encode()).hexdigest(), lambda: Automaton(json.loads(vocabulary)))


def _values(column: pa.Array) -> Iterator[np.ndarray]:
    """The numbers of each list; a null list is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    for x in column:
        yield x.values.to_numpy(zero_copy_only=False) if x.is_valid else np.empty(0, np.int32)


def _encoded(fsa: Automaton, texts: pa.Array) -> list[bytes]:
    """Ids of each text; none for null."""
    gc.disable()  # the cache holds no cycles, and collections would walk over it again and again
    try:
        return [fsa.encode(t) if t else b"" for t in texts.to_pylist()]
    finally:
        gc.enable()


def _id_lists(packed: list[bytes]) -> pa.Array:
    offsets = np.zeros(len(packed) + 1, dtype=np.int32)
    np.cumsum([len(p) // 4 for p in packed], out=offsets[1:])
    values = np.frombuffer(b"".join(packed), dtype="<i4")
    kind = pa.list_(pa.field("element", pa.int32(), nullable=False))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values), type=kind)


def round_trip_column(spark, text: Column, vocabulary: str, ids: bool = False) -> Column:
    """Struct of a text's ``n_tokens``, the digest of its ids and that of their decoded text, and of
    the ``ids`` if asked for. A text is encoded once for all of them."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(vocabulary)
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    fields += [T.StructField("ids", T.ArrayType(T.IntegerType(), False))] * ids

    @F.arrow_udf(T.StructType(fields))
    def bpe_round_trip(texts: pa.Array) -> pa.Array:
        fsa = automaton(shared.value).compile()
        columns: list[list[pa.Array]] = [[] for _ in fields]
        for at in range(0, max(1, len(texts)), ROWS):
            packed = _encoded(fsa, texts.slice(at, ROWS))
            decoded = [sha256(fsa.decode(np.frombuffer(p, dtype="<u4"))).hexdigest() for p in packed]
            found = [pa.array([len(p) // 4 for p in packed], pa.int64()), pa.array([sha256(p).hexdigest() for p in packed], pa.string()), pa.array(decoded, pa.string())]
            for column, part in zip(columns, [*found, _id_lists(packed)], strict=False):
                column.append(part)
        release()
        return pa.StructArray.from_arrays(list(map(pa.concat_arrays, columns)), names=[f.name for f in fields])

    return bpe_round_trip(text)


def encode_column(spark, text: Column, vocabulary: str) -> Column:
    """``array<int>`` of token ids of a text column."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(vocabulary)

    @F.arrow_udf(T.ArrayType(T.IntegerType(), False))
    def bpe_encode(texts: pa.Array) -> pa.Array:
        fsa = automaton(shared.value).compile()
        out = [_id_lists(_encoded(fsa, texts.slice(at, ROWS))) for at in range(0, len(texts), ROWS)]
        return pa.concat_arrays(out) if out else _id_lists([])

    return bpe_encode(text)


def decode_column(spark, ids: Column, vocabulary: str) -> Column:
    """Decoded text of an ``array<int>`` column: labels joined by one space."""
    shared = spark.sparkContext.broadcast(vocabulary)

    @F.arrow_udf(T.StringType())
    def bpe_decode(column: pa.Array) -> pa.Array:
        fsa = automaton(shared.value)
        return pa.array([fsa.decode(x).decode() for x in _values(column)], type=pa.string())

    return bpe_decode(ids)


def encode(df: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with token ids of its text column; a column named ``ids`` is replaced."""
    return df.withColumn(ids, encode_column(df.sparkSession, F.col(text), vocabulary))


def decode(df: DataFrame, vocabulary: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with the decoded text of its ids; a column named ``text`` is replaced."""
    return df.withColumn(text, decode_column(df.sparkSession, F.col(ids), vocabulary))


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Per document: token count and digests of its ids and of their decoded text."""
    trip = round_trip_column(docs.sparkSession, F.col("text"), vocabulary)
    return docs.select("doc_id", trip.alias("trip")).select("doc_id", "trip.n_tokens", "trip.ids_sha256", "trip.decoded_sha256")
