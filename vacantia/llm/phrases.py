"""Removal of repeated passages of words with Aho-Corasick automata.

A window is ``size`` consecutive words of one document. A word goes if a window that covers it also
starts in a document with a smaller id. Documents are dealt into batches by ranges of their ids, so
a later batch only holds larger ids.

Confirmed passages. Each batch hashes its windows and sends every different one once, by buckets of
a second hash; a bucket tells the batches which of their windows an earlier batch has. So a passage
that very many documents share counts once a batch.

Automata. The windows of a batch that are confirmed, by an earlier batch or by an earlier document
of the batch, are put together to passages as long as they run, and each different passage is
compiled once into the batch's automaton: its words are the letters, and it says before which
document of the batch all its windows have occurred. Passages are cut into pieces that share
``size - 1`` words, which bounds how many can end at one word, and an automaton takes so many words
at most; a batch with more has several. All documents of the batch are streamed through and every
occurrence in a document that comes later is removed.

Windows of different batches are compared by 64 bits and a bucket of independent bits; words inside
a batch are compared in full.

Defined results: null texts have no words; documents with fewer words than a window lose none;
repeated rows of one id don't remove each other; rows without an id are kept whole and repeat
nobody; an empty table gives an empty result; input columns named as the outputs are replaced. A
document is worked on whole and has to fit a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacantia.llm.memory import release, small_batches
from vacantia.llm.ranges import Ranges
from vacantia.llm.words import NOT_SPACE, Words

SIZE = 13
#: Text bytes that a batch and index bytes that a bucket aims at, index bytes for each byte of text.
BATCH_BYTES, BUCKET_BYTES, INDEX_SHARE, LEAST_BUCKETS = 4 << 20, 16 << 20, 1.25, 48
#: Windows of a piece of a passage, and words that one automaton takes.
PIECE, AUTOMATON_WORDS = 64, 500_000
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))


def _mixed(h: np.ndarray) -> np.ndarray:
    for m in _MIX:
        h ^= h >> np.uint64(33)
        h *= m
    return h ^ (h >> np.uint64(33))


class Batch:
    """The documents of one batch in order of their ids, as numbers of their words."""

    def __init__(self, ids: list, texts: pa.ChunkedArray, size: int):
        self.order = np.array(sorted(range(len(ids)), key=ids.__getitem__), dtype=np.int64)
        flat = texts.cast(pa.large_binary()).combine_chunks()
        words = Words((flat if isinstance(flat, pa.Array) else pa.concat_arrays(flat.chunks)).take(pa.array(self.order)), NOT_SPACE)
        self.size, self.first = size, words.first
        rank, last = np.zeros(len(ids), np.int64), -1
        for k, i in enumerate(self.order.tolist()):
            last += k == 0 or ids[i] != ids[self.order[k - 1]]
            rank[k] = last
        self.rank = rank
        ends = np.zeros(len(words) + 1, dtype=np.int64)
        np.cumsum(words.end - words.start, out=ends[1:])
        letters = words.data[NOT_SPACE[words.data]]
        kinds = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(letters))]).dictionary_encode()
        #: Number of each word among the different words of the batch, and these.
        self.word, self.kinds = kinds.indices.to_numpy(zero_copy_only=False), kinds.dictionary
        whole = words.counts() - size + 1
        doc = np.repeat(np.arange(len(ids)), np.maximum(whole, 0))
        #: Each window's first word and its document's rank.
        before = np.cumsum(np.maximum(whole, 0)) - np.maximum(whole, 0)
        self.at = words.first[doc] + np.arange(len(doc)) - before[doc]
        self.owner = rank[doc]

    def hashes(self) -> list[np.ndarray]:
        """Two hashes of each window."""
        kinds = np.frombuffer(b"".join(xxhash.xxh3_128_digest(w) for w in self.kinds.to_pylist()), dtype=np.uint64).reshape(-1, 2)
        out = []
        for base, column in zip(_BASES, kinds.T, strict=True):
            words = np.ascontiguousarray(column)[self.word]
            h = np.zeros(max(0, len(words) - self.size + 1), dtype=np.uint64)
            for k in range(self.size):
                h *= np.uint64(base)
                h += words[k : k + len(h)]
            out.append(_mixed(h)[self.at])
        return out

    def sketch(self, buckets: int) -> Sketch:
        return Sketch(*self.hashes(), self.owner, buckets)


class Sketch:
    """The different windows of a batch by bucket and hash.

    ``entry``: of each window, its place among them. ``earliest``: the rank of the first document of
    each.
    """

    def __init__(self, key: np.ndarray, other: np.ndarray, owner: np.ndarray, buckets: int):
        bucket = ((other & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((key, bucket))  # keeps the order of documents among equals
        key, bucket = key[order], bucket[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (bucket[1:] != bucket[:-1])
        self.entry = np.empty(len(order), dtype=np.int64)
        self.entry[order] = np.cumsum(new) - 1
        self.keys, self.earliest = key[new], owner[order][new]
        self.buckets, first = np.unique(bucket[new], return_index=True)
        self.cuts = np.append(first, len(self.keys))

    def blocks(self) -> Iterator[tuple[int, bytes]]:
        for b, i, j in zip(self.buckets.tolist(), self.cuts, self.cuts[1:], strict=False):
            planes = np.diff(self.keys[i:j], prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T
            yield b, zstandard.ZstdCompressor(level=1).compress(planes.tobytes())

    def confirmed(self, replies: dict[int, bytes]) -> np.ndarray:
        """Of each entry, whether an earlier batch has it."""
        parts = [np.unpackbits(np.frombuffer(replies[b], np.uint8), count=j - i) for b, i, j in zip(self.buckets.tolist(), self.cuts, self.cuts[1:], strict=False)]
        return np.concatenate(parts).astype(bool) if parts else np.zeros(0, dtype=bool)


def answers(blocks: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
    """Of one bucket's (batch, entries): for each batch a bit an entry, set if an earlier one has it."""
    blocks = sorted(blocks)
    keys = []
    for _, packed in blocks:
        raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), dtype=np.uint8)
        keys.append(np.cumsum(np.ascontiguousarray(raw.reshape(8, -1).T).reshape(-1).view(np.uint64), dtype=np.uint64))
    ends = np.cumsum([len(k) for k in keys])
    seen = np.ones(ends[-1], dtype=bool)
    seen[np.unique(np.concatenate(keys), return_index=True)[1]] = False
    for (batch, _), part in zip(blocks, np.split(seen, ends[:-1]), strict=True):
        yield batch, np.packbits(part).tobytes()


def passages(at: np.ndarray, before: np.ndarray, owner: np.ndarray, size: int) -> Iterator[tuple[int, int, int]]:
    """Pieces (first word, last word + 1, rank) of the runs of windows at some words of documents;
    all windows of a piece occur in documents up to the rank."""
    if not len(at):
        return
    new = np.ones(len(at), dtype=bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (owner[1:] != owner[:-1])
    starts = np.flatnonzero(new)
    place = np.arange(len(at)) - starts[np.cumsum(new) - 1]
    cuts = np.flatnonzero(place % PIECE == 0)
    rank = np.maximum.reduceat(before, cuts)
    last = np.append(cuts[1:], len(at)) - 1
    yield from zip(at[cuts].tolist(), (at[last] + size).tolist(), rank.tolist(), strict=True)


def _letters(word: np.ndarray, pieces: list[tuple[int, int, int]], kinds: int) -> str:
    """The words of a batch as characters; words outside all pieces share one."""
    edge = np.zeros(len(word) + 1, dtype=np.int64)
    np.add.at(edge, [a for a, _, _ in pieces], 1)
    np.add.at(edge, [b for _, b, _ in pieces], -1)
    letter = np.zeros(kinds, dtype=np.uint32)
    letter[word[np.cumsum(edge[:-1]) > 0]] = 1
    letter = np.cumsum(letter, dtype=np.uint32) * letter
    letter[letter >= 0xD800] += 0x800  # not the halves of pairs
    return letter[word].astype("<u4").tobytes().decode("utf-32-le")


def removed_words(batch: Batch, sketch: Sketch, replies: dict[int, bytes]) -> np.ndarray:
    """Whether each word of a batch goes."""
    confirmed = sketch.confirmed(replies)
    before = np.where(confirmed, -1, sketch.earliest)[sketch.entry]
    hit = np.flatnonzero(before < batch.owner)
    pieces = list(passages(batch.at[hit], before[hit], batch.owner[hit], batch.size))
    edge = np.zeros(len(batch.word) + 1, dtype=np.int64)
    for shard in sharded(pieces):
        said, automaton = _letters(batch.word, shard, len(batch.kinds)), ahocorasick.Automaton()
        for a, b, rank in shard:
            automaton.add_word(said[a:b], (rank, b - a))
        automaton.make_automaton()
        low, high = [], []
        for own, a, b in zip(batch.rank.tolist(), batch.first.tolist(), batch.first[1:].tolist(), strict=False):
            if b - a >= batch.size:
                for end, (rank, n) in automaton.iter(said, a, b):
                    if rank < own:
                        low.append(end + 1 - n)
                        high.append(end + 1)
        np.add.at(edge, low, 1)
        np.add.at(edge, high, -1)
    return np.cumsum(edge[:-1]) > 0


def sharded(pieces: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    """Pieces for one automaton after another."""
    shard, words = [], 0
    for piece in pieces:
        if shard and words + piece[1] - piece[0] > AUTOMATON_WORDS:
            yield shard
            shard, words = [], 0
        shard.append(piece)
        words += piece[1] - piece[0]
    if shard:
        yield shard


_OUT = (("kept", pa.string(), T.StringType()), ("n_words", pa.int64(), T.LongType()), ("n_removed", pa.int64(), T.LongType()))


def _cut(table: pa.Table, text: str, order: np.ndarray, first: np.ndarray, gone: np.ndarray) -> pa.Table:
    """The table with its results; ``order``: the row of each document."""
    kept: list = [None] * len(order)
    n, removed = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
    texts = table.column(text)
    for k, i in enumerate(order.tolist()):
        words = (texts[i].as_py() or "").encode().split()
        part = gone[first[k] : first[k + 1]]
        n[i], removed[i] = len(words), part.sum()
        kept[i] = b" ".join(compress(words, (~part).tolist()) if removed[i] else words).decode()
    for name, values in (("kept", kept), ("n_words", n), ("n_removed", removed)):
        table = table.append_column(name, pa.array(values, dict((x[0], x[1]) for x in _OUT)[name]))
    return table


def remove_passages(df: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = SIZE, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """``df`` with ``kept`` (the words that stay, by single spaces), ``n_words`` and ``n_removed``."""
    small_batches(df.sparkSession)
    df = df.drop("__part", "__batch", *(name for name, _, _ in _OUT))
    ranges = Ranges(df, id_col, text, batch_bytes)
    buckets = max(min(ranges.n, LEAST_BUCKETS), -(-int(ranges.bytes * INDEX_SHARE) // ranges.grown(BUCKET_BYTES)))
    out = T.StructType([*df.schema.fields, *(T.StructField(name, kind) for name, _, kind in _OUT)])

    # one exchange of the text, which both passes below read
    dealt = ranges.dealt(df.where(F.col(id_col).isNotNull()))

    def load(table: pa.Table) -> Batch:
        return Batch(table.column(id_col).to_pylist(), table.column(text), size)

    def sketch(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        blocks = list(load(table).sketch(buckets).blocks())
        release()
        return pa.table([pa.array([b for b, _ in blocks], pa.int32()), pa.array([key[1].as_py()] * len(blocks), pa.int32()), pa.array([x for _, x in blocks], pa.binary())], names=["bucket", "batch", "entries"])

    def settle(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        found = list(answers(list(zip(table.column("batch").to_pylist(), table.column("entries").to_pylist(), strict=True))))
        release()
        return pa.table([pa.array([b for b, _ in found], pa.int32()), pa.array([key[1].as_py()] * len(found), pa.int32()), pa.array([x for _, x in found], pa.binary())], names=["batch", "bucket", "reply"])

    def locate(key: tuple[pa.Scalar, ...], table: pa.Table, said: pa.Table) -> pa.Table:
        batch = load(table)
        gone = removed_words(batch, batch.sketch(buckets), dict(zip(said.column("bucket").to_pylist(), said.column("reply").to_pylist(), strict=True)))
        found = _cut(table.drop_columns(["__part", "__batch"]), text, batch.order, batch.first, gone)
        del batch, gone
        release()
        return found

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nothing = np.zeros(batch.num_rows + 1, dtype=np.int64)
            yield from _cut(pa.table(batch), text, np.arange(batch.num_rows), nothing, np.zeros(0, dtype=bool)).to_batches()

    blocks = ranges.grouped(dealt).applyInArrow(sketch, "bucket int, batch int, entries binary")
    said = ranges.by_bucket(blocks, buckets).applyInArrow(settle, "batch int, bucket int, reply binary")
    found = ranges.grouped(dealt).cogroup(ranges.grouped(ranges.dealt_again(said, "batch"))).applyInArrow(locate, out)
    return found.union(df.where(F.col(id_col).isNull()).mapInArrow(whole, out))


def report(docs: DataFrame) -> DataFrame:
    """Per document: words, removed words, and the digest of what remains."""
    rows = remove_passages(docs.select("doc_id", F.col("text").cast("string").alias("text")))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def report_sql() -> str:
    """DuckDB SQL for ``report``: compares all windows as strings."""
    window = " || ' ' || ".join(f"lead(word, {k}) OVER w" if k else "word" for k in range(SIZE))
    return f"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
e AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM d),
s AS (SELECT doc_id, i, word, {window} AS said FROM e WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
h AS (SELECT doc_id, i, word, CASE WHEN said IS NOT NULL AND min(doc_id) OVER (PARTITION BY said) < doc_id THEN 1 ELSE 0 END AS hit FROM s),
g AS (SELECT doc_id, i, word, max(hit) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {SIZE - 1} PRECEDING AND CURRENT ROW) AS gone FROM h),
k AS (SELECT doc_id, sum(gone)::BIGINT AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS kept FROM g GROUP BY doc_id)
SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""
