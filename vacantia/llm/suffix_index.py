"""Removal of repeated long byte strings with a logarithmic family of sampled suffix arrays.

A byte goes if a string of ``length`` bytes that covers it also starts in a document with a smaller
id. Documents are dealt into batches by ranges of their ids, so a later batch only holds larger ids.

Sampling. Every window of ``length`` bytes has one anchor: the leftmost smallest hash among its
substrings of ``seed`` bytes. Equal windows have the same anchor at the same place, so suffixes
that start at anchors are all that need indexing. Consecutive windows with one anchor form a run.

Index. The suffixes of a batch are dealt into buckets by the hash of their first ``seed`` bytes.
In a bucket each batch gives one sorted array. In order of the batches, a new array is
merge-scanned against the levels of the index; what is found there repeats an earlier document over
its whole run. The rest becomes a new level, and levels of like size are merged, so there are
logarithmically many and each suffix moves that often. Suffixes whose first ``seed`` bytes are known
but whose run is not are settled in a second round of the same kind, window by window, as at the
ends of every repeated passage.

The arrays are ordered by 64-bit hashes of the suffixes' bytes and not by the bytes, which keeps
the shuffled arrays smaller than the text. Copies inside a batch are settled inside it, so a passage
that very many documents share counts once a batch, however often it occurs.

Defined results: null texts count as empty; texts under ``length`` bytes lose nothing; repeated rows
of one id don't remove each other; rows without an id are kept whole; matches never cross documents;
an empty table gives an empty result. Input columns named as the outputs are replaced. Long texts are
worked through in segments; removal works on bytes, so a cut can fall inside a character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacantia.llm.memory import kept, release, small_batches
from vacantia.llm.ranges import Ranges

LENGTH, SEED = 50, 20
#: Text bytes a batch aims at, and windows a segment holds at once.
BATCH_BYTES, SEGMENT = 4 << 20, 1 << 19
#: Index bytes a bucket aims at, bytes of an entry on average, and buckets of a small table.
BUCKET_BYTES, ENTRY_BYTES, LEAST_BUCKETS = 16 << 20, 13, 48
_BASE = 0x2545F4914F6CDD1D
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random value for each byte, and powers of the base and of its inverse."""

    def make() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        powers = []
        for x in (_BASE, pow(_BASE, -1, 2**64)):
            p = np.full(n, x, dtype=np.uint64)
            p[0] = 1
            powers.append(np.cumprod(p))
        return np.random.default_rng(20).integers(0, 2**64, 256, dtype=np.uint64), *powers

    return kept(f"powers of {n}", make)


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    for m in _MIX:
        h *= m
        h ^= h >> np.uint64(31)
    return h


class Segment:
    """Windows of a stretch of concatenated documents, with their anchors and runs."""

    def __init__(self, data: bytes, valid: np.ndarray, length: int, seed: int):
        """valid: whether a window that lies in one document starts at a byte."""
        table, self._powers, self._inverse = _tables(SEGMENT + length)
        buf = np.frombuffer(data, dtype=np.uint8)
        self._sum = np.concatenate((np.zeros(1, np.uint64), np.cumsum(table[buf] * self._powers[: len(buf)])))
        self.length, windows = length, len(buf) - length + 1
        seeds = _mixed((self._sum[seed:] - self._sum[:-seed]) * self._inverse[: len(buf) - seed + 1])
        low = np.uint64((1 << 20) - 1)
        least = (seeds & ~low) | np.arange(len(seeds), dtype=np.uint64)
        span, width = 1, length - seed + 1
        while 2 * span <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if width > span:
            least = np.minimum(least[: span - width], least[width - span :])
        anchor = (least & low).astype(np.int64)
        ok = valid[:windows]
        first = np.flatnonzero(ok & np.concatenate(([True], (anchor[1:] != anchor[:-1]) | ~ok[:-1])))
        self.low = first
        bad = np.flatnonzero(~ok)
        stop = np.append(bad, windows)[np.searchsorted(bad, first)]
        self.high = np.minimum(np.append(first[1:], windows), stop)  # one past the last window
        self.key = seeds[anchor[first]]
        self.context = self.hashes(self.low, self.high + length - 1) ^ (anchor[first] - first).astype(np.uint64)

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the bytes from start to end, with their number."""
        h = (self._sum[end] - self._sum[start]) * self._inverse[start]
        return _mixed(h + (end - start).astype(np.uint64) * _MIX[0])


class Batch:
    """The documents of one batch in order of their ids, cut into segments."""

    def __init__(self, ids: list, texts: list, length: int, seed: int):
        self.order = sorted(range(len(ids)), key=ids.__getitem__)
        self.texts = [texts[i] or b"" for i in self.order]
        sizes = np.fromiter(map(len, self.texts), np.int64, len(self.texts))
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        ranks, last = np.zeros(len(ids), np.int64), -1
        for k, i in enumerate(self.order):
            last += k == 0 or ids[i] != ids[self.order[k - 1]]
            ranks[k] = last
        self.rank, self.length, self.seed = ranks, length, seed
        self.data = b"".join(self.texts)

    def segments(self) -> Iterator[tuple[int, Segment, np.ndarray]]:
        """(place, segment, rank of the document of each run)."""
        total, length = len(self.data), self.length
        for at in range(0, total - length + 1, SEGMENT):
            stop = min(total, at + SEGMENT + length - 1)
            places = np.arange(at, stop)
            doc = np.searchsorted(self.ends, places, side="right")
            valid = places + length <= self.ends[doc]
            segment = Segment(self.data[at:stop], valid, length, self.seed)
            if len(segment.low):
                yield at, segment, self.rank[doc[segment.low]]

    def suffixes(self) -> dict[str, np.ndarray]:
        """All runs of the batch: key, context, rank of the document, first and end window."""
        parts = [(s.key, s.context, rank, at + s.low, at + s.high) for at, s, rank in self.segments()]
        names = ("key", "context", "rank", "low", "high")
        if not parts:
            return {k: np.empty(0, np.uint64 if k in names[:2] else np.int64) for k in names}
        return dict(zip(names, map(np.concatenate, zip(*parts, strict=True)), strict=True))

    def windows(self, runs: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """The windows of some runs, in order: key of the run, hash, rank, place."""
        order = np.argsort(runs["low"], kind="stable")
        low, high, key, rank = (runs[k][order] for k in ("low", "high", "key", "rank"))
        parts = []
        for at, segment, _ in self.segments():
            i, j = np.searchsorted(low, [at, at + SEGMENT])
            n = high[i:j] - low[i:j]
            run = np.repeat(np.arange(i, j), n)
            place = low[run] + np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
            parts.append((key[run], segment.hashes(place - at, place - at + self.length), rank[run], place))
        names = ("key", "context", "rank", "low")
        if not parts:
            return {k: np.empty(0, np.uint64 if k in names[:2] else np.int64) for k in names}
        return dict(zip(names, map(np.concatenate, zip(*parts, strict=True)), strict=True))


def _pack(x: np.ndarray) -> bytes:
    """Numbers byte-plane by byte-plane, compressed."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(data: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


class Dealt:
    """Entries of a batch without its own repeats, dealt into buckets.

    ``own``: entries that repeat a smaller document of the batch itself. ``entry``: of each entry,
    its place among those that are sent, which are sorted by bucket, key and context. With
    ``contests`` buckets are dealt by key, and a key that has several contexts in the batch is sent
    once, as contested by itself, so a seed of very many documents is one entry a batch. Without,
    contexts spread a frequent seed over all buckets.
    """

    def __init__(self, entries: dict[str, np.ndarray], buckets: int, contests: bool):
        # the key's top 40 bits tell suffixes apart well enough: a false likeness costs a second look
        keys, by = entries["key"] >> np.uint64(24), entries["key" if contests else "context"]
        bucket = (by & np.uint64(0xFFFFFF)).astype(np.int64) % buckets
        order = np.lexsort((entries["rank"], entries["context"], keys, bucket))
        key, context, rank, bucket = keys[order], entries["context"][order], entries["rank"][order], bucket[order]
        other = np.ones(len(order), dtype=bool)
        other[1:] = (key[1:] != key[:-1]) | (bucket[1:] != bucket[:-1])
        new = other.copy()
        new[1:] |= context[1:] != context[:-1]
        self.own, self.entry = np.zeros(len(order), dtype=bool), np.empty(len(order), dtype=np.int64)
        self.own[order] = rank > rank[new][np.cumsum(new) - 1]
        several = np.zeros(len(order), dtype=bool)
        if contests and len(order):
            several = np.add.reduceat(new, np.flatnonzero(other))[np.cumsum(other) - 1] > 1
            new = np.where(several, other, new)
        self.entry[order] = np.cumsum(new) - 1
        self.keys, self.contexts, of = key[new] << np.uint64(1) | several[new], context[new], bucket[new]
        self.buckets, first = np.unique(of, return_index=True)
        self.cuts = np.append(first, len(of))

    def blocks(self) -> Iterator[tuple[int, bytes, bytes]]:
        for b, i, j in zip(self.buckets.tolist(), self.cuts, self.cuts[1:], strict=False):
            yield b, _pack(np.diff(self.keys[i:j], prepend=np.uint64(0))), _pack(self.contexts[i:j])

    def replied(self, replies: dict[int, bytes]) -> np.ndarray:
        """The answers of the buckets, for every entry of the batch."""
        if not len(self.buckets):
            return np.empty(0, dtype=np.uint8)
        answers = np.concatenate([_unpack(replies[b], np.uint8) for b in self.buckets.tolist()])
        return answers[self.entry]


class Level:
    """A sorted array of distinct suffixes."""

    def __init__(self, key: np.ndarray, context: np.ndarray):
        self.key, self.context = key, context
        self.joint = self.joined(key, context)

    def holds(self, key: np.ndarray, context: np.ndarray) -> np.ndarray:
        """Merge scan of a sorted array against this one."""
        if not len(self.key):
            return np.zeros(len(key), dtype=bool)
        wanted = self.joined(key, context)
        at = np.minimum(np.searchsorted(self.joint, wanted), len(self.key) - 1)
        found = (self.context[at] == context) & (self.key[at] == key)
        # entries with one joint number are in the order of their contexts: each round halves what
        # is left of them, so a key with very many contexts costs a logarithm
        left = np.flatnonzero(~found & (self.joint[at] == wanted))
        low, high = at[left] + 1, np.searchsorted(self.joint, wanted[left], side="right")
        while (some := low < high).any():
            left, low, high = left[some], low[some], high[some]
            middle = (low + high) >> 1
            there = self.context[middle]
            found[left] = there == context[left]
            less = there < context[left]
            low, high = np.where(less, middle + 1, low), np.where(less, high, np.where(found[left], low, middle))
        return found

    @staticmethod
    def joined(key: np.ndarray, context: np.ndarray) -> np.ndarray:
        """Key and the context's top bits in one number, in the order of the array."""
        return (key << np.uint64(24)) | (context >> np.uint64(40))

    def merged(self, other: Level) -> Level:
        parts = [np.concatenate(x) for x in ((self.key, other.key), (self.context, other.context))]
        order = np.lexsort((parts[1], parts[0]))
        return Level(*(x[order] for x in parts))


class SuffixIndex:
    """Levels of geometrically growing size."""

    def __init__(self):
        self.levels: list[Level] = []

    def add(self, key: np.ndarray, context: np.ndarray) -> np.ndarray:
        """Scans a new batch against all levels; whether each suffix was there. Others join."""
        found = np.zeros(len(key), dtype=bool)
        for level in self.levels:
            found |= level.holds(key, context)
        new = Level(key[~found], context[~found])
        while self.levels and len(self.levels[-1].key) <= 2 * len(new.key):
            new = self.levels.pop().merged(new)
        self.levels.append(new)
        return found

    def whole(self) -> Level:
        out = Level(np.empty(0, np.uint64), np.empty(0, np.uint64))
        for level in self.levels:
            out = out.merged(level)
        return out


#: Answers to a batch: nothing like it, repeats an earlier document, same seed but another run.
NEW, REPEATED, CONTESTED = 0, 1, 2


def answer(blocks: list[tuple[int, bytes, bytes]], contests: bool) -> Iterator[tuple[int, bytes]]:
    """Answers of one bucket to its batches' arrays, in order of the batches."""
    index, parts, replies = SuffixIndex(), [], []
    for _, keys, contexts in sorted(blocks, key=lambda x: x[0]):
        packed, context = np.cumsum(_unpack(keys, np.uint64)).astype(np.uint64), _unpack(contexts, np.uint64)
        key, several = packed >> np.uint64(1), (packed & np.uint64(1)).astype(bool)
        found = np.zeros(len(key), dtype=np.uint8)
        found[~several] = index.add(key[~several], context[~several])
        parts.append((key, several))
        replies.append(found)
    if contests:
        whole = index.whole()
        repeated = whole.key[1:][whole.key[1:] == whole.key[:-1]]
        contested = np.unique(np.concatenate([repeated, *(k[s] for k, s in parts)]))
        for (key, several), reply in zip(parts, replies, strict=True):
            at = np.minimum(np.searchsorted(contested, key), max(0, len(contested) - 1))
            mine = contested[at] == key if len(contested) else several
            reply[(reply == NEW) & mine] = CONTESTED
    for batch, reply in zip(sorted(b for b, _, _ in blocks), replies, strict=True):
        yield batch, _pack(reply)


def removed_windows(batch: Batch, first: dict, second: dict, buckets: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(low, high) places of removed windows, given the answers of both rounds."""
    runs = batch.suffixes()
    dealt = Dealt(runs, buckets, True)
    said = dealt.replied(first)
    gone = dealt.own | (said == REPEATED)
    out = [(runs["low"][gone], runs["high"][gone])]
    windows = batch.windows({k: v[(said == CONTESTED) & ~gone] for k, v in runs.items()})
    dealt = Dealt(windows, buckets, False)
    gone = dealt.own | (dealt.replied(second) == REPEATED)
    return [*out, (windows["low"][gone], windows["low"][gone] + 1)]


def without(data: bytes, spans: list[tuple[int, int]]) -> str:
    """A UTF-8 text without the characters of which a byte lies in a span."""
    kept, at = [], 0
    for start, end in spans:
        while start > at and data[start] & 0xC0 == 0x80:
            start -= 1
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end += 1
        kept.append(data[at : max(at, start)])
        at = max(at, end)
    return b"".join([*kept, data[at:]]).decode()


def _contested(batch: Batch, first: dict, buckets: int) -> Dealt:
    runs = batch.suffixes()
    dealt = Dealt(runs, buckets, True)
    said = dealt.replied(first)
    return Dealt(batch.windows({k: v[(said == CONTESTED) & ~dealt.own] for k, v in runs.items()}), buckets, False)


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = LENGTH, seed: int = SEED, batch_bytes: int = BATCH_BYTES, characters: bool = False) -> DataFrame:
    """``df`` with ``kept`` (the remaining bytes) and ``spans`` (removed byte ranges, maximal). With
    ``characters``, ``kept`` is a string: the text without the characters of which a byte goes."""
    small_batches(df.sparkSession)
    df = df.drop("kept", "spans", "__batch", "__part")
    unknown = df.where(F.col(id_col).isNull())
    unknown = unknown.withColumn("kept", F.coalesce(F.col(text), F.lit("")).cast("string" if characters else "binary")).withColumn("spans", F.array().cast(_SPANS))
    df = df.where(F.col(id_col).isNotNull())
    ranges = Ranges(df, id_col, text, batch_bytes)
    buckets = max(min(ranges.n, LEAST_BUCKETS), -(-ranges.bytes * ENTRY_BYTES // ((length - seed) // 2 * ranges.grown(BUCKET_BYTES))))

    # one exchange of the text, which all three passes below read
    dealt = ranges.dealt(df)
    block = "bucket int, batch int, origin int, keys binary, contexts binary"
    reply = "batch int, round int, bucket int, reply binary"

    def load(table: pa.Table) -> Batch:
        texts = table.column(text).cast(pa.binary()).to_pylist()
        return Batch(table.column(id_col).to_pylist(), texts, length, seed)

    def emitted(number: int, parts: Dealt, said: pa.Table | None = None) -> pa.Table:
        rows = [(b, number, b, keys, contexts) for b, keys, contexts in parts.blocks()]
        # answers of the first round go along
        rows += [(number % buckets, number, r["bucket"], r["reply"], None) for r in (said.to_pylist() if said else ())]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        columns = zip(*rows, strict=True) if rows else [()] * 5
        release()
        return pa.table([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["bucket", "batch", "origin", "keys", "contexts"])

    def replies(table: pa.Table, nth: int) -> dict[int, bytes]:
        return {r["bucket"]: r["reply"] for r in table.to_pylist() if r["round"] == nth}

    def sketch(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return emitted(key[1].as_py(), Dealt(load(table).suffixes(), buckets, True))

    def contest(key: tuple[pa.Scalar, ...], table: pa.Table, said: pa.Table) -> pa.Table:
        return emitted(key[1].as_py(), _contested(load(table), replies(said, 1), buckets), said)

    def settle(nth: int):
        def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            rows = table.to_pylist()
            bucket, blocks = key[1].as_py(), [(r["batch"], r["keys"], r["contexts"]) for r in rows if r["contexts"] is not None]
            out = [(b, nth, bucket, r) for b, r in answer(blocks, nth == 1)] if blocks else []
            out += [(r["batch"], 1, r["origin"], r["keys"]) for r in rows if r["contexts"] is None]
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary())
            release()
            return pa.table([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["batch", "round", "bucket", "reply"])

        return run

    def cut(key: tuple[pa.Scalar, ...], table: pa.Table, said: pa.Table) -> pa.Table:
        batch = load(table)
        marks = np.zeros(len(batch.data) + 1, dtype=np.int32)
        for low, high in removed_windows(batch, replies(said, 1), replies(said, 2), buckets):
            np.add.at(marks, low, 1)
            np.add.at(marks, high + length - 1, -1)
        np.cumsum(marks, out=marks)
        gone = marks[:-1] > 0
        del marks
        kept: list = [None] * len(batch.texts)
        spans: list = [None] * len(batch.texts)
        for k, i in enumerate(batch.order):
            a, b = batch.starts[k], batch.ends[k]
            part = gone[a:b]
            if not part.any():
                kept[i], spans[i] = batch.texts[k].decode() if characters else batch.texts[k], []
                continue
            edge = np.flatnonzero(np.diff(part.astype(np.int8), prepend=0, append=0))
            spans[i] = [{"start": x, "end": y} for x, y in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]
            if characters:
                kept[i] = without(batch.texts[k], [(x["start"], x["end"]) for x in spans[i]])
            else:
                kept[i] = np.frombuffer(batch.texts[k], dtype=np.uint8)[~part].tobytes()
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        table = table.drop_columns(["__batch", "__part"])
        del batch, gone
        release()
        return table.append_column("kept", pa.array(kept, pa.string() if characters else pa.binary())).append_column("spans", pa.array(spans, kind))

    def with_text(said: DataFrame):
        return ranges.grouped(dealt).cogroup(ranges.grouped(ranges.dealt_again(said, "batch")))

    first = ranges.by_bucket(ranges.grouped(dealt).applyInArrow(sketch, block), buckets).applyInArrow(settle(1), reply)
    second = ranges.by_bucket(with_text(first).applyInArrow(contest, block), buckets).applyInArrow(settle(2), reply)
    out = T.StructType([*df.schema.fields, T.StructField("kept", T.StringType() if characters else T.BinaryType()), T.StructField("spans", _SPANS)])
    return with_text(second).applyInArrow(cut, out).union(unknown)


def report(docs: DataFrame) -> DataFrame:
    """Per document: bytes, removed bytes and spans, and the digest of what remains."""
    rows = remove_repeats(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return rows.select(
        "doc_id",
        F.octet_length("text").cast("long").alias("n_bytes"),
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
