"""Importance resampling towards a target distribution.

Features of a text are its runs of one to three consecutive words, hashed into ``BUCKETS`` buckets.
A bucket's gain is the scaled logarithm of its share in the target texts over its share in the
documents; a document's weight is the sum of its features' gains, looked up in an array. Gumbel
noise, seeded by the document's id, is added to the weight, so the documents with the highest sums
are a draw without replacement in proportion to the weights.

The cutoff among the sums is found by a weighted median of medians. Each round, every partition
reports the median of its remaining keys and how many there are; the median of these, weighted by
the counts, is the pivot, with at least a quarter of the remaining keys on either side. Keys on the
wrong side of it are discarded, until the pivot is the cutoff itself. What a round sends to the
driver is a row for each million keys. Keys are (score descending, id ascending, number of the row)
and so all differ. Only the winners are sorted.

The checksum of a run is put together from those of its words (a checksum of a concatenation is
linear in its parts), so all runs of a batch are hashed by a few lookups in arrays.

Defined results: null texts count as empty; rows with few words are scored and never drawn; repeated
rows are documents of their own, ties between them go by their place in the input; rows without an
id come last among equal scores; empty tables give an empty result or gains of an empty target.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.llm.memory import kept, release, small_batches
from vacantia.llm.words import LETTERS, LOWER, Words
from vacantia.sources.scratch import scratch_dir

BUCKETS, RUN = 10_000, 3
SEED, PERCENT, LEAST_WORDS = 42, 5, 20
#: Words whose runs are hashed at once; bytes up to which words are hashed side by side.
BLOCK, SIDE_BY_SIDE = 1 << 18, 48
#: Keys that a partition takes a median of at once, and remaining keys that are sorted directly.
CHUNK, DIRECT = 1 << 20, 4096
#: Remaining keys are written anew when so many times fewer are left, if there were many.
SHRUNK, MANY = 8, 20_000_000
_NO_ID = np.iinfo(np.int64).max


@dataclass
class Checksums:
    """CRC-32 of many byte strings at once."""

    step: np.ndarray  # a byte's effect on the register
    shift: np.ndarray  # by n < 64 zero bytes: for each byte of the register
    double: np.ndarray  # by 64, 128, 256 ... zero bytes

    @staticmethod
    def tables() -> Checksums:
        def make() -> Checksums:
            step = np.arange(256, dtype=np.uint32)
            for _ in range(8):
                step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1).astype(np.uint32)
            shift = [np.arange(256, dtype=np.uint32) << np.arange(0, 32, 8, dtype=np.uint32)[:, None]]
            for _ in range(64):
                shift.append(step[shift[-1] & 255] ^ (shift[-1] >> np.uint32(8)))
            double = [shift.pop()]
            for _ in range(25):
                double.append(_moved(double[-1], double[-1]))
            return Checksums(step, np.array(shift), np.array(double))

        return kept("checksums", make)

    def of(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of ranges of some bytes, none of them empty."""
        size = end - start
        capped = np.minimum(size, SIDE_BY_SIDE + 1).astype(np.uint8)
        order = np.argsort(capped, kind="stable")
        longer = np.searchsorted(capped[order], np.arange(SIDE_BY_SIDE + 2), side="right")
        state = np.full(len(start), 0xFFFFFFFF, dtype=np.uint32)
        place, beside = start[order], longer[SIDE_BY_SIDE]
        for j in range(SIDE_BY_SIDE):
            i = longer[j]  # words of more than j bytes begin here
            if i >= beside:
                break
            s = state[i:beside]
            state[i:beside] = self.step[(s ^ data[place[i:beside] + j]) & 255] ^ (s >> np.uint32(8))
        out = np.empty(len(start), dtype=np.uint32)
        out[order] = ~state
        for k in order[beside:].tolist():
            out[k] = zlib.crc32(data[start[k] : end[k]])
        return out

    def spaced(self, crc: np.ndarray) -> np.ndarray:
        """Of the same strings with a space behind them."""
        state = ~crc
        return ~(self.step[(state ^ np.uint32(0x20)) & 255] ^ (state >> np.uint32(8)))

    def joined(self, crc: np.ndarray, other: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Of strings with others of given sizes behind them."""
        low = size & 63
        out = self.shift[low, 0, crc & 255]
        for k in (1, 2, 3):
            out ^= self.shift[low, k, (crc >> np.uint32(8 * k)) & 255]
        far = np.flatnonzero(size >= 64)
        rest = size[far] >> 6
        for table in self.double:
            if not len(far):
                break
            odd = far[rest & 1 == 1]
            out[odd] = _moved(table, out[odd])
            rest >>= 1
            far, rest = far[rest > 0], rest[rest > 0]
        return out ^ other


def _moved(table: np.ndarray, register: np.ndarray) -> np.ndarray:
    out = table[0][register & 255]
    for k in (1, 2, 3):
        out = out ^ table[k][(register >> np.uint32(8 * k)) & 255]
    return out


def feature_buckets(texts: pa.Array, buckets: int = BUCKETS) -> Iterator[tuple[Words, int, int, list[np.ndarray]]]:
    """Some words at a time: the words of all texts, a range of them, and for runs of one to three
    words that begin at each its bucket (``buckets`` if there is no such run)."""
    words, tables = Words(texts, LETTERS), Checksums.tables()
    words.data = LOWER[words.data]
    owner = words.owner()
    for a in range(0, max(1, len(words)), BLOCK):
        b = min(len(words), a + BLOCK)
        start, end, of = (x[a : b + RUN - 1] for x in (words.start, words.end, owner))
        crc, size = tables.of(words.data, start, end), end - start
        found, run = [crc[: b - a] % np.uint32(buckets)], crc
        for n in range(1, RUN):
            run = tables.joined(tables.spaced(run[: max(0, len(start) - n)]), crc[n:], size[n:])
            bucket = np.full(b - a, buckets, dtype=np.uint32)
            m = min(b - a, len(run))
            bucket[:m] = np.where(of[:m] == of[n : n + m], run[:m] % np.uint32(buckets), buckets)
            found.append(bucket)
        yield words, a, b, found


def bucket_counts(df: DataFrame, text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts in each bucket: added up in each task, then over the tasks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets + 1, dtype=np.int64)
        for batch in batches:
            for _, _, _, found in feature_buckets(batch.column(0), buckets):
                for bucket in found:
                    total += np.bincount(bucket, minlength=buckets + 1)
        release()
        some = np.flatnonzero(total[:buckets])
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], ["bucket", "n"])

    small_batches(df.sparkSession)
    rows = df.select(F.col(text).cast("string").alias("text")).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, dtype=np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandfold logarithm of each bucket's share in the target over that in the source, one
    added to each count; the last entry is of no bucket."""
    n, s, t = len(source), float(source.sum()), float(target.sum())
    ratios = ((float(y) + 1) * (s + n) / ((float(x) + 1) * (t + n)) for x, y in zip(source.tolist(), target.tolist(), strict=True))
    return np.array([*(math.floor(1000 * math.log(r)) for r in ratios), 0], dtype=np.int64)


def noise(id: int | None, seed: int = SEED) -> int:
    """Thousandfold Gumbel noise of an id."""
    h = int(sha256(f"{seed}:{'' if id is None else id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


SCORED = "doc_id long, n_words long, n_features long, weight long, score long"


def scored(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text: str = "text", seed: int = SEED) -> DataFrame:
    """Per row: its words and features, weight, and weight with noise."""
    shared, buckets = docs.sparkSession.sparkContext.broadcast(gain), len(gain) - 1

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before, words = np.zeros(1, dtype=np.int64), None
            for words, _, _, found in feature_buckets(batch.column("text"), buckets):
                before = np.append(before, before[-1] + np.cumsum(sum(shared.value[x] for x in found)))
            n = words.counts()
            weight = np.diff(before[words.first])
            ids = batch.column("doc_id").to_pylist()
            total = weight + np.array([noise(i, seed) for i in ids], dtype=np.int64)
            features = sum(np.maximum(n - k, 0) for k in range(RUN))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, (n, features, weight, total))], [c.split()[0] for c in SCORED.split(", ")])
        release()

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(score, SCORED)


class Key(NamedTuple):
    """Place in the order of the draw: (minus score, id, row), ascending."""

    score: int
    id: int
    row: int


def _before(keys: np.ndarray, pivot: Key) -> np.ndarray:
    """Which keys (rows of score, id, row) come before a pivot."""
    s, i, r = keys
    return (s < pivot.score) | ((s == pivot.score) & ((i < pivot.id) | ((i == pivot.id) & (r < pivot.row))))


def _median(keys: np.ndarray) -> Key | None:
    if not keys.shape[1]:
        return None
    at = np.lexsort(keys[::-1])[(keys.shape[1] - 1) // 2]
    return Key(*keys[:, at].tolist())


def weighted_median(medians: list[tuple[Key, int]]) -> Key:
    """The first key up to which at least half of the weight lies."""
    total, seen = sum(n for _, n in medians), 0
    for key, n in sorted(medians):
        seen += n
        if 2 * seen >= total:
            return key
    raise ValueError("no keys")


def cutoff(keys: DataFrame, k: int, chunk: int = CHUNK, direct: int = DIRECT, many: int = MANY) -> Key | None:
    """The k-th key of a table (score, id, row) of keys in the order of ``Key``; None if k is 0."""
    if k <= 0:
        return None
    spark, after, until, pivot, need, held = keys.sparkSession, None, None, None, k, None
    while True:

        def split(batches: Iterator[pa.RecordBatch], after=after, until=until, pivot=pivot) -> Iterator[pa.RecordBatch]:
            parts, size = [], 0

            def report() -> pa.RecordBatch:
                left, right = np.concatenate(parts, axis=1), np.empty((3, 0), np.int64)
                if pivot is not None:
                    first = _before(left, pivot)
                    right = left[:, ~first & (left != np.array(pivot)[:, None]).any(axis=0)]
                    left = left[:, first]
                found = [(side, x.shape[1], *_median(x)) for side, x in enumerate((left, right)) if x.shape[1]]
                return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in (zip(*found, strict=True) if found else [()] * 5)], ["side", "n", "score", "id", "row"])

            for batch in batches:
                x = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
                if until is not None:
                    x = x[:, _before(x, until)]
                if after is not None:
                    x = x[:, ~_before(x, after) & (x != np.array(after)[:, None]).any(axis=0)]
                parts, size = [*parts, x], size + x.shape[1]
                if size >= chunk:
                    yield report()
                    parts, size = [], 0
            if size:
                yield report()

        rows = keys.mapInArrow(split, "side long, n long, score long, id long, row long").collect()
        sides = [[(Key(r["score"], r["id"], r["row"]), r["n"]) for r in rows if r["side"] == side] for side in (0, 1)]
        left = sum(n for _, n in sides[0])
        if pivot is None or need <= left:
            until, side = pivot or until, 0
        elif need == left + 1:
            return pivot
        else:
            after, need, side = pivot, need - left - 1, 1
        remaining = sum(n for _, n in sides[side])
        if remaining < need:
            raise ValueError(f"{k} keys asked of a table that has fewer")
        rest = keys.where(_within(after, until))
        if remaining <= direct:
            return sorted(Key(*r) for r in rest.collect())[need - 1]
        held = held or remaining
        if remaining * SHRUNK <= held and held >= many:
            path = f"{scratch_dir(spark)}/resample-{uuid.uuid4().hex}"
            rest.write.parquet(path)
            keys, held = spark.read.parquet(path), remaining
        pivot = weighted_median(sides[side])


def _ordered(pivot: Key, first: bool) -> Column:
    """Whether a row's key comes before (or after) a pivot."""
    s, i, r = F.col("score"), F.col("id"), F.col("row")
    if first:
        return (s < pivot.score) | ((s == pivot.score) & ((i < pivot.id) | ((i == pivot.id) & (r < pivot.row))))
    return (s > pivot.score) | ((s == pivot.score) & ((i > pivot.id) | ((i == pivot.id) & (r > pivot.row))))


def _within(after: Key | None, until: Key | None) -> Column:
    out = F.lit(True)
    if after is not None:
        out &= _ordered(after, False)
    if until is not None:
        out &= _ordered(until, True)
    return out


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text: str = "text", target_text: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, chunk: int = CHUNK, direct: int = DIRECT) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_features, weight, score, and the rank of those drawn:
    ``percent`` of the rows with at least ``least_words`` words, highest scores first."""
    spark = docs.sparkSession
    gain = gains(bucket_counts(docs, text), bucket_counts(target, target_text))
    folder = f"{scratch_dir(spark)}/resample-{uuid.uuid4().hex}"
    scored(docs, gain, id_col, text, seed).withColumn("row", F.monotonically_increasing_id()).write.parquet(folder)
    rows = spark.read.parquet(folder)
    long_enough = F.col("n_words") >= least_words
    keyed = rows.where(long_enough).select((-F.col("score")).alias("score"), F.coalesce("doc_id", F.lit(int(_NO_ID))).alias("id"), "row")
    last = cutoff(keyed, keyed.count() * percent // 100, chunk, direct)
    unranked = rows.withColumn("rank", F.lit(None).cast("long"))
    if last is None:
        return unranked.drop("row")
    key = {"score": -F.col("score"), "id": F.coalesce("doc_id", F.lit(int(_NO_ID)))}
    placed = rows.withColumn("at", F.struct(key["score"].alias("score"), key["id"].alias("id"), "row"))
    edge = F.struct(F.lit(last.score).cast("long").alias("score"), F.lit(last.id).cast("long").alias("id"), F.lit(last.row).cast("long").alias("row"))
    drawn = long_enough & (F.col("at") <= edge)
    # a sort by ranges; a row's number in it is its place in its partition after the partitions before
    winners = placed.where(drawn).repartitionByRange("at").sortWithinPartitions("at").withColumn("number", F.monotonically_increasing_id())
    winners.drop("at").write.parquet(f"{folder}-drawn")
    winners = spark.read.parquet(f"{folder}-drawn").withColumn("part", F.shiftright("number", 33))
    sizes, seen = {r["part"]: r["n"] for r in winners.groupBy("part").agg(F.count("*").alias("n")).collect()}, 0
    offsets = []
    for part in sorted(sizes):
        offsets.append((part, seen))
        seen += sizes[part]
    offset = F.broadcast(spark.createDataFrame(offsets, "part long, offset long"))
    ranked = winners.join(offset, "part").withColumn("rank", F.col("offset") + F.col("number").bitwiseAND(F.lit((1 << 33) - 1)) + 1)
    return placed.where(~drawn).drop("at", "row").withColumn("rank", F.lit(None).cast("long")).unionByName(ranked.drop("part", "offset", "number", "row"))


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """All documents, drawn towards the texts of the benchmark."""
    return resample(docs, benchmark).select("doc_id", "n_features", "weight", "score", "rank")
