"""Document fingerprints: quartile bucket digests of hashed byte triplets.

Triplets of bytes within windows of five are hashed into 128 buckets. The digest holds the
logarithm of the length, two ratios of the quartiles of the bucket counts, and for each bucket the
quartile that its count is in. The difference of two digests adds up the distances of the quartiles,
the ratios and the lengths and is bounded by ``BOUND``; likeness is its complement, from 0 to 1.

Defined results: null texts count as empty; texts without triplets have empty buckets and differ by
their lengths; equal texts have equal digests. Rows are taken in order of (id, text), so ties and
repeated rows have a fixed next row; a single row is its own next; rows without an id have no place
in the order, and each is its own next; an empty table gives an empty result. Whole texts are
digested, in blocks of bytes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import sha256
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacantia.llm.memory import release, small_batches
from vacantia.llm.ranges import Ranges

BUCKETS, BOUND = 128, 250
#: Offsets of the other two bytes of each triplet that starts a window of five.
TRIPLETS = ((1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4))
BLOCK, BATCH_BYTES, ROWS = 1 << 20, 16 << 20, 500
_PEARSON = np.random.default_rng(5).permutation(256).astype(np.uint8)
#: Cost of quartiles that are so far apart.
_COST = np.array([0, 1, 2, 6])


def _counts(data: bytes) -> np.ndarray:
    buf = np.frombuffer(data, dtype=np.uint8)
    counts = np.zeros(256, dtype=np.int64)
    for at in range(0, max(0, len(buf) - 2), BLOCK):
        part, found = buf[at : at + BLOCK + 4], []
        for salt, (i, j) in enumerate(TRIPLETS):
            n = min(BLOCK, len(part) - j)
            if n > 0:
                h = _PEARSON[part[:n] ^ np.uint8(37 * salt)]
                found.append(_PEARSON[_PEARSON[h ^ part[i : i + n]] ^ part[j : j + n]])
        counts += np.bincount(np.concatenate(found), minlength=256)
    return counts[:BUCKETS] + counts[BUCKETS:]


def digest(data: bytes) -> str:
    """68 hex digits: length, ratios, quartile of each bucket."""
    counts = _counts(data)
    low, mid, high = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]].tolist()
    length = min(255, round(math.log(len(data)) / math.log(1.1))) + 1 if data else 0
    ratios = [15 * x // high if high else 0 for x in (low, mid)]
    codes = (counts > low).astype(np.uint8) + (counts > mid) + (counts > high)
    packed = codes.reshape(-1, 4) @ np.array([64, 16, 4, 1])
    return bytes([min(length, 255), ratios[0] * 16 + ratios[1]]).hex() + packed.astype(np.uint8).tobytes().hex()


def _codes(hexed: str) -> np.ndarray:
    body = np.frombuffer(bytes.fromhex(hexed[4:]), dtype=np.uint8)
    return (body[:, None] >> np.array([6, 4, 2, 0], dtype=np.uint8) & 3).reshape(-1).astype(np.int64)


def difference(a: str, b: str) -> int:
    """Difference of two digests, ``BOUND`` at most."""
    if a == b:
        return 0
    x, y = bytes.fromhex(a[:4]), bytes.fromhex(b[:4])
    length = abs(x[0] - y[0])
    total = length if length <= 1 else 6 * length
    total += abs(x[1] // 16 - y[1] // 16) + abs(x[1] % 16 - y[1] % 16)
    return min(BOUND, total + int(_COST[np.abs(_codes(a) - _codes(b))].sum()))


def likeness(a: str, b: str) -> float:
    return 1.0 - difference(a, b) / BOUND


def fingerprint_column(text: Column) -> Column:
    """Digest of a text column."""

    @F.arrow_udf(T.StringType())
    def quartile_digest(texts: pa.Array) -> pa.Array:
        return pa.array([digest((t or "").encode()) for t in texts.to_pylist()], pa.string())

    return quartile_digest(text)


def likeness_column(a: Column, b: Column) -> Column:
    """Likeness of two digest columns; null if one of them is null."""

    @F.arrow_udf(T.DoubleType())
    def digest_likeness(x: pa.Array, y: pa.Array) -> pa.Array:
        pairs = zip(x.to_pylist(), y.to_pylist(), strict=True)
        return pa.array([None if p is None or q is None else likeness(p, q) for p, q in pairs], pa.float64())

    return digest_likeness(a, b)


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by the first characters of the next text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def against_neighbours(docs: DataFrame, id_col: str = "doc_id", text: str = "text", batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Per document: digests of its text and its edited text, and how like they and the next are.

    Texts are shuffled once, into batches by ranges of ids; the first row of a batch also visits
    the batch before, whose last row it follows.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    placed = rows.where("doc_id IS NOT NULL")
    ranges = Ranges(placed, "doc_id", "text", batch_bytes)
    dealt = placed.withColumn("batches", ranges.batches_and_guest())
    dealt = dealt.select("doc_id", "text", F.posexplode("batches").alias("guest", "batch"))

    def compared(rows: Iterator[tuple[int | None, str, str]]) -> Iterator[pa.Table]:
        """Rows of (id, text, next text), some at a time."""
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        names, last = [x.split()[0] for x in SCHEMA.split(", ")], ("", digest(b""))
        while some := list(islice(rows, ROWS)):
            out = []
            for doc, t, following in some:
                other = edited(t, following)
                data = other.encode()
                mine, mark = last[1] if t == last[0] else digest(t.encode()), digest(data)
                after = mine if following == t else digest(following.encode())
                last = (following, after)
                out.append((doc, len(t), sha256(data).hexdigest(), mine, mark, likeness(mine, mark), likeness(mine, after)))
            yield pa.table([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
        release()

    def compare(table: pa.Table) -> pa.Table:
        # the only batch hosts its own first row, the last batch the first row of all
        table = table.sort_by([("guest", "ascending"), ("doc_id", "ascending"), ("text", "ascending")])
        own = table.num_rows - pc.sum(table.column("guest")).as_py()
        ids, texts = table.column("doc_id"), table.column("text")
        rows = ((ids[i].as_py(), texts[i].as_py(), texts[i + 1].as_py()) for i in range(own))
        return pa.concat_tables(compared(rows))

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for found in compared((None, t.as_py(), t.as_py()) for t in batch.column("text")):
                yield from found.to_batches()

    found = ranges.grouped(ranges.dealt_again(dealt, "batch")).applyInArrow(compare, SCHEMA)
    return found.union(rows.where("doc_id IS NULL").mapInArrow(alone, SCHEMA))
