"""SimHash near-duplicate classes through a binary trie self-join.

Fingerprints: bit ``i`` is set if it is set in over half of the hashes of a text's word shingles,
repeats included. Distinct fingerprints are then joined with themselves. The 64 bits are cut into
``budget + 1`` blocks; two fingerprints within the budget agree in one block at least, so each
block value is the root of a binary trie over the other bits. All tries of a task are
traversed together, level by level: a pair of nodes carries the differing bits so far and is pruned
once they exceed the budget, or once everything below both nodes is already in one class. Only the
links that join two classes leave the task, so a group of copies yields fewer links than members.
Roots with many fingerprints are split again by blocks of their remaining bits, which loses no link.

Defined results: null texts count as empty; texts without words have fingerprint 0 and are linked
like any other; repeated rows and ties share a class; an empty table gives an empty result. The
shingle hash works on whole texts in fixed-size blocks of shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacantia.llm.memory import release, small_batches
from vacantia.operators.components import connected_components
from vacantia.sources.scratch import checkpointed

SHINGLE, SEED, BUDGET = 4, 42, 4
#: Fingerprints under one root from which it is split by blocks of its remaining bits.
SPLIT = 50_000
#: Pairs of a node pair from which leaves are compared directly; node pairs a step holds at once.
LEAF, STEP = 64, 400_000
#: Hashes whose bits are counted at once, and rows that are worked on at once.
BLOCK, ROWS = 65_536, 500


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of a text."""
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    n = max(1, len(words) - shingle + 1)
    last = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    first, digest = starts.tolist(), xxhash.xxh64_intdigest
    return majority(np.array([digest(joined[i:j], SEED) for i, j in zip(first[:n], last, strict=True)], dtype=np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The number whose bits are those that are set in over half of the hashes; zero without any."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), BLOCK):
        part = hashes[at : at + BLOCK].astype(">u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprint_column(text: Column) -> Column:
    """SimHash of a text column as a (signed) long."""

    @F.arrow_udf(T.LongType())
    def simhash(texts: pa.Array) -> pa.Array:
        prints = [fingerprint(t or "") for at in range(0, len(texts), ROWS) for t in texts.slice(at, ROWS).to_pylist()]
        release()
        return pa.array(np.array(prints, dtype=np.uint64).view(np.int64))

    return simhash(text)


def _blocks(bits: int, n: int) -> list[tuple[int, int]]:
    """(first bit from the top, width) of n blocks over the lowest ``bits`` of 64."""
    cuts = [64 - bits + bits * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _block_value(fp: Column, block: tuple[int, int]) -> Column:
    at, width = block
    return F.shiftrightunsigned(F.shiftleft(fp, at), 64 - width)


class _Classes:
    """Disjoint sets over positions, joined in arrays."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.of[a], self.of[b]
            low, high = np.minimum(x, y), np.maximum(x, y)
            apart = low < high
            a, b, low, high = a[apart], b[apart], low[apart], high[apart]
            np.minimum.at(self.of, high, low)
            while (deeper := self.of[self.of]) is not None and (deeper < self.of).any():
                self.of = deeper


def trie_links(group: np.ndarray, fp: np.ndarray, skip: int, budget: int = BUDGET) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the classes of each group: positions (member, first of its class).

    ``fp`` is sorted within ``group``; its top ``skip`` bits are equal in a group.
    """
    n = len(fp)
    classes = _Classes(n)

    def near(i: np.ndarray, j: np.ndarray) -> None:
        ok = np.bitwise_count(fp[i] ^ fp[j]) <= budget
        classes.join(i[ok], j[ok])

    if n > 1:
        # neighbours in several bit orders join most of a dense class at little cost
        for turn in range(0, 64, 8):
            turned = (fp << np.uint64(turn)) | (fp >> np.uint64(64 - turn)) if turn else fp
            order = np.lexsort((turned, group)) if turn else np.arange(n)
            for gap in (1, 2):
                i, j = order[:-gap], order[gap:]
                same = group[i] == group[j]
                near(i[same], j[same])
        starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        ends = np.append(starts[1:], n)
        many = ends - starts > 1
        z = np.zeros(many.sum(), dtype=np.int64)
        todo = [(skip, starts[many], ends[many], starts[many], ends[many], z)]
        while todo:
            level, *pairs = todo.pop()
            if len(pairs[0]) > STEP:
                for k in range(0, len(pairs[0]), STEP):
                    todo.append((level, *(x[k : k + STEP] for x in pairs)))
                continue
            pairs = _unsettled(classes.of, *pairs)
            pairs = _leaves(near, level, *pairs)
            if len(pairs[0]):
                todo.append((level + 1, *_children(fp, level, budget, *pairs)))
    member = np.flatnonzero(classes.of != np.arange(n))
    return member, classes.of[member]


def _unsettled(of: np.ndarray, al, ah, bl, bh, errors):
    """Drops node pairs below which everything is in one class."""
    if not len(al):
        return al, ah, bl, bh, errors
    change = np.concatenate(([0], np.cumsum(of[1:] != of[:-1])))
    settled = (of[al] == of[bl]) & (change[al] == change[ah - 1]) & (change[bl] == change[bh - 1])
    return tuple(x[~settled] for x in (al, ah, bl, bh, errors))


def _leaves(near, level: int, al, ah, bl, bh, errors):
    """Compares the members of small node pairs; returns the larger pairs."""
    size = (ah - al) * (bh - bl)
    small = (size <= LEAF) | (level >= 64)
    if small.any():
        a, b, width, total = al[small], bl[small], (bh - bl)[small], size[small]
        for k in range(0, len(a), 20_000):
            t = total[k : k + 20_000]
            pair = np.repeat(np.arange(k, k + len(t)), t)
            nth = np.arange(len(pair)) - np.repeat(np.cumsum(t) - t, t)
            i, j = a[pair] + nth // width[pair], b[pair] + nth % width[pair]
            near(i[i < j], j[i < j])
    return tuple(x[~small] for x in (al, ah, bl, bh, errors))


def _children(fp: np.ndarray, level: int, budget: int, al, ah, bl, bh, errors):
    """Child node pairs one bit deeper, within the budget."""
    ones = np.concatenate(([0], np.cumsum((fp >> np.uint64(63 - level)) & np.uint64(1)).astype(np.int64)))
    am, bm = ah - (ones[ah] - ones[al]), bh - (ones[bh] - ones[bl])
    same = al == bl
    kids = [(al, am, bl, bm, errors), (am, ah, bm, bh, errors), (al, am, bm, bh, errors + 1), tuple(x[~same] for x in (am, ah, bl, bm, errors + 1))]
    out = [np.concatenate(x) for x in zip(*kids, strict=True)]
    keep = (out[0] < out[1]) & (out[2] < out[3]) & (out[4] <= budget)
    return tuple(x[keep] for x in out)


def links(prints: DataFrame, budget: int) -> DataFrame:
    """Spanning links (a, b) between distinct fingerprints within the budget."""
    blocks = _blocks(64, budget + 1)
    roots = F.explode(F.array(*[F.struct(F.lit(i).alias("block"), _block_value(F.col("fp"), b).alias("value")) for i, b in enumerate(blocks)])).alias("root")
    keyed = prints.select("fp", roots).select("fp", "root.block", "root.value")
    # at most (budget + 1) * 2**13 roots exist, so this table is bounded whatever the input
    heavy = keyed.groupBy("block", "value").count().where(F.col("count") > SPLIT).select("block", "value", F.lit(True).alias("heavy"))
    keyed = keyed.join(F.broadcast(heavy), ["block", "value"], "left")

    def front(i: int) -> Column:
        at, width = blocks[i]
        fp = F.col("fp")
        if not at:
            return fp
        value = F.shiftleft(_block_value(fp, blocks[i]), 64 - width)
        low = fp.bitwiseAND((1 << (64 - at - width)) - 1) if at + width < 64 else F.lit(0).cast("long")
        return value.bitwiseOR(F.shiftleft(F.shiftrightunsigned(fp, 64 - at), 64 - at - width)).bitwiseOR(low)

    fronts = [F.when(F.col("block") == i, front(i)) for i in range(len(blocks))]
    keyed = keyed.withColumn("front", F.coalesce(*fronts))
    subs = _blocks(64 - max(w for _, w in blocks), budget + 1)
    sub = F.array(*[F.struct(F.lit(i).alias("sub"), _block_value(F.col("front"), b).alias("subvalue")) for i, b in enumerate(subs)])
    none = F.array(F.struct(F.lit(-1).alias("sub"), F.lit(0).cast("long").alias("subvalue")))
    keyed = keyed.select("fp", "block", "value", "front", F.explode(F.when(F.col("heavy"), sub).otherwise(none)).alias("s"))
    key = (((F.col("block") * 8 + F.col("s.sub") + 1) * (1 << 14) + F.col("value")) * (1 << 14) + F.col("s.subvalue")).alias("root")
    keyed = keyed.select(key, "front", "fp")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Tries of whole roots; a root's rows follow each other."""
        held: list[np.ndarray] = []

        def linked(rows: np.ndarray) -> pa.RecordBatch:
            member, first = trie_links(rows[0], rows[1].view(np.uint64), min(w for _, w in blocks), budget)
            return pa.RecordBatch.from_arrays([pa.array(rows[2][first]), pa.array(rows[2][member])], names=["a", "b"])

        for batch in batches:
            held.append(np.array([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]))
            last = held[-1][0]
            if len(last) and sum(x.shape[1] for x in held) >= 100_000 and last[0] != last[-1]:
                rows = np.concatenate(held, axis=1)
                cut = np.searchsorted(rows[0], rows[0][-1])
                yield linked(rows[:, :cut])
                held = [rows[:, cut:]]
        if held:
            yield linked(np.concatenate(held, axis=1))
        held.clear()
        release()

    dealt = keyed.repartition("root").sortWithinPartitions("root", "front")
    return dealt.mapInArrow(join, "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text", budget: int = BUDGET) -> DataFrame:
    """(id, fp, component_id): each row's fingerprint and the smallest id that links reach."""
    small_batches(df.sparkSession)
    prints = checkpointed(df.select(F.col(id_col).alias("id"), fingerprint_column(F.col(text)).alias("fp")))
    distinct = prints.groupBy("fp").agg(F.min("id").alias("least"))
    found = connected_components(links(distinct.select("fp"), budget))
    classes = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    names = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = classes.join(names, "component").select("fp", "component_id")
    return prints.join(classes, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def report(docs: DataFrame) -> DataFrame:
    """Per document: fingerprint as 16 hex digits and its class."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
