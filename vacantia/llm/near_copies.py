"""Near copies by SimHash, settled on whole shingle sets: texts whose sets of five-word shingles have
a Jaccard likeness of ``least`` or more are linked, and links are followed to whole classes.

The binary trie self-join of ``simhash`` over fingerprints of the same shingles gives the first
candidates. No number of differing bits holds all pairs above a likeness, so what it leaves apart is
completed by prefixes: in any order of all shingles, sets with a likeness of t share one of their
first ``n - ceil(t n) + 1`` shingles, so only these are dealt out as keys. Pairs are dropped if the
shared keys before a common one and all that follows it can't add up to the threshold, or if the
parities of their shingles in ``SKETCH`` buckets differ in more places than their shingles may; all
others are compared on whole sets, so the result is exact.

The order is by hash, but the most frequent keys (over ``HEAVY`` sets each, at most ``HEAVY_KEYS`` of
them) come last: a line that a third of all texts share is then a key of those texts only that have
little else, and near copies of a large group are keyed by what sets them apart. Before all remaining
pairs of a key are taken, its sets are compared with one hub of their size, the set with the fewest
rarer shingles, and pairs within a class are left out, so a large group isn't compared with itself.

Rows are told apart by id and text, so several texts of one id are in the class of each. The first of
a class is the row with the smallest id; rows without an id come last, and ties go by a hash of the
text.

Defined results: null texts count as empty; texts without words are alike; shorter texts than a
shingle are one shingle; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.llm import simhash
from vacantia.llm.ids import counted, unused
from vacantia.llm.memory import kept, release, small_batches
from vacantia.operators.components import connected_components
from vacantia.sources.scratch import checkpointed

SHINGLE, LEAST, SEED = 5, 0.8, 42
#: Sets of a key from which it moves to the end of the order, and how many keys do at most.
HEAVY, HEAVY_KEYS = 64, 50_000
#: Buckets whose parities are compared, a multiple of 64, and sets of a key up to which they aren't.
SKETCH, FEW = 512, 8
#: Products of the threshold are rounded up less this, so that rounding loses no pair.
_SLACK = 1e-9
_BASE = np.uint64(0x9E3779B97F4A7C15)
CACHE_WORDS = 150_000
#: Sets that a task holds while it compares pairs.
SETS = 64


class _Words(dict):
    """Hashes of words, kept up to a number."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        got = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return got


def shingle_hashes(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """Unsigned hashes of a text's word shingles, repeats included."""
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    one = np.fromiter(map(kept("shingle words", _Words).__getitem__, words), np.uint64, len(words))
    n = max(1, len(words) - shingle + 1)
    h = np.zeros(n, dtype=np.uint64)
    for k in range(min(shingle, len(words))):
        h = h * _BASE + one[k : k + n]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def shingles(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles."""
    return np.unique(shingle_hashes(text, shingle).view(np.int64))


def sketch(one: np.ndarray) -> np.ndarray:
    """The parity of the number of hashes in each bucket, as packed bits. Two sketches differ in no
    more places than their sets have hashes that the other lacks."""
    counts = np.bincount((one & (SKETCH - 1)).astype(np.int64), minlength=SKETCH)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.int64)


def _digest(one: np.ndarray) -> int:
    """Signed hash of a set."""
    digest = xxhash.xxh64_intdigest(one.tobytes(), SEED)
    return digest - (digest >> 63 << 64)


def _prefix(size: int, least: float) -> int:
    return size - int(np.ceil(least * size - _SLACK)) + 1 if size else 0


def _lists(sets: list[np.ndarray]) -> pa.Array:
    cuts = np.cumsum([0, *map(len, sets)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate([*sets, np.empty(0, np.int64)])))


def _signed(docs: DataFrame, shingle: int, least: float, last: np.ndarray | None = None) -> DataFrame:
    """(id, hash, fp, digest, size, sketch, keys) of (id, text, hash): SimHash, digest, size and sketch of
    the set, its prefix in the order that has the keys of ``last`` at its end."""
    shared = docs.sparkSession.sparkContext.broadcast(np.sort(last) if last is not None else np.empty(0, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                fps, digests, sizes, sketches, keys = [], [], [], [], []
                for text in batch.column(1).to_pylist():
                    hashes = shingle_hashes(text or "", shingle)
                    one = np.unique(hashes.view(np.int64))
                    fps.append(simhash.majority(hashes))
                    digests.append(_digest(one))
                    sizes.append(len(one))
                    sketches.append(sketch(one))
                    if len(late) and len(one):
                        is_late = late[np.minimum(np.searchsorted(late, one), len(late) - 1)] == one
                        one = np.concatenate((one[~is_late], one[is_late]))
                    keys.append(one[: _prefix(len(one), least)])
                prints = pa.array(np.array(fps, dtype=np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), prints, pa.array(digests, pa.int64()), pa.array(np.array(sizes, dtype=np.int32)), _lists(sketches), _lists(keys)], names=["id", "hash", "fp", "digest", "size", "sketch", "keys"])
            release()

    return docs.mapInArrow(run, "id long, hash long, fp long, digest long, size int, sketch array<long>, keys array<long>")


def _rows_of(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """Rows of ``docs`` that have an id and a hash of ``rows``, which may be null."""
    rows = rows.withColumnsRenamed({"id": "__id", "hash": "__hash"})
    return docs.join(rows, F.col("id").eqNullSafe(F.col("__id")) & (F.col("hash") == F.col("__hash")), how)


def _wanted(a: str, b: str, least: float):
    """Common shingles that sets of these sizes need."""
    return F.lit(least / (1 + least)) * (F.col(a) + F.col(b)) - _SLACK


def _reach(a: str, b: str, least: float):
    """Whether two sets that share a key may reach the threshold: before it they have as many in
    common as the one with fewer shared keys before it, after it as many as the one that ends first."""
    before, after = F.least(f"rank_{a}", f"rank_{b}"), F.least(F.col(f"size_{a}") - F.col(f"pos_{a}"), F.col(f"size_{b}") - F.col(f"pos_{b}"))
    both = F.col(f"size_{a}") + F.col(f"size_{b}")
    differ = reduce(Column.__add__, [F.bit_count(F.get(f"sketch_{a}", i).bitwiseXOR(F.get(f"sketch_{b}", i))) for i in range(SKETCH // 64)])
    enough = before + after >= _wanted(f"size_{a}", f"size_{b}", least)
    return (F.col(f"size_{a}") >= F.col(f"size_{b}") * least - _SLACK) & enough & (F.coalesce(differ, F.lit(0)) <= both * (1 - least) / (1 + least) + _SLACK)


def _able(rows: DataFrame, least: float) -> DataFrame:
    """Distinct pairs (a, b) of the smaller and the larger set that may reach the threshold, by the
    keys they share and by what follows the last of these in both."""
    counted = rows.groupBy("a", "b", "size_a", "size_b").agg(F.count("*").alias("n"), F.max("pos_a").alias("i"), F.max("pos_b").alias("j"))
    rest = F.least(F.ceil(F.col("size_b") * least - _SLACK) - 1, F.col("size_a") - F.col("i") - 1, F.col("size_b") - F.col("j") - 1)
    return counted.where(F.col("n") + rest >= _wanted("size_a", "size_b", least)).select("a", "b")


def _verified(docs: DataFrame, ids: DataFrame, pairs: DataFrame, shingle: int, least: float) -> DataFrame:
    """Pairs whose whole sets are alike enough. The texts are shuffled and not the sets, which are
    larger; a text that has another digest than its row stands for another row of its id."""
    pairs = checkpointed(pairs)
    ends = pairs.select(F.col("a").alias("digest")).union(pairs.select("b")).distinct()
    wanted = counted(ids.join(ends, "digest").select("id", "hash", "digest"))
    texts = _rows_of(docs, wanted, "inner").select("digest", "text").dropDuplicates(["digest"])
    a, b = (texts.select(F.col("digest").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray | None] = {}

        def whole(digest: int, text: str | None) -> np.ndarray | None:
            if digest not in held:
                if len(held) >= SETS:
                    held.clear()
                one = shingles(text or "", shingle)
                if _digest(one) != digest:
                    return None
                held[digest] = one
            return held[digest]

        for batch in batches:
            alike = []
            for i in range(batch.num_rows):
                x, y = (whole(batch.column(c)[i].as_py(), batch.column(f"text_{c}")[i].as_py()) for c in "ab")
                both = -1 if x is None or y is None else len(np.intersect1d(x, y, assume_unique=True))
                alike.append(both >= 0 and both >= (len(x) + len(y) - both) * least - _SLACK)
            yield batch.filter(pa.array(alike, pa.bool_())).select(["a", "b"])
        release()

    found = pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b")
    return checkpointed(found.mapInArrow(run, "a long, b long").distinct())


def _by_trie(sets: DataFrame, budget: int) -> DataFrame:
    """Candidates (a, b) of the trie self-join: one set of each fingerprint with that of another
    within the budget, and with the others of its fingerprint."""
    heads = checkpointed(sets.groupBy("fp").agg(F.min("digest").alias("head")))
    links = simhash.links(heads.select("fp"), budget)
    for x in "ab":
        links = links.join(heads.select(F.col("fp").alias(x), F.col("head").alias(f"head_{x}")), x)
    same = sets.join(heads, "fp").where("digest <> head").select(F.col("head").alias("a"), F.col("digest").alias("b"))
    return links.select(F.col("head_a").alias("a"), F.col("head_b").alias("b")).union(same)


def _by_hubs(shared: DataFrame, least: float) -> DataFrame:
    """Candidates (a, b) of each set and the hubs of its keys, of its own and the next smaller size."""
    one = F.struct("pos", "rank", "digest", "size", "sketch")
    span = shared.withColumn("span", F.floor(F.log("size") / -F.log(F.lit(least))))
    hubs = span.groupBy("key", "span").agg(F.min(one).alias("hub"))
    near = span.select(one.alias("me"), "key", F.explode(F.array("span", F.col("span") - 1)).alias("span")).join(hubs, ["key", "span"]).where("me.digest <> hub.digest")
    first = (F.col("hub.size") < F.col("me.size")) | ((F.col("hub.size") == F.col("me.size")) & (F.col("hub.digest") < F.col("me.digest")))
    rows = near.select(F.when(first, F.col("hub")).otherwise(F.col("me")).alias("x"), F.when(first, F.col("me")).otherwise(F.col("hub")).alias("y"))
    rows = rows.select(F.col("x.digest").alias("a"), F.col("y.digest").alias("b"), *[F.col(f"{s}.{c}").alias(f"{c}_{n}") for c in ("size", "pos", "rank", "sketch") for s, n in ("xa", "yb")])
    return rows.where(_reach("a", "b", least)).select("a", "b").distinct()


def _apart(shared: DataFrame, found: DataFrame, least: float) -> DataFrame:
    """Candidates (a, b) that share a key and are in different classes."""
    rest = checkpointed(shared.join(found, "digest", "left").withColumn("component", F.coalesce("component", "digest")))
    mixed = rest.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    rest = rest.join(mixed, "key", "left_semi")
    a, b = (rest.select("key", *[F.col(c).alias(f"{c}_{x}") for c in ("digest", "size", "pos", "rank", "sketch", "component")]) for x in "ab")
    later = (F.col("size_a") < F.col("size_b")) | ((F.col("size_a") == F.col("size_b")) & (F.col("digest_a") < F.col("digest_b")))
    rows = a.join(b, "key").where(later & (F.col("component_a") != F.col("component_b")) & _reach("a", "b", least))
    return _able(rows.withColumnsRenamed({"digest_a": "a", "digest_b": "b"}), least)


def _keyed(sets: DataFrame) -> DataFrame:
    return sets.select("digest", F.posexplode("keys").alias("pos", "key"))


def _shared(sets: DataFrame) -> DataFrame:
    """(key, digest, size, sketch, pos, rank) of the keys that several sets have; rank: how many shared
    keys of the set come before. Rows of a key with few sets go without the sketch."""
    keyed = _keyed(sets)
    several = keyed.join(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key")
    keys = several.groupBy("digest").agg(F.sort_array(F.collect_list(F.struct("pos", "key", "n"))).alias("found"))
    rows = sets.select("digest", "size", "sketch").join(keys, "digest").select("digest", "size", "sketch", F.posexplode("found").alias("rank", "k"))
    return rows.select("k.key", "digest", "size", F.when(F.col("k.n") > FEW, F.col("sketch")).alias("sketch"), "k.pos", "rank")


def _place() -> Column:
    """What the first row of a class has the least of."""
    return F.struct(F.col("id").isNull().alias("unknown"), F.col("id").alias("id"), F.col("hash").alias("hash"))


def text_hash(text: str) -> Column:
    """Hash of a text, by which rows of one id are told apart."""
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def near_copies(df: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE, least: float = LEAST, budget: int = simhash.BUDGET) -> DataFrame:
    """(id, hash, component_id, first): each row's id and hash of its text, the id of the first row of
    its class, and whether it is this row (or its repeat)."""
    small_batches(df.sparkSession)
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("text"), text_hash(text).alias("hash"))
    signed = checkpointed(_signed(docs, shingle, least))
    one = [F.min_by(c, _place()).alias(c) for c in ("fp", "size", "sketch", "keys")]
    sets = checkpointed(signed.groupBy("digest").agg(F.min(_place()).alias("least"), *one))
    ids = sets.select("digest", "least.id", "least.hash")

    often = _keyed(sets).groupBy("key").count().where(F.col("count") > HEAVY).orderBy(F.desc("count"), "key").limit(HEAVY_KEYS)
    heavy = np.array([r["key"] for r in often.collect()], dtype=np.int64)
    if len(heavy):
        frame = F.broadcast(df.sparkSession.createDataFrame(pa.table({"key": heavy})))
        touched = counted(_keyed(sets).join(frame, "key", "left_semi").select("digest").distinct())
        again = counted(ids.join(touched, "digest").select("id", "hash"))
        anew = _signed(_rows_of(docs, again, "left_semi"), shingle, least, heavy).join(touched, "digest", "left_semi")
        anew = checkpointed(anew.dropDuplicates(["digest"]))
        same = [c for c in sets.columns if c != "least"]
        sets = sets.select(same).join(touched, "digest", "left_anti").unionByName(anew.select(same))
    shared = checkpointed(_shared(sets))

    links = _verified(docs, ids, _by_trie(sets, budget).union(_by_hubs(shared, least)).distinct(), shingle, least)
    found = connected_components(links).withColumnRenamed("node", "digest")
    links = links.union(_verified(docs, ids, _apart(shared, found, least), shingle, least))

    classes = ids.join(connected_components(links).withColumnRenamed("node", "digest"), "digest", "left").withColumn("component", F.coalesce("component", "digest"))
    names = classes.groupBy("component").agg(F.min(_place()).alias("least"))
    named = classes.join(names, "component").select("digest", "least")
    rows = signed.select("id", "hash", "digest").join(named, "digest")
    return rows.select(F.col("id").alias(id_col), "hash", F.col("least.id").alias("component_id"), (_place() == F.col("least")).alias("first"))


def without_copies(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The first row of each class of near copies."""
    key = unused(df, "row_hash")
    rows = df.withColumn(key, text_hash(text))
    found = checkpointed(near_copies(df, id_col, text))
    found = found.groupBy(id_col, "hash").agg(F.count("*").alias("n"), F.first("first").alias("first"))
    # few rows repeat both id and text of another, and only these are brought together
    others = counted(found.where("n > 1 OR NOT first").select(F.col(id_col).alias("__id"), F.col("hash").alias("__hash"), "first"))
    mine = F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & (F.col(key) == F.col("__hash"))
    repeated = rows.join(others.where("first"), mine, "left_semi").dropDuplicates([id_col, key])
    return rows.join(others, mine, "left_anti").unionByName(repeated).select(df.columns)
