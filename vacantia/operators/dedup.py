"""Duplicate detection across sources."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacantia.functions.text import norm_key, similarity
from vacantia.operators.components import connected_components
from vacantia.operators.normalize import first_of
from vacantia.operators.terms import BROADCAST_ROWS, bounded, like_pairs
from vacantia.sources.scratch import checkpointed

#: Weights of the parts of a pair's score: title, text, company, salary.
WEIGHTS = {"title": 0.40, "text": 0.35, "company": 0.15, "salary": 0.10}
CONFIRMED, PROBABLE = 0.85, 0.70
#: Primes of XXH64, and shingles of a text that are hashed at once.
XXH64, HASHED = (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5), 256


def dedup_exact(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row per key in a fixed order, so repeated runs agree."""
    return first_of(df, keys, order)


def candidate_pairs(df: DataFrame, block: Sequence[str], source: str, key: str, cols: Sequence[str]) -> DataFrame:
    """Pairs of rows of one block from different sources, each pair once. Block values are compared
    as strings; rows without one are in a block 'unknown'. It's an equi join, so skewed blocks are
    split at runtime."""
    df = df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("unknown")) for c in block})
    a = df.select(*block, F.col(key).alias("a"), F.col(source).alias("source_a"), *[F.col(c).alias(f"{c}_a") for c in cols])
    b = df.select(*block, F.col(key).alias("b"), F.col(source).alias("source_b"), *[F.col(c).alias(f"{c}_b") for c in cols])
    return a.join(b, list(block)).where("a < b AND source_a <> source_b")


def best_window(a: Column, b: Column) -> Column:
    """Edit similarity of the shorter text and the window of the longer one that is most like it."""
    first = F.length(a) <= F.length(b)
    short, long = F.when(first, a).otherwise(b), F.when(first, b).otherwise(a)
    starts = F.sequence(F.lit(1), F.length(long) - F.length(short) + 1)
    return F.array_max(F.transform(starts, lambda i: similarity(short, F.substring(long, i, F.length(short)))))


def with_window(likeness: Column, a: Column, b: Column, weight: float = 0.9) -> Column:
    """A likeness, or a little less than that of the best window where this is more; windows are not
    looked at where they can't be."""
    both = (F.length(a) > 0) & (F.length(b) > 0) & (F.length(a) != F.length(b))
    return F.when((likeness < weight) & both, F.greatest(likeness, best_window(a, b) * weight)).otherwise(likeness)


def title_likeness(a: Column, b: Column) -> Column:
    """Likeness of two title keys: of the texts, a little less of their words in alphabetical order,
    less again of one with the best window of the other."""
    x, y = (F.array_join(F.array_sort(F.split(c, " ")), " ") for c in (a, b))
    return with_window(F.greatest(similarity(a, b), similarity(x, y) * 0.95), a, b)


def token_set(c: Column) -> Column:
    """Distinct words of a text's search key."""
    return F.array_remove(F.array_distinct(F.split(norm_key(c), " ")), "")


def jaccard(a: Column, b: Column) -> Column:
    """Likeness of two sets; two empty ones are alike."""
    whole = F.size(F.array_union(a, b))
    return F.when(whole == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / whole)


def prepared(df: DataFrame, title: str, text: str, company: str) -> DataFrame:
    """Rows with what pairs are compared by: keys of title and company, word set of the text. Done
    before rows are paired, so it costs once a row and not once a pair."""
    blank = F.coalesce(F.col(company), F.lit(""))
    return df.withColumns({title: norm_key(F.col(title)), text: token_set(F.col(text)), company: norm_key(blank)})


def _compared(pairs: DataFrame, kinds: Sequence[tuple[str, object]], values: DataFrame | None = None) -> DataFrame:
    """``pairs`` with the likeness of each column ``{c}_a`` and ``{c}_b`` as ``__{c}``. Each two values
    that meet are compared once, however many pairs have them; nulls have no likeness. If rows
    ``values`` are given that hold all values, and these are so few that each with each may be
    broadcast, all of them are compared and ``pairs`` are not made a first time to see which meet."""
    each = pairs.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(f"{c}_a").alias("x"), F.col(f"{c}_b").alias("y")) for c, _ in kinds])).alias("p")).select("p.*")
    if values is not None:
        own = values.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("x")) for c, _ in kinds])).alias("p")).select("p.*")
        own = checkpointed(own.where("x IS NOT NULL").distinct())
        if (own.groupBy("c").count().agg(F.max(F.col("count") * F.col("count"))).first()[0] or 0) <= BROADCAST_ROWS:
            each = own.join(own.withColumnRenamed("x", "y"), "c")
    met = checkpointed(each.where("x IS NOT NULL AND y IS NOT NULL").distinct())
    for c, likeness in kinds:
        alike = met.where(F.col("c") == c).select(F.col("x").alias(f"{c}_a"), F.col("y").alias(f"{c}_b"), likeness(F.col("x"), F.col("y")).alias(f"__{c}"))
        pairs = pairs.join(bounded(alike), [f"{c}_a", f"{c}_b"], "left")
    return pairs


def score_pairs(pairs: DataFrame, title: str, text: str, company: str, salary: str, confidential: Sequence[str] = ("confidential", ""), values: DataFrame | None = None) -> DataFrame:
    """Weighted likeness of pairs of ``prepared`` rows, whose titles and companies ``values`` may hold. If a company is confidential its weight goes to
    title and text, 60 to 40; unequal salaries count by their ratio, missing ones by half."""
    a, b = F.col(f"{company}_a"), F.col(f"{company}_b")
    hidden = a.isin(*confidential) | b.isin(*confidential)
    x, y = F.col(f"{salary}_a"), F.col(f"{salary}_b")
    pay = F.when(x.isNull() | y.isNull(), 0.5).when(F.greatest(x, y) == 0, 1.0).otherwise(F.least(x, y) / F.greatest(x, y))
    w = WEIGHTS
    freed = F.when(hidden, w["company"]).otherwise(0.0)
    s_text = jaccard(F.col(f"{text}_a"), F.col(f"{text}_b"))
    s_company = F.when(hidden, 0.0).otherwise(F.col(f"__{company}") * w["company"])
    score = F.col(f"__{title}") * (w["title"] + freed * 0.6) + s_text * (w["text"] + freed * 0.4) + s_company + pay * w["salary"]
    near = _compared(pairs, [(title, title_likeness), (company, lambda a, b: with_window(similarity(a, b), a, b))], values)
    return near.select(*pairs.columns, F.round(score, 8).alias("score"))


def label_pairs(pairs: DataFrame) -> DataFrame:
    """Confirmed and probable pairs; others go."""
    label = F.when(F.col("score") >= CONFIRMED, "confirmed").when(F.col("score") >= PROBABLE, "probable")
    return pairs.withColumn("label", label).where("label IS NOT NULL")


def duplicate_groups(pairs: DataFrame) -> DataFrame:
    """(node, component) over the confirmed pairs."""
    return connected_components(label_pairs(pairs).where("label = 'confirmed'"))


def canonical(df: DataFrame, group: str, day: str, key: str) -> DataFrame:
    """The row of each group with the earliest day, then the smallest id."""
    return first_of(df, [group], [F.asc_nulls_last(day), F.asc(key)])


def dedup_fuzzy(df: DataFrame, key: str, cols: Sequence[str], block: Sequence[str], least: float) -> DataFrame:
    """One row of each group of rows in a block whose joined keys are like enough: the smallest id.

    Rows that share the whole key are one before pairs are made, so copies don't multiply, and only
    keys are compared that have a key in common as every pair so alike does. Null values of the block
    are a block.
    """
    rows = df.withColumn("__key", norm_key(F.concat_ws("|", *cols)))
    blocked = F.to_json(F.struct(*block)).alias("__block")
    first = checkpointed(rows.groupBy(*block, "__key").agg(F.min(key).alias("__id")).withColumn("__block", blocked))
    t, n = first.select("__block", F.col("__key").alias("__t"), F.col("__id").alias("a")), first.select("__block", F.col("__key").alias("__n"), F.col("__id").alias("b"))
    near = like_pairs(first.select("__block", "__key"), "__key", least, ["__block"]).where(similarity(F.col("__t"), F.col("__n")) >= least)
    pairs = near.join(t, ["__block", "__t"]).join(n, ["__block", "__n"]).select("a", "b")
    later = connected_components(pairs).where("node <> component").select(F.col("node").alias("__id"))
    kept = first.join(later, "__id", "left_anti").select(F.col("__id").alias(key))
    return df.join(kept, key, "left_semi")


def minhash(df: DataFrame, col: str, k: int = 3, perms: int = 128, out: str = "signature") -> DataFrame:
    """MinHash signature of a text's word k-shingles; null for texts without a word."""
    return df.withColumn(out, _signature(norm_key(F.col(col)), k, perms))


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def _mixed(x: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """The last steps of XXH64, in place."""
    for shift, prime in ((33, XXH64[1]), (29, XXH64[2]), (32, None)):
        np.right_shift(x, np.uint64(shift), out=spare)
        np.bitwise_xor(x, spare, out=x)
        if prime:
            np.multiply(x, np.uint64(prime), out=x)
    return x


def _signature(key: Column, k: int, perms: int) -> Column:
    """For each p below ``perms`` the smallest of ``xxhash64(xxhash64(s), p)``, as Spark computes it, over
    the runs s of ``k`` words of a search key (all its words, if they are fewer)."""

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def smallest(keys: pa.Array) -> pa.Array:
        p1, p2, p3, p4, p5 = (np.uint64(p) for p in XXH64)
        seeds = _turned(np.arange(perms, dtype=np.uint64) * p1, 23)[:, None]
        whole, other = np.empty((2, perms * HASHED), dtype=np.uint64)
        found = []
        for key in keys:
            text = (key.as_py() or "").encode()
            if not text:
                found.append(None)
                continue
            spaces = np.flatnonzero(np.frombuffer(text, dtype=np.uint8) == 32)
            starts, ends = [0, *(spaces + 1).tolist()], [*spaces.tolist(), len(text)]
            shingles = zip(starts, ends[k - 1 :] or ends[-1:])  # noqa: B905  as many as there are ends
            x = np.unique(np.frombuffer(b"".join([xxhash.xxh64_digest(text[i:j], 42) for i, j in shingles]), dtype=">u8").astype(np.uint64))
            x = _turned(x * p2, 31) * p1
            x = _turned(x ^ (np.uint64(42 + 8) + p5), 27) * p1 + p4
            x = _turned(_mixed(x, np.empty_like(x)) + (p5 + np.uint64(4)), 23)  # the hash of s alone, as the seed of that of p
            least = np.full(perms, np.iinfo(np.int64).max)
            for at in range(0, len(x), HASHED):
                some = x[at : at + HASHED]
                y, spare = (z[: perms * len(some)].reshape(perms, -1) for z in (whole, other))
                np.bitwise_xor(some, seeds, out=y)
                np.multiply(y, p2, out=y)
                np.add(y, p3, out=y)
                np.minimum(least, _mixed(y, spare).view(np.int64).min(axis=1), out=least)
            found.append(least)
        return pa.array(found, pa.list_(pa.int64()))

    return smallest(key)


def estimated_jaccard(a: Column, b: Column) -> Column:
    """Share of equal places of two signatures."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / F.size(a)


def minhash_candidates(first: DataFrame, key: str, signature: str, least: float, perms: int = 128) -> DataFrame:
    """Candidate pairs (a, b) that hold every two signatures of the likeness. Such signatures agree in
    ``ceil(least * perms)`` places at least, so in any order of all (place, value) they share one of
    the first ``perms - ceil(least * perms) + 1`` of each. Values go in order of how many signatures
    have them: one that a common line puts into very many signatures comes last, and is a key of those
    only that have little else. A value of one signature alone takes its place and is no key, so only
    the others are brought together by signature. Place and value go as one hash; if two ever had the
    same one, there would be more candidates and no fewer."""
    keys = perms - math.ceil(least * perms - 1e-9) + 1
    each = first.select(F.col(key).alias("id"), F.posexplode(signature).alias("place", "value")).select("id", F.xxhash64("place", "value").alias("value"))
    often = each.groupBy("value").agg(F.count("*").alias("n")).where("n > 1")
    counted = each.join(often, "value").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "value"))).alias("found"))
    found = F.slice("found", F.lit(1), F.greatest(F.lit(0), F.size("found") - (perms - keys)))
    placed = checkpointed(counted.select("id", F.explode(found).alias("k")).select("id", "k.value"))
    a, b = (placed.select(F.col("id").alias(x), "value") for x in "ab")
    return a.join(b, "value").where("a < b").select("a", "b").distinct()


def minhash_pairs(df: DataFrame, key: str, signature: str, least: float, perms: int = 128) -> DataFrame:
    """All pairs whose estimated likeness is high enough. Rows with one whole signature stand for each
    other: pairs join distinct signatures, and every other row is paired with the first of its own.
    Signatures are computed once and kept."""
    df = checkpointed(df.select(key, signature))
    first = checkpointed(df.where(F.col(signature).isNotNull()).groupBy(signature).agg(F.min(key).alias("__first")))
    near = minhash_candidates(first, "__first", signature, least, perms)
    for x in "ab":
        near = near.join(first.select(F.col("__first").alias(x), F.col(signature).alias(f"s{x}")), x)
    near = near.select("a", "b", estimated_jaccard(F.col("sa"), F.col("sb")).alias("likeness")).where(F.col("likeness") >= least)
    same = df.join(first, signature).where(F.col(key) != F.col("__first")).select(F.col("__first").alias("a"), F.col(key).alias("b"), F.lit(1.0).alias("likeness"))
    return near.union(same)
