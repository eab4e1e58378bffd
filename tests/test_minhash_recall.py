"""MinHash pairs against all pairs of signatures."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vacantia.operators import dedup
from vacantia.plans import dedup_queries
from vacantia.sources.scratch import checkpointed


@pytest.mark.parametrize("least", [0.5, 0.8])
def test_pairs_against_brute_force(spark, least):
    rnd = random.Random(7)
    texts = []
    for _ in range(150):
        words = [f"w{rnd.randrange(5_000)}" for _ in range(60)]
        texts.append(" ".join(words))
        for i in rnd.sample(range(60), 6):
            words[i] = "other"
        texts.append(" ".join(words))
    signed = dedup.minhash(spark.createDataFrame(list(enumerate(texts)), "id int, t string"), "t").select("id", "signature")
    signed = checkpointed(signed)
    a, b = (signed.select(F.col("id").alias(x), F.col("signature").alias(f"s{x}")) for x in "ab")
    likeness = dedup.estimated_jaccard(F.col("sa"), F.col("sb"))
    want = {tuple(r) for r in a.crossJoin(b).where("a < b").where(likeness >= least).select("a", "b").collect()}
    got = [(r["a"], r["b"]) for r in dedup.minhash_pairs(signed, "id", "signature", least).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert least > 0.5 or len(want) > 50


def test_whole_table_against_all_pairs(spark):
    d = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], tuple(r["signature"])) for r in dedup_queries._signatures(spark, d).where("signature IS NOT NULL").collect()]
    first = {}
    for i, s in sorted(rows):
        first.setdefault(s, i)
    ids, m = np.array(list(first.values())), np.array(list(first))
    want = {}
    for i in range(len(ids)):
        same = (m[i] == m[i + 1 :]).mean(axis=1)
        want |= {tuple(sorted((int(ids[i]), int(ids[i + 1 + j])))): float(same[j]) for j in np.flatnonzero(same >= 0.5)}
    want |= {(first[s], i): 1.0 for i, s in rows if first[s] != i}
    got = {(r["a"], r["b"]): r["likeness"] for r in dedup_queries.QUERIES["d03_minhash"][0](spark, d).collect()}
    assert got == want and len(want) > 100


def test_signatures_are_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def see(i):
        seen.add(1)
        return [i % 3] * 4

    df = spark.range(12, numPartitions=2).select("id", F.udf(see, "array<long>").asNondeterministic()("id").alias("s"))
    assert dedup.minhash_pairs(df, "id", "s", 0.5, perms=4).count() == 9
    assert seen.value == 12


def test_signatures_are_those_of_sparks_hash(spark):
    """Also of texts that are shorter than a shingle, longer than what is hashed at once, or not ASCII;
    and no task computes them one expression a place."""
    rnd = random.Random(9)
    texts = [None, "", "?!", "one", "One, two", "a b c", "b  c\td", "Ёлки-палки 東京 é ß x", "same " * 700, *(" ".join(f"w{rnd.randrange(400)}" for _ in range(n)) for n in (dedup.HASHED + 1, dedup.HASHED + 2, dedup.HASHED + 3, 900))]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    words = F.array_remove(F.split(dedup.norm_key(F.col("t")), " "), "")
    cut = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 2, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice("w", i, 3), " ")))
    place = lambda p: F.array_min(F.transform("s", lambda h: F.xxhash64(h, F.lit(p))))
    want = df.withColumn("w", words).withColumn("s", cut).select("id", F.when(F.size("w") > 0, F.array(*map(place, range(128)))).alias("signature"))
    got = dedup.minhash(df, "t").select("id", "signature")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.where("signature IS NULL").count() == 3
    assert "ArrowEvalPython" in got._jdf.queryExecution().executedPlan().toString()
