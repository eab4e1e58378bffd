"""Selection by counts against sorting."""

import random

import pytest
from pyspark.sql import functions as F

from vacantia.operators import report
from vacantia.operators.selection import kth


@pytest.mark.parametrize("limit", [0, 5, 100_000])
def test_kth(spark, limit):
    rnd = random.Random(1)
    rows = [(rnd.choice(["a", "b", None]), rnd.choice([rnd.random(), 0.5, 0.25])) for _ in range(3000)] + [("one", 1.0)] * 50 + [("none", None)] * 9 + [("few", 3.0)]
    groups = {}
    for g, v in rows:
        if v is not None:
            groups.setdefault(g, []).append(v)
    places = {g: rnd.randrange(len(vs)) for g, vs in groups.items()} | {"few": 4}
    df = spark.createDataFrame([(g, v, places.get(g, 0)) for g, v in rows], "g string, v double, k int").repartition(5)
    got = {r["g"]: r["kth"] for r in kth(df, ["g"], F.col("v"), F.col("k"), limit).collect()}
    assert got == {g: sorted(vs)[places[g]] for g, vs in groups.items() if places[g] < len(vs)}


def test_medians_with_two_statuses(spark, monkeypatch):
    import vacantia.operators.selection as selection

    monkeypatch.setattr(selection.kth, "__defaults__", (50,))
    df = spark.range(20_000).select((F.col("id") % 2).alias("status"), F.when(F.col("id") % 7 > 0, (F.col("id") * 7919) % 10_007).alias("score"))
    rows = [(r["status"], r["score"]) for r in df.collect()]
    got = {r["status"]: (r["n"], r["upper_median"]) for r in report.snapshot_metrics(df, "status", "score").collect()}
    for s in (0, 1):
        scores = sorted(v for t, v in rows if t == s and v is not None)
        assert got[s] == (10_000, scores[len(scores) // 2])


def test_sample_of_repeated_keys(spark):
    rows = [(1, "a", "x")] * 40 + [(i, "a", "y") for i in range(100)] + [(i, None, None) for i in range(30)] + [(None, "b", "x")] * 3
    df = spark.createDataFrame(rows, "k int, src string, st string")
    got = report.stratified_sample(df, "k", "src", "st", 60, 4, {"x": 0.5, "y": 0.5}).collect()
    counts = {}
    for r in got:
        counts[r["src"], r["st"]] = counts.get((r["src"], r["st"]), 0) + 1
    quota = max(4, round(140 * 60 / 173))
    assert counts == {("a", "x"): -(-quota // 2), ("a", "y"): -(-quota // 2), ("b", "x"): 2}
