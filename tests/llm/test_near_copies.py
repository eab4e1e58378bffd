"""Classes of near copies against brute-force Jaccard of five-word shingles."""

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline as cp

from vacantia.llm import near_copies


def brute_sets(texts):
    out = {}
    for d, t in texts.items():
        words = (t or "").lower().split()
        out[d] = frozenset(" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()
    return out


def alike(a, b):
    return a == b or 10 * len(a & b) >= 8 * len(a | b)


def brute_classes(texts):
    sets, root = brute_sets(texts), {d: d for d in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            low, high = sorted((len(sets[a]), len(sets[b])))
            if 10 * low >= 8 * high and alike(sets[a], sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in texts}


def classes(df):
    return {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(df).collect()}


def test_whole_table_against_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute_classes({r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()})
    assert classes(df) == want
    assert len(set(want.values())) < len(want)


@pytest.mark.parametrize("heavy", [64, 3])
def test_changed_copies_chains_and_edges(spark, monkeypatch, heavy):
    monkeypatch.setattr(near_copies, "HEAVY", heavy)
    rnd = random.Random(4)
    texts = {0: None, 1: "", 2: " \t", 3: "One two", 4: "one  TWO", 5: "one two three"}
    base = [f"w{rnd.randrange(500)}" for _ in range(120)]
    for d in range(10, 70):  # a chain: each is a copy of the last with a few words changed
        if d % 20 == 0:
            base = [f"w{rnd.randrange(500)}" for _ in range(rnd.randrange(6, 150))]
        base[rnd.randrange(len(base))] = f"x{d}"
        texts[d] = " ".join(base)
    line = " ".join(f"common{i}" for i in range(30))
    for d in range(100, 140):  # one passage in texts that are otherwise different
        texts[d] = " ".join([*(f"u{rnd.randrange(9999)}" for _ in range(rnd.randrange(5, 12))), line])
    for d in range(200, 290):  # a group around one text, most members too far from each other
        words = [f"g{i}" for i in range(80)]
        for _ in range(rnd.randrange(6)):
            words[rnd.randrange(80)] = f"y{rnd.randrange(9999)}"
        texts[d] = " ".join(words)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    assert classes(df) == brute_classes(texts)
    assert classes(df.limit(0)) == {}


def test_pipeline_leaves_no_near_copies(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = dict(cp.STAGES)["simhash"](spark, docs, "/root/testdata/sf0.01")
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert len(set(brute_classes(texts).values())) == len(texts)
