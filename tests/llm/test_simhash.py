import re

import numpy as np
import pytest
import xxhash

from vacantia.llm import simhash


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(prints):
    """id -> smallest id reached, from {id: fingerprint}."""
    fps = sorted(set(prints.values()))
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    arr = np.array(fps, dtype=np.uint64)
    for i, f in enumerate(fps):
        for j in np.flatnonzero(np.bitwise_count(arr[i + 1 :] ^ arr[i]) <= 4):
            a, b = find(f), find(fps[i + 1 + j])
            root[max(a, b)] = min(a, b)
    least = {}
    for d in sorted(prints):
        least.setdefault(find(prints[d]), d)
    return {d: least[find(f)] for d, f in prints.items()}


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, id string, fp string, component string")
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.report(df).collect()}
    prints = {r[0]: brute_fingerprint(r[1]) for r in rows}
    classes = brute_classes(prints)
    assert got == {d: (f"{prints[d]:016x}", classes[d]) for d in prints}
    return got


def test_whole_table_against_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = check(spark, [(r["doc_id"], r["text"], "x", "y", "z") for r in df.select("doc_id", "text").collect()])
    assert len({c for _, c in got.values()}) < len(got)


def test_edges_of_input(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one  TWO"), (6, "a b c d"), (7, "a b c d " * 70_000), (9, "é\x0b É"), (8, "é É")]
    got = check(spark, [(*r, None, None, None) for r in rows])
    assert got[3] == ("0" * 16, 1) and got[5][1] == 4
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.report(empty).count() == 0
    twice = spark.createDataFrame([(5, "x y z w v"), (5, "x y z w v"), (6, "x y z w v")], "doc_id long, text string")
    assert sorted(r["component_id"] for r in simhash.report(twice).collect()) == [5, 5, 5]


@pytest.mark.parametrize("split", [50_000, 3])
def test_links_of_dense_and_random_prints(spark, monkeypatch, split):
    monkeypatch.setattr(simhash, "SPLIT", split)
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 2**63, 150, dtype=np.uint64)
    prints = []
    for s in seeds:
        for _ in range(8):
            f = int(s)
            for b in rng.integers(0, 64, rng.integers(0, 7)):
                f ^= 1 << int(b)
            prints.append(f)
    prints = dict(enumerate(dict.fromkeys(prints)))
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in prints.values()], "fp long")
    links = simhash.links(df, 4).collect()
    root = {f: f for f in prints.values()}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in links:
        a, b = (x % 2**64 for x in (r["a"], r["b"]))
        assert (a ^ b).bit_count() <= 64
        root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for d in sorted(prints):
        least.setdefault(find(prints[d]), d)
    assert {d: least[find(f)] for d, f in prints.items()} == brute_classes(prints)


def test_traversal_without_shortcuts():
    rng = np.random.default_rng(5)
    fp = np.unique(rng.integers(0, 2**12, 700, dtype=np.uint64) << np.uint64(40))
    member, first = simhash.trie_links(np.zeros(len(fp), dtype=np.int64), fp, 0)
    assert len(member) == len(fp) - 1 and (first < member).all()
