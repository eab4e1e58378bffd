import math
import re
import zlib
from hashlib import sha256

import numpy as np
import pyarrow as pa

from vacantia.llm import resample as rs

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def buckets(text):
    w = WORD.findall((text or "").translate(LOW))
    runs = [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]
    return len(w), [zlib.crc32(r.encode()) % 10_000 for r in runs]


def brute(docs, target, least=20):
    s, t = np.zeros(10_000, int), np.zeros(10_000, int)
    for texts, into in ((d[1] for d in docs), s), (target, t):
        for x in texts:
            np.add.at(into, buckets(x)[1], 1)
    S, T = float(s.sum()), float(t.sum())
    gain = [math.floor(1000 * math.log((float(b) + 1) * (S + 10_000) / ((float(a) + 1) * (T + 10_000)))) for a, b in zip(s, t)]
    out = []
    for d, x in docs:
        n, found = buckets(x)
        h = int(sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        out.append([d, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    rank = {id(r): i + 1 for i, r in enumerate(able[: len(able) * 5 // 100])}
    return sorted(((r[0], *r[2:], rank.get(id(r))) for r in out), key=str)


def ours(docs, target, **kw):
    return sorted((tuple(r) for r in rs.resample(docs, target, **kw).drop("n_words").collect()), key=str)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    target = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    expected = brute([(r["doc_id"], r["text"]) for r in docs.collect()], [r["text"] for r in target.collect()])
    assert ours(docs.repartition(7), target) == expected
    # by rounds alone, a few keys to a median
    assert ours(docs.repartition(3), target, chunk=50, direct=1) == expected


def test_odd_rows(spark):
    long_text = "mit " * 30
    rows = [(1, None), (2, ""), (None, long_text), (None, None), (3, long_text), (3, long_text), (4, "w" * 5000 + " " + "x" * 64 + " y"), (5, "ÀB é b 漢字 CAFÉ"), (6, "one two")]
    rows += [(100 + i, f"{long_text} {i}") for i in range(60)]
    docs = spark.createDataFrame([(*r, 9, 1.0) for r in rows], "doc_id long, text string, score long, rank double")
    target = spark.createDataFrame([(1, "mit licence"), (2, None), (3, "")], "item_id long, text string")
    assert ours(docs, target) == brute(rows, ["mit licence", None, ""])
    assert ours(docs, target.limit(0), direct=1, chunk=1) == brute(rows, [])
    assert ours(docs.limit(0), target) == []
    assert all(r[-1] is None for r in ours(docs.where("doc_id < 7"), target))


def test_equal_keys_are_all_told_apart(spark):
    docs = spark.createDataFrame([(7, "a b c d e f g h i j k l m n o p q r s t")] * 400 + [(None, "u " * 20)] * 100, "doc_id long, text string")
    got = ours(docs, docs.limit(1), chunk=20, direct=1)
    assert sorted(r[-1] for r in got if r[-1]) == list(range(1, 26))


def test_checksums_of_any_split():
    data = np.random.default_rng(1).integers(0, 256, 100_000, dtype=np.uint8)
    start = np.array([0, 5, 9, 60, 1000, 1048, 20_000])
    end = np.array([1, 9, 57, 109, 1063, 1112, 100_000])
    t = rs.Checksums.tables()
    crc = t.of(data, start, end)
    assert crc.tolist() == [zlib.crc32(data[a:b]) for a, b in zip(start, end)]
    joined = t.joined(t.spaced(crc[:-1]), crc[1:], (end - start)[1:])
    assert joined.tolist() == [zlib.crc32(data[start[i] : end[i]].tobytes() + b" " + data[start[i + 1] : end[i + 1]].tobytes()) for i in range(6)]


def test_blocks_of_words(monkeypatch):
    texts = pa.array(["a b c d e", None, "f", "", "g h"])
    whole = [np.concatenate([f[k] for _, _, _, f in rs.feature_buckets(texts)]).tolist() for k in range(3)]
    monkeypatch.setattr(rs, "BLOCK", 2)
    assert [np.concatenate([f[k] for _, _, _, f in rs.feature_buckets(texts)]).tolist() for k in range(3)] == whole


def test_pivot_leaves_a_quarter_on_either_side():
    rng = np.random.default_rng(3)
    parts = [np.stack([rng.integers(0, 50, n), rng.integers(0, 9, n), np.arange(n) + 10_000 * n]) for n in (1, 7, 300, 301, 4000)]
    pivot = rs.weighted_median([(rs._median(p), p.shape[1]) for p in parts])
    first, total = sum(int(rs._before(p, pivot).sum()) for p in parts), sum(p.shape[1] for p in parts)
    assert total / 4 - 1 <= first <= 3 * total / 4
