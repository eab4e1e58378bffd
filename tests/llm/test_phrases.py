import random
import re
from hashlib import sha256

import numpy as np
import pyarrow as pa

from helpers import differences
from vacantia.llm import phrases

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, size=13):
    rows = [(d, WORD.findall(t or "")) for d, t in rows]
    first = {}
    for d, w in rows:
        for i in range(len(w) - size + 1) if d is not None else ():
            key = tuple(w[i : i + size])
            first[key] = min(d, first.get(key, d))
    out = []
    for d, w in rows:
        gone = set()
        for i in range(len(w) - size + 1) if d is not None else ():
            if first[tuple(w[i : i + size])] < d:
                gone.update(range(i, i + size))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def ours(df, **kw):
    if not kw:
        return sorted((tuple(r) for r in phrases.report(df).collect()), key=str)
    rows = phrases.remove_passages(df, **kw).collect()
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], sha256(r["kept"].encode()).hexdigest()) for r in rows), key=str)


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    expected = brute(rows)
    assert sum(r[2] for r in expected) > 1000
    assert ours(df.repartition(5)) == expected
    assert ours(df, batch_bytes=40_000) == expected
    assert ours(df, batch_bytes=300_000, size=5) == brute(rows, 5)


def test_sql(spark):
    assert differences(spark, lambda s, d: phrases.report(s.read.parquet(f"{d}/documents.parquet")), phrases.report_sql()) == ""


def test_odd_rows(spark):
    rng = random.Random(2)
    words = ["a", "b", "é", " ", " x", "日本", "퟿", "w" * 3000, "\x1f"]
    some = [" ".join(rng.choices(words, k=40)) for _ in range(4)]
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, some[0]), (None, None), (4, some[0]), (4, some[0]), (5, some[0] + "\n" + some[1]), (6, "a " * 500), (7, " a" * 900), (8, "b " + "a " * 12), (9, "a\x0b" * 13)]
    rows += [(10 + i, " ".join(rng.choices(["a", "b"], k=rng.randrange(60)))) for i in range(300)]
    rows += [(400 + i, f"{i} {some[2]} {i} " + some[3][: rng.randrange(60)]) for i in range(200)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, kept string, n_words int")
    expected = brute(rows)
    assert ours(df) == expected
    assert ours(df, batch_bytes=3_000) == expected
    assert ours(df, batch_bytes=100) == expected
    assert ours(df.limit(0)) == []
    assert ours(df.where("doc_id IS NULL")) == brute([r for r in rows if r[0] is None])


def test_several_automata(spark, monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(rng.choices("abc", k=80)) for _ in range(30)]
    texts += [" ".join(rng.choices(texts, k=2)) for _ in range(30)]
    batch = phrases.Batch(list(range(60)), pa.chunked_array([texts]), 13)
    sketch = batch.sketch(7)
    replies = {b: np.packbits(np.zeros(int(j - i), np.uint8)).tobytes() for b, i, j in zip(sketch.buckets.tolist(), sketch.cuts, sketch.cuts[1:])}
    one = phrases.removed_words(batch, sketch, replies)
    monkeypatch.setattr(phrases, "AUTOMATON_WORDS", 100)
    monkeypatch.setattr(phrases, "PIECE", 3)
    assert (phrases.removed_words(batch, sketch, replies) == one).all()
    expected = brute(list(enumerate(texts)))
    assert sorted(np.add.reduceat(one, batch.first[:-1]).tolist()) == sorted(r[2] for r in expected)
