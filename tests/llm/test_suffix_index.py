import random
from hashlib import sha256

import pytest

from vacantia.llm import suffix_index

N = 50


def brute(rows):
    """doc_id -> (n_bytes, n_removed, n_spans, digest), rows of one id in order."""
    least = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - N + 1):
            w = b[i : i + N]
            least[w] = min(d, least.get(w, d))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - N + 1):
            if least[b[i : i + N]] < d:
                gone[i : i + N] = b"\x01" * N
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), spans, sha256(kept).hexdigest()))
    return sorted(out)


def ours(spark, rows, batch_bytes):
    df = spark.createDataFrame([(*r, 1, "k", "s") for r in rows], "doc_id long, text string, __batch int, kept string, spans string").repartition(3)
    got = suffix_index.remove_repeats(df, batch_bytes=batch_bytes).collect()
    out = []
    for r in got:
        kept = bytes(r["kept"])
        out.append((r["doc_id"], len((r["text"] or "").encode()), sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]), sha256(kept).hexdigest()))
    return sorted(out)


def test_whole_table_against_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    got = sorted(tuple(r) for r in suffix_index.report(df).collect())
    assert got == brute(rows)
    assert sum(r[2] for r in got) > 0


@pytest.mark.parametrize("segment", [suffix_index.SEGMENT, 700])
def test_batches_and_segments(spark, monkeypatch, segment):
    rnd = random.Random(segment)
    base = ["".join(rnd.choice("ab é") for _ in range(rnd.randint(0, 400))) for _ in range(6)]
    rows = []
    for d in range(60):
        parts = [rnd.choice(base)[rnd.randint(0, 80) :][: rnd.randint(1, 300)] if rnd.random() < 0.6 else "".join(rnd.choice("xyz ") for _ in range(90)) for _ in range(rnd.randint(0, 6))]
        rows.append((d * 7 % 61, "".join(parts)))
    rows += [(3, None), (200, ""), (201, "a" * 49), (202, "a" * 300), (203, "a" * 50), (204, "ab" * 1200), (205, "ab" * 900)]
    rows += [rows[5], rows[5], (rows[5][0], rows[5][1] + "tail")]
    monkeypatch.setattr(suffix_index, "SEGMENT", segment)
    assert ours(spark, rows, 2_000) == brute(rows)


def test_empty_and_unknown_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_index.report(empty).count() == 0
    df = spark.createDataFrame([(None, "q" * 80), (None, "q" * 80), (4, "q" * 80)], "doc_id long, text string")
    assert sorted(r["n_removed"] for r in suffix_index.report(df).collect()) == [0, 0, 0]


def test_levels_grow_geometrically():
    import numpy as np

    index = suffix_index.SuffixIndex()
    for i in range(40):
        key = np.sort(np.random.default_rng(i).integers(0, 2**40, 100, dtype=np.uint64))
        assert not index.add(key, key * np.uint64(77)).any()
        assert len(index.levels) <= 7
    key = np.sort(np.random.default_rng(3).integers(0, 2**40, 100, dtype=np.uint64))
    assert index.add(key, key * np.uint64(77)).all()
    assert len(index.whole().key) == 4000


def test_contexts_of_one_key_that_share_their_top_bits():
    """Only the smallest context of those that share 24 bits was found."""
    import numpy as np

    rng = np.random.default_rng(8)
    low = np.unique(rng.integers(0, 2**40, 3_000, dtype=np.uint64))
    context = np.sort(np.concatenate([(np.uint64(t) << np.uint64(40)) | low for t in (5, 6, 2**24 - 1)]))
    key = np.repeat(np.array([3, 9, 2**40 - 1], dtype=np.uint64), len(context))
    held, asked = np.tile(context[::2], 3), np.tile(context, 3)
    level = suffix_index.Level(np.repeat(np.array([3, 9, 2**40 - 1], dtype=np.uint64), len(context[::2])), held)
    assert level.holds(key, asked).tolist() == np.tile(np.arange(len(context)) % 2 == 0, 3).tolist()
    assert not level.holds(key + np.uint64(1) - np.uint64(2) * (key == 2**40 - 1), asked).any()


def test_a_seed_of_very_many_documents(spark, monkeypatch):
    """One passage in all documents, with other surroundings in each; most batches hold several."""
    import numpy as np

    monkeypatch.setattr(suffix_index, "BUCKET_BYTES", 20_000)
    rnd = random.Random(11)
    line = "".join(rnd.choice("qwrt ") for _ in range(130))
    rows = [(d, "".join(rnd.choice("xyz ") for _ in range(rnd.randint(20, 60))) + line[rnd.randint(0, 2) :] + "".join(rnd.choice("uvw ") for _ in range(40))) for d in range(400)]
    assert ours(spark, rows, 3_000) == brute(rows)
    entries = {k: np.zeros(500, dtype=np.uint64) for k in ("key", "context")} | {"rank": np.arange(500)}
    entries["context"] = np.arange(500, dtype=np.uint64)
    assert len(suffix_index.Dealt(entries, 7, True).keys) == 1 and len(suffix_index.Dealt(entries, 7, False).keys) == 500


def test_batches_are_many_and_even(spark):
    from pyspark.sql import functions as F

    from vacantia.llm.ranges import Ranges

    df = spark.range(400_000).select((F.col("id") * F.col("id")).alias("doc_id"), F.lit("x" * 100).alias("text"))
    ranges = Ranges(df, "doc_id", "text", 2_000)
    sizes = [r["count"] for r in df.groupBy(ranges.batch().alias("b")).count().collect()]
    assert len(sizes) == ranges.n == 20_000 and max(sizes) == 20
