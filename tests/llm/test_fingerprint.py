from hashlib import sha256

from vacantia.llm import fingerprint as fp


def brute(rows):
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    placed, out = [r for r in rows if r[0] is not None], []
    for i, (d, t) in enumerate(rows):
        after = placed[(i + 1) % len(placed)][1] if d is not None else t
        n = len(t) // 4
        e = t[: len(t) - n] + after[:n]
        a, b, c = (fp.digest(x.encode()) for x in (t, e, after))
        out.append((d, len(t), sha256(e.encode()).hexdigest(), a, b, round(fp.likeness(a, b), 9), round(fp.likeness(a, c), 9)))
    return sorted(out, key=str)


def ours(df, **kw):
    return sorted(((*tuple(r)[:5], round(r[5], 9), round(r[6], 9)) for r in fp.against_neighbours(df, **kw).collect()), key=str)


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    got = ours(df, batch_bytes=200_000)
    assert got == brute(rows)
    longer = [r for r in got if r[1] > 200]
    assert sum(r[5] > r[6] for r in longer) > 0.9 * len(longer)


def test_edges_of_input(spark):
    rows = [(5, None), (1, ""), (2, "a"), (3, "ab"), (None, "no id"), (None, None), (4, "é" * 30), (4, "é" * 30), (9, "long text " * 20_000)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, batch int, guest string")
    for size in (1 << 24, 9_000):
        assert ours(df, batch_bytes=size) == brute(rows)
    assert fp.against_neighbours(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert ours(spark.createDataFrame([(1, "only one here")], "doc_id long, text string")) == brute([(1, "only one here")])


def test_difference_is_bounded_and_symmetric():
    a, b = fp.digest(b"the first of two texts " * 9), fp.digest(bytes(range(256)) * 4)
    assert fp.difference(a, a) == 0 and len(a) == 68
    assert 0 < fp.difference(a, b) == fp.difference(b, a) <= fp.BOUND
    near = fp.digest(b"the first of two texts " * 8 + b"the first of 2 texts")
    assert fp.likeness(a, near) > fp.likeness(a, b)
