from hashlib import sha256

from hypothesis import given
from hypothesis import strategies as st

from vacantia.llm import chat_tree as ct


@given(st.lists(st.tuples(st.text(), st.lists(st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "\\", "s>", "<", "x\n"])).map("".join))))
def test_reads_back_any_turns(turns):
    assert ct.read_turns("".join(ct.format_turn(*t)[0] for t in turns)) == turns


def expected(rows):
    out = {}
    for c in {r[0] for r in rows}:
        turns = sorted(((-1 if t is None else t, r or "", x or "") for d, t, r, x in rows if d == c))
        said = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        trained = "".join(x for _, r, x in turns if r == "assistant")
        chars = sum(len(ct.format_turn(r, x)[0]) for _, r, x in turns)
        out[c] = (len(turns), sha256(said.encode()).hexdigest(), len(trained), sha256(trained.encode()).hexdigest(), chars)
    return out


def test_edges_and_sharing(spark, monkeypatch):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes </s>"), (2, 0, "user", "hi"), (2, 1, "assistant", "no"), (3, 0, "user", "hi"), (3, 1, "assistant", "no"), (3, 2, "user", "why")]
    rows += [(4, None, None, None), (4, 2, "user", "é\\n"), (5, 1, "b", "tie"), (5, 1, "a", "tie"), (5, 1, "a", "tie"), (6, 0, "user", "long " * 90_000)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, nodes int, path string")
    for ends in (512, 1):
        monkeypatch.setattr(ct, "PACK_ENDS", ends)
        packs = ct.pack(df.coalesce(1))
        got = {r["conv_id"]: tuple(r)[1:] for r in ct.read_back(packs).collect()}
        assert got == expected(rows)
    monkeypatch.setattr(ct, "PACK_ENDS", 512)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        (one,) = [p for p in ct.pack(df.where("conv_id < 4")).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert one["text"].count("]hi<") == 1 and one["text"].count("]no<") == 1 and len(one["nodes"]) == 4
    assert ct.read_back(ct.pack(df.limit(0))).count() == 0
