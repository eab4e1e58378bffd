"""Operators that are DataFrame operations only, and the SQL of the subpackage."""

import pytest
from helpers import differences

from vacantia.llm import decontaminate as dc
from vacantia.llm import licenses as lic
from vacantia.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_oracle(spark, name):
    assert differences(spark, queries.queries()[name], queries.oracle_sql()[name]) == ""


@pytest.mark.parametrize("name", ["op2_decontaminate", "op6_licenses"])
def test_plans_hold_no_python(spark, name):
    plan = queries.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


ITEM = "the quick brown fox jumps over the lazy dog while seven wise owls watch from the old oak tree above"


def leaked(spark, texts, items=(ITEM,)):
    docs = spark.createDataFrame([(i, t, 1, "s") for i, t in enumerate(texts)], "doc_id long, text string, at int, seed string")
    bench = spark.createDataFrame([(i, t, 1) for i, t in enumerate(items)], "item_id long, text string, place int")
    return {(r["doc_id"], r["item_id"]): (r["score"], r["start"], r["end"], r["matched"]) for r in dc.leaks(docs, bench).collect()}


def test_leaks_with_substitutions(spark):
    words = ITEM.split()
    every_sixth = " ".join("xx" if i % 6 == 5 else w for i, w in enumerate(words))
    shout = ITEM.upper().replace(" ", ", ")
    part = " ".join(words[:12])
    texts = [f"before {ITEM} after", every_sixth, shout, part, " ".join(words[:7]), None, "", "clean text of other words " * 400, " ".join(sorted(words))]
    got = leaked(spark, texts)
    assert sorted(d for d, _ in got) == [0, 1, 2, 3]
    assert got[0, 0] == (20, 1, 21, 20) and got[1, 0][3] == 17


def test_leaks_both_ways_of_joining(spark, monkeypatch):
    texts = [f"{ITEM} {ITEM}", "x " * 3_000 + ITEM, "nothing here"]
    items = (ITEM, ITEM, "too short", None, "one two three four five six seven eight nine ten eleven")
    small = leaked(spark, texts, items)
    monkeypatch.setattr(dc, "BROADCAST_TOKENS", 0)
    assert leaked(spark, texts, items) == small
    assert sorted(small) == [(0, 0), (0, 1), (1, 0), (1, 1)]
    assert leaked(spark, texts, ()) == {} and leaked(spark, ()) == {}


def test_items_of_every_size(spark):
    items = ("one two three four five six", "Seven, eight", "nine", None, "", "alpha beta gamma delta epsilon zeta eta theta iota", "p q r s")
    texts = ["x one two three four five six y", "one two three four five sixx", "seven eight", "so seven eight nine", "NINE! nine", "one two three four five six " * 2, "beta alpha beta gamma delta epsilon zeta eta theta iota", "alpha beta gamma delta other zeta eta theta iota", "alpha other gamma delta other zeta eta theta iota", "beta gamma delta epsilon zeta eta theta iota", "a p q r s b", "p q r t", "one two x four five x"]
    got = leaked(spark, texts, items)
    assert got == {
        (0, 0): (6, 1, 7, 6), (1, 0): (5, 0, 5, 5), (2, 1): (2, 0, 2, 2), (3, 1): (2, 1, 3, 2), (3, 2): (1, 3, 4, 1), (4, 2): (1, 0, 1, 1), (5, 0): (6, 0, 6, 6),
        (6, 5): (9, 1, 10, 9), (7, 5): (7, 0, 9, 8), (9, 5): (8, 0, 8, 8), (10, 6): (4, 1, 5, 4),
    }


def test_short_items_against_sql(spark):
    """All sizes from 1 to 14 tokens, with and without substitutions, against the SQL."""
    import random

    import duckdb

    rnd = random.Random(3)
    items = [" ".join(rnd.choices("abcdefgh", k=n)) for n in range(1, 15) for _ in range(2)]
    texts = []
    for t in items:
        for subs in (0, 1, 2):
            w = t.split()
            for i in rnd.sample(range(len(w)), min(subs, len(w))):
                w[i] = "zz"
            texts.append(" ".join(rnd.choices("mnop", k=rnd.randrange(4)) + w + rnd.choices("mnop", k=rnd.randrange(4))))
    texts += [" ".join(rnd.choices("abcdefgh", k=30)) for _ in range(20)] + [None, ""]
    con = duckdb.connect()
    for name, key, rows in (("documents", "doc_id", texts), ("benchmark", "item_id", items)):
        con.execute(f"CREATE TABLE {name} ({key} BIGINT, text VARCHAR)")
        con.executemany(f"INSERT INTO {name} VALUES (?, ?)", list(enumerate(rows)))
    want = {(r[0], r[1]): tuple(r[2:6]) for r in con.execute(f'SELECT doc_id, item_id, score, "start", "end", matched FROM ({dc.report_sql()})').fetchall()}
    got = leaked(spark, texts, items)
    missed = {k for k in want if k not in got}
    # masks are meant to find nearly all of the longer ones
    assert {k: got[k] for k in got} == {k: want[k] for k in got} and all(len(items[i].split()) >= 10 for _, i in missed) and len(missed) <= 2


def test_many_alignments_of_many_items(spark):
    """Boilerplate that all items share: rows of alignments stay small."""
    same = "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12"
    items = tuple(f"{same} item {i}" for i in range(40))
    got = leaked(spark, [f"{same} " * 300, "clean"], items)
    assert set(got) == {(0, i) for i in range(40)} and set(got.values()) == {(12, 0, 12, 12)}


def test_long_text_full_of_hits(spark):
    """A position once carried its whole text."""
    words = ITEM.split()
    text = " ".join(" ".join(words[i % 18 : i % 18 + 2]) + f" z{i}" for i in range(66_000)) + " " + ITEM
    assert leaked(spark, [text, ITEM])[0, 0] == (20, 198_000, 198_020, 20)
    several = " ".join([ITEM] * 3_000)
    assert leaked(spark, [several])[0, 0] == (20, 0, 20, 20)


def test_license_edges(spark):
    texts = [None, "", "...", "MIT License", "mit, LICENSE mit license", "gnu general public", "CC-BY 4.0 and cc by", "the apache\nlicense, Version 2.0 " * 3_000, "licensé mit licensé"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*texts, "MIT License"])], "doc_id long, text string, licenses string")
    got = {r["doc_id"]: r for r in lic.report(docs).collect()}
    assert [got[i]["n_words"] for i in range(4)] == [0, 0, 0, 2]
    assert [(got[i]["n_base"], got[i]["base_labels"]) for i in (0, 3, 4, 5, 9)] == [(0, ""), (1, "mit"), (2, "mit"), (0, ""), (1, "mit")]
    assert (got[4]["first_word"], got[4]["last_word"], got[5]["first_word"]) == (0, 2, None)
    assert got[6]["n_base"] == 2 and "cc-by" in got[6]["labels"]
    assert got[7]["n_base"] == 3_000 and got[7]["labels"] == "apache,apache-2.0"
    assert got[8]["n_base"] == 0 and got[8]["score"] == 0.0
    assert lic.report(docs.limit(0)).count() == 0
