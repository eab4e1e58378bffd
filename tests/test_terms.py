"""Joins of texts and terms against comparisons of all with all."""

import random

from pyspark.sql import functions as F

from vacantia.functions.text import any_word, norm_key
from vacantia.operators import matching, normalize, terms


def nested(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [x for x in ("NestedLoop", "CartesianProduct") if x in plan]


def texts_and_terms(rnd):
    texts = ["".join(rnd.choices("ab cé", k=rnd.randrange(40))) for _ in range(80)] + [None, "", "a", "needle in a haystack"]
    words = ["".join(rnd.choices("ab cé", k=rnd.randrange(1, 9))) for _ in range(60)] + ["", None, "a", "haystack", "needle in a haystack", "not there", "[.*"]
    return texts, words


def test_containing(spark, monkeypatch):
    texts, words = texts_and_terms(random.Random(1))
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    want = sorted((i, w) for i, t in enumerate(texts) for w in set(words) if t is not None and w and w in t)
    for rows in (terms.BROADCAST_ROWS, 3):
        monkeypatch.setattr(terms, "BROADCAST_ROWS", rows)
        got = terms.containing(df, "id", F.col("t"), spark.createDataFrame([(w,) for w in words], "w string"), "w")
        assert sorted((r["id"], r["term"]) for r in got.collect()) == want
    none = spark.createDataFrame([("",), (None,)], "w string")
    assert terms.containing(df, "id", F.col("t"), none, "w").count() == 0
    assert terms.containing(df, "id", F.col("t"), none.limit(0), "w").count() == 0
    assert terms.containing(df.limit(0), "id", F.col("t"), df, "t").count() == 0


def test_like_letters_miss_no_pair(spark):
    rnd = random.Random(2)
    some = ["".join(rnd.choices("abcd", k=rnd.randrange(1, 12))) for _ in range(120)]
    t = spark.createDataFrame([(x,) for x in set(some[:60])], "__t string")
    n = spark.createDataFrame([(x, x) for x in set(some[60:])], "__n string, name string")
    from vacantia.functions.text import similarity

    everything = t.crossJoin(n).where(similarity(F.col("__t"), F.col("__n")) >= 0.4).select("__t", "__n")
    found = terms.like_letters(t, n, 0.4).where(similarity(F.col("__t"), F.col("__n")) >= 0.4).select("__t", "__n")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, everything.collect()))


def test_no_nested_loop_at_many_terms(spark):
    many = spark.range(200_000).select(F.concat(F.lit("term "), F.col("id")).alias("term"), F.concat(F.lit("my "), F.col("id")).alias("common"), F.lit("1234").alias("code"), F.lit(None).cast("string").alias("context"), F.col("id").alias("place"), F.concat(F.lit("s"), F.col("id")).alias("sector"))
    df = spark.createDataFrame([(1, "a term 17 here", "none", "city, term 17x"), (2, "nothing", None, None), (3, None, "S5", "TERM 5")], "id int, title string, s string, place string")
    plans = {
        "n19": normalize.apply_dictionary(df, "id", "title", many),
        "n18": normalize.classify_activity(df, "id", "title", "s", many.withColumnRenamed("term", "keyword")),
        "n06": normalize.match_location(df, "place", many, "term", "common"),
        "m07": matching.dictionary_match(df, "id", "title", many),
        "m09": matching.resolve_label(spark.createDataFrame([(1, "Term 19999")], "id int, l string"), "l", many, "term", "code"),
        "m14": matching.fuzzy_match(df, "id", "title", many, "common", 0.5),
    }
    assert {k: nested(v) for k, v in plans.items()} == dict.fromkeys(plans, [])
    assert {r["id"]: r["rewritten"] for r in plans["n19"].collect()} == {1: "a my 17 here", 2: "nothing", 3: None}
    assert {r["id"]: r["code"] for r in plans["m07"].collect()} == {1: "1234"}
    assert {r["province"] for r in plans["n06"].collect()} == {"my 179", None, "my 5"}  # of equally like ones the last in order
    assert {r["resolved"] for r in plans["m09"].collect()} == {"term 19999"}


def test_prefixes(spark):
    df = spark.createDataFrame([("ab",), ("AB c",), (None,), ("zz",), ("a",)], "label string")
    names = spark.createDataFrame([("Abc", 1), ("abd e", 2), ("AB CD", 3), ("b", 4), (None, 5)], "n string, code int")
    got = {r["label"]: (r["resolved"], r["code"]) for r in matching.resolve_label(df, "label", names, "n", "code").collect()}
    assert got == {"ab": ("Abc", 1), "AB c": ("AB CD", 3), None: (None, None), "zz": (None, None), "a": ("Abc", 1)}


def test_keys_keep_all_letters(spark):
    rows = ["Straße  GROẞ", "Łódź, naïve café!", "Ёлки-палки; Київ", "東京 タワー", "Ａｂｃ １２３", "été", "Ñandú_x", "Ελλάδα ΆΣ", "الْعَرَبِيَّة", "", None, "İstanbul"]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    got = [r["k"] for r in df.select(norm_key(F.col("t")).alias("k")).collect()]
    assert got == ["straße groß", "łodz naive cafe", "елки палки київ".replace("ї", "і"), "東京 タワー", "abc 123", "ete", "nandu_x", "ελλαδα ας", "العربية", "", None, "istanbul"]
    words = df.select(any_word(F.lower("t"), ["палки", "стр", "groß"]).alias("x")).collect()
    assert [r["x"] for r in words] == [True, False, True, *[False] * 7, None, False]


def test_like_pairs_of_texts_that_begin_alike(spark):
    """No pair is missed, at lengths of either kind of key, and a common beginning makes no candidates."""
    rnd = random.Random(5)
    some = sorted({"".join(rnd.choices("ab", k=rnd.randrange(1, 14))) for _ in range(150)} | {"b" * 40 + "".join(rnd.choices("ab", k=6)) for _ in range(20)})
    t = spark.createDataFrame([(x,) for x in some], "k string")
    edits = t.select(F.col("k").alias("x")).crossJoin(t.select(F.col("k").alias("y"))).where("x < y").select("x", "y", F.levenshtein("x", "y").alias("e")).collect()
    for least in (0.9, 0.75, 0.6):
        want = {(r["x"], r["y"]) for r in edits if 1 - r["e"] / max(len(r["x"]), len(r["y"])) >= least}
        assert want and want <= {(r["__t"], r["__n"]) for r in terms.like_pairs(t, "k", least).collect()}
    names = spark.range(2_000).select(F.format_string("supplier %09d", F.col("id") * 7919).alias("k"))
    assert terms.like_pairs(names, "k", 0.9).count() < 2_000
    assert terms.like_pairs(names.limit(0), "k", 0.9).count() == 0


def test_dictionary_meets_each_title_and_entry_once(spark, monkeypatch):
    df = spark.range(50).select("id", F.lit("Red ring").alias("t"))
    entries = spark.createDataFrame([(i, "ring", "red" if i % 2 else None, str(1000 + i)) for i in range(40)], "place long, term string, context string, code string")
    seen = []
    whole = matching.containing
    monkeypatch.setattr(matching, "containing", lambda d, k, t, e, term: seen.append((d.count(), e.count())) or whole(d, k, t, e, term))
    got = matching.dictionary_match(df, "id", "t", entries).collect()
    assert seen == [(1, 2)]
    assert len(got) == 50 and {r["code"] for r in got} == {"1001"}
