"""Edge frames: nulls, ties, empty tables, skewed and repeated rows."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from vacantia.functions.rules import Rule, Test
from vacantia.operators import components, dedup, extract, ingest, lifecycle, matching, normalize, quality, report, runs
from vacantia.operators.components import connected_components
from vacantia.plans import dedup_queries, matching_queries, report_queries
from vacantia.sources.versioned import VersionedTable
from vacantia.streaming import streams


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=str)


def test_components_of_chains_loops_and_hubs(spark):
    chain = [(i, i + 1) for i in range(100, 140)]
    edges = [*chain, (1, 1), (2, 3), (3, 2), (2, 3), (None, 9), *((50, 60 + i) for i in range(30)), (-5, 3)]
    got = dict(rows(connected_components(spark.createDataFrame(edges, "a long, b long"))))
    assert {got[n] for n in range(100, 141)} == {100}
    assert got[3] == got[2] == got[-5] == -5 and got[1] == 1 and 9 not in got
    assert {got[60 + i] for i in range(30)} == {50}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", None)], "id int, v string, at int")
    new = spark.createDataFrame([(2, "c", None), (3, "d", 1), (1, "x", 0)], "id int, v string, at int")
    once = ingest.upsert(old, new, ["id"], "at")
    assert rows(once, "id", "v") == [(1, "a"), (2, "c"), (3, "d")]
    assert rows(ingest.upsert(once, new, ["id"], "at")) == rows(once)


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name\n1,x\nbad,y\n")
    got = ingest.read_source(spark, "csv", str(tmp_path / "a.csv"), "id int, name string").cache()
    assert got.where("_corrupt IS NULL").count() == 1 and got.count() == 2
    (tmp_path / "a.json").write_text('{"id": 1, "name": "x"}\nnot json\n')
    got = ingest.read_source(spark, "json", str(tmp_path / "a.json"), "id int, name string").cache()
    assert rows(got, "id") == [(1,), (None,)]
    frames = {"t": spark.range(3)}
    for _ in range(2):
        ingest.write_snapshot(frames, str(tmp_path / "out"), "s1")
    ingest.write_snapshot(frames, str(tmp_path / "out"), "s2")
    assert spark.read.parquet(str(tmp_path / "out/t")).count() == 6


def test_versions_and_validity(spark):
    log = spark.createDataFrame([(1, None)], "id int, v string").withColumn("content_hash", ingest.content_hash("v"))
    batch = spark.createDataFrame([(1, None), (1, ""), (1, ""), (2, None)], "id int, v string")
    assert rows(ingest.append_versions(log, batch, ["id"], ["v"]), "id", "v") == [(1, ""), (2, None)]
    good, bad = ingest.split_batch(batch, {"has_v": F.col("v") != ""})
    assert good.count() == 0 and bad.count() == 4
    assert rows(ingest.json_fields(spark.createDataFrame([("{bad",), (None,)], "j string"), "j", "a int"), "a") == [(None,), (None,)]


def test_lifecycle_edges(spark):
    df = spark.createDataFrame([(1, "2024-01-01", None), (2, "2024-01-01", "2024-01-31"), (3, None, None), (4, "2024-01-25", "2024-02-01")], "id int, a string, b string")
    got = lifecycle.permanence(df, "a", "b", "2024-03-01")
    assert rows(got, "id", "days", "band") == [(1, 60, "high"), (2, 30, "mid"), (3, None, None), (4, 7, "mid")]
    a = spark.createDataFrame([(1, "x", None), (2, "y", 1)], "k int, v string, n int")
    b = spark.createDataFrame([(1, "x", 5), (3, None, None)], "k int, v string, n int")
    changes = rows(lifecycle.diff_snapshots(a, b, "k", ["v", "n"]))
    assert changes == [(1, "update", "n", None, "5"), (2, "delete", "n", "1", None), (2, "delete", "v", "y", None)]


def test_normalize_edges(spark):
    df = spark.createDataFrame([("Buenos Aires, Córdoba",), (None,), ("",), ("x, Cordobaa",), ("only zzz",)], "place string")
    places = spark.createDataFrame([("cordoba", "Córdoba"), ("CÓRDOBA", "Córdoba"), ("salta", "Salta")], "variant string, name string")
    got = {r["place"]: (r["province"], r["method"]) for r in normalize.match_location(df, "place", places, "variant", "name").collect()}
    assert got == {"Buenos Aires, Córdoba": ("Córdoba", "exact"), None: (None, None), "": (None, None), "x, Cordobaa": ("Córdoba", "similar"), "only zzz": (None, None)}
    page = "<p>a &amp;amp; b</p><script>x<y</script><!-- c --><div>d&nbsp;e</div>"
    assert rows(normalize.strip_html(spark.createDataFrame([(page,), (None,), ("",)], "h string"), "h"), "text") == [("",), ("a &amp; b\nd e",), (None,)]
    low = spark.createDataFrame([("TRUE", 5, 1), ("ok", None, 1), (None, 1, 2)], "t string, lo int, hi int")
    assert rows(normalize.validate_types(low, ["t"], {"lo": (0, 9)}, [("lo", "hi")])) == [("ok", None, 1), (None, 1, 2), (None, 1, 5)]
    titles = spark.createDataFrame([("Rosario, Rosario, Chef - remote (hybrid)",), (None,)], "t string")
    got = normalize.clean_title(titles, "t", [r"(?i)^rosario, ", r"(?i)[-( ]*(remote|hybrid)\)?$"])
    assert rows(got, "title") == [("Chef",), (None,)]
    lists = spark.createDataFrame([(" - Java, java,x, SQL ,",), (None,), ("",)], "l string")
    assert rows(lists.select(normalize.clean_list(F.col("l")))) == [("",), ("Java, SQL",), (None,)]


def test_extract_edges(spark):
    df = spark.createDataFrame([("Edad entre 25 y 40 años",), ("3 years experience; 5 años de experiencia",), ("99 years experience",), (None,)], "t string")
    assert rows(extract.extract_experience(df, "t"), "years") == [(3,), (None,), (None,), (None,)]
    headers = spark.createDataFrame([("Área: x\narea: y\nno\nPay: 1:2",), (None,), ("",)], "t string")
    assert rows(extract.extract_headers(headers, "t").select(F.to_json("headers"))) == [('{"area":"x","pay":"1:2"}',), ("{}",), (None,)]
    tasks = spark.createDataFrame([("Tasks: sell all the goods\n- sell the goods\n- cleanThe shop; write\nRequirements: none",)], "t string")
    assert extract.extract_tasks(tasks, "t", "tasks:", "requirements:").first()["tasks"] == ["sell all the goods", "clean", "The shop", "write"]


def test_duplicates(spark):
    rows_ = [(i, "acme", "Data Analyst", "x") for i in range(40)] + [(50, "acme", "Data Analyst!", "x"), (51, "acme", "Data Analysts", "x"), (52, "acme", "Cook", "x"), (53, None, None, None)]
    df = spark.createDataFrame(rows_, "id int, company string, title string, place string")
    assert rows(dedup.dedup_fuzzy(df, "id", ["title", "company"], ["place"], 0.85), "id") == [(0,), (52,), (53,)]
    texts = spark.createDataFrame([(1, "a b c d e f"), (2, "A b c, d e f"), (3, "g h i j k"), (4, None), (5, ""), (6, "g h i j k")], "id int, t string")
    signed = dedup.minhash(texts, "t")
    assert signed.where("signature IS NULL").count() == 2
    assert rows(dedup.minhash_pairs(signed, "id", "signature", 0.9)) == [(1, 2, 1.0), (3, 6, 1.0)]
    posts = spark.createDataFrame([(1, "s1", "w", "T", "b", "Confidential", None), (2, "s2", "w", "t", "B", "x", 2.0), (3, "s3", "w", "t", "b", None, 2.0)], "id int, src string, week string, title string, text string, company string, pay double")
    pairs = dedup.candidate_pairs(dedup.prepared(posts, "title", "text", "company"), ["week"], "src", "id", ["title", "text", "company", "pay"])
    assert rows(dedup.score_pairs(pairs, "title", "text", "company", "pay"), "a", "b", "score") == [(1, 2, 0.95), (1, 3, 0.95), (2, 3, 1.0)]


def test_matching_edges(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None)], "query_id long, vector array<double>")
    c = spark.createDataFrame([(7, [2.0, 0.0]), (5, [1.0, 0.0]), (6, [0.0, 1.0]), (8, None)], "item_id long, vector array<double>")
    assert rows(matching.topk_cosine(q, c, 2)) == [(1, 5, 1.0, 1), (1, 7, 1.0, 2)]
    assert matching.topk_cosine(q.limit(0), c, 2).count() == 0
    nodes = spark.createDataFrame([(1, 2, None), (2, 1, None), (3, 4, None), (4, None, "24"), (5, None, None)], "n int, p int, c string")
    assert rows(matching.coded_ancestor(nodes, "n", "p", "c"), "n", "found", "steps") == [(1, None, None), (2, None, None), (3, "24", 1), (4, "24", 0), (5, None, None)]
    zero = spark.createDataFrame([(1, "a", 0.0)], "r int, l string, score double")
    assert rows(matching.combine_candidates(zero, zero.limit(0), "r", "l")) == [(1, "a", 0.0)]


def test_rules_treat_null_as_false(spark):
    df = spark.createDataFrame([(1, None, None), (2, "Sales lead", 5)], "id int, t string, n int")
    rules = [Rule("r1", "k", "error", (Test("n", "greater", 3),)), Rule("r2", "k", "info", (Test("t", "is_null"),)), Rule("r3", "k", "info", (Test("t", "not_contains", ["sales"]), Test("n", "not_equals", 5)), any=True)]
    assert rows(quality.validate(df, "id", rules), "id", "rule") == [(1, "r2"), (1, "r3"), (2, "r1")]
    assert rows(quality.schema_check(df, ["id", "t", "zz"])) == [("id", True, 0, True), ("t", True, 1, False), ("zz", False, None, False)]
    assert quality.validate(df.limit(0), "id", rules).count() == 0


def test_reports_of_empty_and_tied_tables(spark):
    empty = spark.createDataFrame([], "d string, v int")
    assert report.share(empty, "d").count() == 0
    assert rows(report.kpis(empty, {"x": "d"})) == [(0, 0)]
    tied = spark.createDataFrame([("b", 1), ("a", 1), (None, 1)], "d string, v int")
    assert [r["d"] for r in report.top_n(tied.where("d IS NOT NULL"), "d", 1).collect()] == ["a"]
    assert rows(report.share(tied, "d")) == [("a", 1, 33.33), ("b", 1, 33.33), ("unknown", 1, 33.33)]
    days = spark.createDataFrame([(datetime.date(2019 + i // 366, 1, 1) + datetime.timedelta(i % 366),) for i in range(1098)], "d date")
    for r in days.select("d", report.monday_week(F.col("d")).alias("m"), report.sunday_week(F.col("d")).alias("s")).collect():
        assert (int(r["d"].strftime("%W")), int(r["d"].strftime("%U"))) == (r["m"], r["s"])


def test_sample_repeats_itself(spark):
    df = spark.range(1_000).select("id", F.concat(F.lit("s"), (F.col("id") % 3)).alias("src"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("st"))
    take = lambda d: rows(report.stratified_sample(d, "id", "src", "st", 90, 5, {"a": 0.5, "b": 0.5}), "id")
    assert take(df) == take(df.repartition(7)) and len(take(df)) == 90


def test_runs_edges(spark):
    b = spark.createDataFrame([("1", 10, 1, 5), ("2", 0, 0, 0)], "b string, n int, r int, c int")
    got = runs.batch_metrics(b, "n", "r", "c")
    assert rows(got, "learning_rate", "converged") == [(10.0, False), (None, False)]


def test_streams(spark, tmp_path):
    t = datetime.datetime
    feed = [(1, t(2024, 1, 1, 0, 0), "a", 1), (1, t(2024, 1, 1, 0, 1), "a", 9), (2, t(2024, 1, 1, 0, 50), "a", 9), (3, t(2024, 1, 1, 5, 0), "b", 1), (4, t(2024, 1, 2, 0, 0), "b", 1)]
    spark.createDataFrame(feed, "id int, ts timestamp, src string, v int").coalesce(1).write.parquet(str(tmp_path / "in"))

    def stream():
        return streams.file_stream(spark, str(tmp_path / "in"), "id int, ts timestamp, src string, v int")

    streams.run_to_table(streams.stream_sessions(stream(), "ts", "src", "30 minutes", "1 minute"), str(tmp_path / "s"), str(tmp_path / "cs"))
    assert rows(spark.read.parquet(str(tmp_path / "s")), "src", "n") == [("a", 1), ("a", 2), ("b", 1)]
    streams.run_to_table(streams.stream_health(stream(), "ts", "src", F.col("v") > 5, "1 hour", "1 minute"), str(tmp_path / "h"), str(tmp_path / "ch"))
    assert rows(spark.read.parquet(str(tmp_path / "h")), "src", "n", "failed", "level") == [("a", 3, 2, "critical"), ("b", 1, 0, "ok")]
    target = VersionedTable(spark, str(tmp_path / "t"))
    streams.drain(streams.stream_upsert(streams.first_of_id(stream(), "id", "ts", "1 day"), target, ["src"], "ts", str(tmp_path / "cu")))
    assert rows(target.read(), "src", "id") == [("a", 2), ("b", 4)]


def test_edges_are_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def see(x):
        seen.add(1)
        return x

    edges = spark.range(10, numPartitions=1).select(F.udf(see, "long").asNondeterministic()("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["component"] for r in connected_components(edges).collect()} == {0}
    assert seen.value == 10


def test_components_of_a_long_path_take_few_rounds_and_keep_their_size(spark, monkeypatch):
    """The size that Spark estimates for the labels had some million digits after a dozen rounds."""
    rounds = []
    total = components._total
    monkeypatch.setattr(components, "_total", lambda labels: rounds.append(len(str(labels._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))) or total(labels))
    ids = random.Random(3).sample(range(100_000), 1_000)
    edges = spark.createDataFrame([*zip(ids, ids[1:]), *((200_000 + i, 200_001 + i) for i in range(300))], "a long, b long")
    got = dict(rows(connected_components(edges)))
    assert got == dict.fromkeys(ids, min(ids)) | dict.fromkeys(range(200_000, 200_301), 200_000)
    assert len(rounds) <= 10 and max(rounds) <= 10


def test_values_that_meet_are_compared_once(spark, monkeypatch):
    posts = spark.createDataFrame([(i, i % 3, "w", f"big ring {i % 2}" if i else None, "text", "acme", 1.0) for i in range(60)], "id long, src long, week string, title string, text string, company string, pay double")
    pairs = dedup.candidate_pairs(dedup.prepared(posts, "title", "text", "company"), ["week"], "src", "id", ["title", "text", "company", "pay"])
    met = []
    kept = dedup.checkpointed
    monkeypatch.setattr(dedup, "checkpointed", lambda df: met.append(kept(df)) or met[-1])
    scored = dedup.score_pairs(pairs, "title", "text", "company", "pay")
    assert [d.count() for d in met] == [5]  # four pairs of titles and one of companies, of 1,200 pairs
    got = {(r["title_a"], r["title_b"]): r["score"] for r in scored.collect()}
    assert scored.count() == pairs.count() == 1_200
    assert got["big ring 0", "big ring 0"] == 1.0 and got["big ring 0", "big ring 1"] == 0.96 and got[None, "big ring 1"] is None


def test_pairs_are_made_once_where_all_values_are_known(spark, monkeypatch):
    """Unless these are too many to meet each other; scores are the same."""
    posts = spark.createDataFrame([(i, i % 3, "w", f"big ring {i % 2}" if i else None, "text", "acme", 1.0) for i in range(30)], "id long, src long, week string, title string, text string, company string, pay double")
    rows_ = dedup.prepared(posts, "title", "text", "company")
    pairs = dedup.candidate_pairs(rows_, ["week"], "src", "id", ["title", "text", "company", "pay"])
    seen = spark.sparkContext.accumulator(0)

    def see(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    want = rows(dedup.score_pairs(pairs, "title", "text", "company", "pay"), "a", "b", "score")
    for most, passes in ((dedup.BROADCAST_ROWS, 1), (3, 2)):
        monkeypatch.setattr(dedup, "BROADCAST_ROWS", most)
        before = seen.value
        assert rows(dedup.score_pairs(pairs.mapInArrow(see, pairs.schema), "title", "text", "company", "pay", values=rows_), "a", "b", "score") == want
        assert seen.value - before == passes * len(want) == passes * 300


def test_offers_of_some_ids_only(spark, monkeypatch):
    d = "/root/testdata/sf0.001"
    whole = dedup_queries._offers(spark, d)
    some = whole.where("id % 7 = 0").select("id")
    want = rows(whole.where("id % 7 = 0"))
    assert want and rows(dedup_queries._offers(spark, d, ids=some)) == want
    monkeypatch.setattr(dedup_queries, "IDS", 1)
    assert rows(dedup_queries._offers(spark, d, ids=some)) == want


def test_ranked_occupations_take_one_shuffle_after_the_join(spark):
    skills = spark.createDataFrame([(1, "s", 1.0, 1.0, 1.0)], "row long, skill string, score double, origin_weight double, generic_weight double")
    links = spark.createDataFrame([("s", "o", 1.0)], "skill string, occupation string, link_weight double")
    plan = matching.rank_occupations(skills, links.hint("broadcast"), "row", "skill", "occupation", 5)
    assert plan._jdf.queryExecution().executedPlan().toString().count("Exchange hash") == 1
    assert [tuple(r) for r in plan.collect()] == [(1, "o", 1.0, "s", 1, 1)]


def test_overlap_pairs_deal_ids_and_pairs_over_the_parts(spark):
    df = spark.createDataFrame([(1, 7), (2, 7), (2, 7), (3, 7), (1, 8), (2, 8), (None, 8), (4, 9), (1, None), (2, None), (3, None)], "w long, id long")
    pairs = report.overlap_pairs(df, "w", "id", 2, 9)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == plan.count(", 9), REPARTITION_BY_NUM") == 2
    assert [tuple(r) for r in pairs.collect()] == [(1, 2, 2), (1, 3, 1)]


def test_overlap_pairs_take_partitions_by_the_lines(spark, monkeypatch):
    monkeypatch.setattr(matching_queries, "PART_LINES", 2_000)
    plan = report_queries.QUERIES["a25_overlap_pairs"][0](spark, "/root/testdata/sf0.01")._jdf.queryExecution().executedPlan().toString()
    assert plan.count(", 30), REPARTITION_BY_NUM") == 2
