"""Queries of occupation and skill matching, and the flagship that chains them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vacantia.operators import matching as m
from vacantia.plans.normalize_queries import key_sql
from vacantia.sources.scratch import scratch_dir
from vacantia.sources.tables import table
from vacantia.sources.versioned import VersionedTable


def _vectors(s, d):
    e = table(s, d, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return q, e.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))


COS = "(SELECT a.vec_id AS query_id, b.vec_id AS item_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score FROM embeddings a CROSS JOIN embeddings b WHERE a.vec_id % 20 = 0)"
TOP = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM {COS}) WHERE rank <= 10)"


def _top(s, d, k=10):
    return m.topk_cosine(*_vectors(s, d), k)


def _texts(s, d):
    """Ten rows in a row of query ids are the texts of one posting."""
    labels = table(s, d, "embeddings").select(F.col("vec_id").alias("item_id"), "label")
    return _top(s, d).join(labels, "item_id").select(F.floor(F.col("query_id") / 100).alias("row"), (F.col("query_id") % 100).alias("place"), "label", "item_id", F.round("score", 6).alias("score"))


TEXTS = f"(SELECT query_id // 100 AS row, query_id % 100 AS place, label, item_id, round(score, 6) AS score FROM {TOP} JOIN embeddings ON item_id = vec_id)"


def _skills(s, d):
    """Parts of an order as its skills, with a score by quantity."""
    l = table(s, d, "lineitem")
    rows = l.groupBy("l_orderkey", "l_partkey").agg(F.max("l_quantity").cast("long").alias("q"))
    return rows.select("l_orderkey", "l_partkey", (F.col("q") / 100).alias("score"), F.when(F.col("q") % 2 == 0, 1.0).otherwise(0.5).alias("origin_weight"), F.when(F.col("l_partkey") % 10 == 0, 0.3).otherwise(1.0).alias("generic_weight"))


SKILLS = "(SELECT l_orderkey, l_partkey, q / 100 AS score, CASE WHEN q % 2 = 0 THEN 1.0 ELSE 0.5 END::DOUBLE AS origin_weight, CASE WHEN l_partkey % 10 = 0 THEN 0.3 ELSE 1.0 END::DOUBLE AS generic_weight FROM (SELECT l_orderkey, l_partkey, max(l_quantity)::BIGINT AS q FROM lineitem GROUP BY 1, 2))"


def _links(s, d):
    """Brands as occupations of the parts, a second one by size."""
    p = table(s, d, "part")
    near = p.select("p_partkey", F.concat(F.lit("Brand#"), F.col("p_size") % 5 + 1).alias("p_brand"), F.lit(0.5).alias("link_weight"))
    return p.select("p_partkey", "p_brand", F.lit(1.0).alias("link_weight")).union(near).groupBy(F.col("p_partkey").alias("l_partkey"), "p_brand").agg(F.max("link_weight").alias("link_weight"))


LINKS = "(SELECT p_partkey AS l_partkey, p_brand, max(w) AS link_weight FROM (SELECT p_partkey, p_brand, 1.0::DOUBLE AS w FROM part UNION ALL SELECT p_partkey, 'Brand#' || (p_size % 5 + 1), 0.5 FROM part) GROUP BY 1, 2)"
POINTS = f"(SELECT l_orderkey, p_brand, sum((score * link_weight * origin_weight * generic_weight)::DECIMAL(18,6))::DOUBLE AS score, array_to_string(list_sort(list(DISTINCT l_partkey::VARCHAR)), ',') AS matched, count(DISTINCT l_partkey) AS n_matched FROM {SKILLS} JOIN {LINKS} USING (l_partkey) GROUP BY 1, 2)"
RANKED = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, p_brand) AS rank FROM {POINTS}) WHERE rank <= 5)"


#: Lines of orders of a partition.
PART_LINES = 250_000


def _parts(s, d):
    """Partitions that hold so many lines each, so that tasks don't grow with the table."""
    return max(int(s.conf.get("spark.sql.shuffle.partitions")), table(s, d, "lineitem").count() // PART_LINES)


def _ranked(s, d):
    skills = _skills(s, d).withColumn("l_partkey", F.col("l_partkey").cast("string"))
    links = _links(s, d).withColumn("l_partkey", F.col("l_partkey").cast("string"))
    return m.rank_occupations(skills, links, "l_orderkey", "l_partkey", "p_brand", 5, _parts(s, d))


def _by_title(s, d):
    """Candidates by a hash-free score of the order: five brands by its priority and status."""
    o = table(s, d, "orders")
    k = F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k")
    rows = o.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", k)
    return rows.select("l_orderkey", F.concat(F.lit("Brand#"), (F.col("o_custkey") + F.col("k") * 3) % 25 + 1).alias("p_brand"), ((F.lit(90) - F.col("k") * 20) / 100).alias("score"))


BY_TITLE = "(SELECT o_orderkey AS l_orderkey, 'Brand#' || ((o_custkey + k * 3) % 25 + 1) AS p_brand, (90 - k * 20) / 100 AS score FROM orders, (SELECT unnest([0, 1, 2]) AS k))"
COMBINED = (
    f"(SELECT coalesce(a.l_orderkey, b.l_orderkey) AS l_orderkey, coalesce(a.p_brand, b.p_brand) AS p_brand, round(0.6::DOUBLE * coalesce(sa, 0) + 0.4::DOUBLE * coalesce(b.score, 0), 9) AS score "
    f"FROM (SELECT l_orderkey, p_brand, score / nullif(max(score) OVER (PARTITION BY l_orderkey), 0) AS sa FROM {RANKED}) a FULL JOIN {BY_TITLE} b ON a.l_orderkey = b.l_orderkey AND a.p_brand = b.p_brand)"
)


def _combined(s, d):
    return m.combine_candidates(_ranked(s, d), _by_title(s, d), "l_orderkey", "p_brand", parts=_parts(s, d))


def _penalized(s, d):
    rows = _combined(s, d).withColumn("code", F.regexp_extract("p_brand", "([0-9]+)", 1))
    return m.penalize(rows, "l_orderkey", "p_brand", "code", {"1": 0.2, "24": 0.5}, F.when(F.col("l_orderkey") % 2 == 0, 0.1).otherwise(0.0), _parts(s, d))


PENALIZED = (
    f"(SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, p_brand) AS rank FROM (SELECT l_orderkey, p_brand, code, round(greatest(0.0::DOUBLE, score - CASE WHEN code LIKE '1%' THEN 0.2::DOUBLE WHEN code LIKE '24%' THEN 0.5 ELSE 0 END - CASE WHEN l_orderkey % 2 = 0 THEN 0.1::DOUBLE ELSE 0 END), 9) AS score "
    f"FROM (SELECT *, split_part(p_brand, '#', 2) AS code FROM {COMBINED})))"
)


def _dictionary(s, d):
    words, size = F.split("p_name", " "), F.col("p_size")
    code = F.when(size % 7 == 0, "none").otherwise((size + 1000).cast("string")).alias("code")
    entries = table(s, d, "part").groupBy(words[1].alias("term"), F.when(size % 2 == 0, words[0]).alias("context"), code).agg(F.min("p_partkey").alias("place"))
    return m.dictionary_match(table(s, d, "part").select("p_partkey", "p_name"), "p_partkey", "p_name", entries)


DICTIONARY = (
    "SELECT split_part(p_name, ' ', 2) AS term, CASE WHEN p_size % 2 = 0 THEN split_part(p_name, ' ', 1) END AS context, (p_size + 1000)::VARCHAR AS code, min(p_partkey) AS place FROM part WHERE p_size % 7 > 0 GROUP BY 1, 2, 3"
)


def _rules():
    return [
        (2, "b", m.business_rule(F.col("p_name"), F.col("p_type"), any_of=["ring", "bolt"], exclude=["red"]), "Brand#1"),
        (1, "a", m.business_rule(F.col("p_name"), F.col("p_type"), all_of=["blue"], tasks_any=["promo", "small"]), "Brand#2"),
        (0, "z", m.business_rule(F.col("p_name"), F.col("p_type")), "no such label"),
        (3, "c", m.business_rule(F.col("p_name"), F.col("p_type"), all_of=["gear"]), "Brand#3"),
    ]


RULE_SQL = "CASE WHEN p_name LIKE '%blue%' AND p_type IN ('PROMO', 'SMALL') THEN 'a' WHEN (p_name LIKE '%ring%' OR p_name LIKE '%bolt%') AND p_name NOT LIKE '%red%' THEN 'b' WHEN p_name LIKE '%gear%' THEN 'c' END"


def _names(s, d):
    n = table(s, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.upper("c_name")).when(F.col("c_custkey") % 3 == 0, F.lit("Supplier#00000001")).otherwise(F.lit("supplier#000000055")).alias("label"))
    return m.resolve_label(n, "label", table(s, d, "supplier"), "s_name", "s_suppkey")


def _decided(s, d):
    p = table(s, d, "part")
    df = p.select("p_partkey", F.when(F.col("p_size") > 40, F.col("p_partkey") + 1000).alias("rule"), F.when(F.col("p_type") == "PROMO", F.col("p_partkey") + 2000).alias("dict"), F.when(F.col("p_size") > 5, F.col("p_partkey") + 1001).alias("blend"))
    return m.decide(df, [("rule", "rule"), ("dictionary", "dict"), ("blended", "blend")], "blend")


DECIDED = "(SELECT p_partkey, CASE WHEN p_size > 40 THEN p_partkey + 1000 END AS rule, CASE WHEN p_type = 'PROMO' THEN p_partkey + 2000 END AS dict, CASE WHEN p_size > 5 THEN p_partkey + 1001 END AS blend FROM part)"


def _boosts(s, d):
    p = table(s, d, "part")
    return p.select("p_brand", F.when(F.col("p_size") > 45, 0.05).otherwise(-0.001).alias("boost"))


def _fuzzy(s, d):
    titles = table(s, d, "part").select("p_partkey", F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, "s extra").otherwise("s")).alias("title"))
    return m.fuzzy_match(titles, "p_partkey", "title", table(s, d, "part").select("p_name").distinct(), "p_name", 0.5)


def _nodes(s, d):
    p = table(s, d, "part")
    return p.select(F.col("p_partkey").alias("node"), F.when(F.col("p_partkey") % 10 > 0, F.col("p_partkey") - 1).alias("parent"), F.when(F.col("p_partkey") % 10 == 0, F.concat("p_size", F.lit("00"))).alias("code"))


def _two_matches(s, d):
    """A fuzzy and a vector match of each part; some have none of a kind."""
    p, size = table(s, d, "part"), F.col("p_size")
    fuzzy = p.select("p_partkey", F.when(size > 10, F.col("p_name")).alias("name"), F.when(size > 10, size / 50).alias("score"))
    other = F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise("other")
    return fuzzy, p.select("p_partkey", F.when(size < 45, other).alias("name"), F.when(size < 45, 0.55).alias("score"))


def _agreement(s, d):
    o = table(s, d, "orders")
    x = o.select("o_orderkey", F.col("o_orderpriority").alias("label"), (F.col("o_custkey") % 7).alias("code"), F.col("o_orderstatus").alias("confidence"))
    y = o.select("o_orderkey", F.when(F.col("o_custkey") % 2 == 0, F.col("o_orderpriority")).otherwise("x").alias("label"), (F.col("o_orderkey") % 7).alias("code"), F.when(F.col("o_totalprice") > 250000, "F").otherwise("O").alias("confidence"))
    return m.method_agreement(x, y, "o_orderkey")


def flagship(s, d):
    """Occupations of postings: skills ranked, blended with title candidates, penalized, decided."""
    best = _penalized(s, d).where("rank = 1").select("l_orderkey", F.col("code").alias("blended"), "score")
    ruled = table(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("1")).alias("rule"))
    return m.decide(ruled.join(best, "l_orderkey", "left"), [("rule", "rule"), ("blended", "blended")], "blended")


def _saved(which):
    """Two runs of matching, the second over every third order with fewer skills, and saved twice."""

    def run(s, d):
        tables = [VersionedTable(s, f"{scratch_dir(s)}/matches-{uuid.uuid4().hex}") for _ in range(3)]
        o, l = table(s, d, "orders"), table(s, d, "lineitem")
        for number in (0, 1, 1):
            some = o.where("o_orderkey % 3 = 0") if number else o
            matches = some.select("o_orderkey", (F.col("o_custkey") + number).alias("code"), F.col("o_orderpriority").alias("method"), F.lit(number).alias("run"))
            lines = l.where("l_orderkey % 3 = 0 AND l_linenumber <= 2") if number else l
            skills = lines.join(o.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("skill"), F.lit(number).alias("run"))
            m.save_matches(*tables, matches, skills, "o_orderkey", "run", number)
        return tables[which].read()

    return run


ALL_RUNS = "(SELECT o_orderkey, o_custkey AS code, o_orderpriority AS method, 0 AS run FROM orders UNION ALL SELECT o_orderkey, o_custkey + 1, o_orderpriority, 1 FROM orders WHERE o_orderkey % 3 = 0)"
DETAILS = (
    "SELECT l_orderkey AS o_orderkey, l_partkey AS skill, 0 AS run FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) AND l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_orderkey % 3 = 0 AND l_linenumber <= 2) "
    "UNION ALL SELECT l_orderkey, l_partkey, 1 FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) AND l_orderkey % 3 = 0 AND l_linenumber <= 2"
)

QUERIES = {
    "e02_flagship": (
        flagship,
        f"WITH r AS (SELECT o_orderkey AS l_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN '1' END AS rule, p.code AS blended, p.score FROM orders LEFT JOIN (SELECT * FROM {PENALIZED} WHERE rank = 1) p ON p.l_orderkey = o_orderkey) "
        "SELECT *, CASE WHEN rule IS NOT NULL THEN 'rule' WHEN blended IS NOT NULL THEN 'blended' ELSE 'none' END AS method, coalesce(rule, blended) AS decided, coalesce(coalesce(rule, blended)[1:4] = blended[1:4], false) AS agrees FROM r",
    ),
    "m01_topk_cosine": (lambda s, d: _top(s, d).withColumn("score", F.round("score", 4)), f"SELECT query_id, item_id, round(score, 4) AS score, rank FROM {TOP}"),
    "m01_topk_bucketed": (lambda s, d: m.topk_bucketed(*_vectors(s, d), 10).withColumn("score", F.round("score", 4)), None),
    "m04_saved_results": (_saved(0), f"SELECT * FROM {ALL_RUNS} QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY run DESC) = 1"),
    "m04_saved_history": (_saved(1), f"SELECT * FROM {ALL_RUNS}"),
    "m04_saved_details": (_saved(2), DETAILS),
    "m02_match_texts": (
        lambda s, d: m.match_texts(_texts(s, d), "row", "place", "label", "score", 0.2).select("row", "label", "place", "item_id"),
        f"SELECT row, label, place, item_id FROM (SELECT *, row_number() OVER (PARTITION BY row, label ORDER BY place, score DESC) AS r FROM {TEXTS} WHERE score >= 0.2) WHERE r = 1",
    ),
    "m03_skill_weight": (
        lambda s, d: table(s, d, "part").select("p_partkey", m.skill_weight(F.col("p_name"), ["red ring", "blue bolt"], {"gear": 1.5, "hot": 1.2}).alias("exact"), m.skill_weight(F.col("p_name"), ["ring", "small blue bolt"], {"gear": 1.5}, contained=True).alias("contained")),
        "SELECT p_partkey, CASE WHEN p_name IN ('red ring', 'blue bolt') THEN 0.3 WHEN p_name LIKE '%gear%' THEN 1.5 WHEN p_name LIKE '%hot%' THEN 1.2 ELSE 1.0 END::DOUBLE AS exact, CASE WHEN p_name LIKE '%ring%' OR 'small blue bolt' LIKE '%' || p_name || '%' THEN 0.3 WHEN p_name LIKE '%gear%' THEN 1.5 ELSE 1.0 END::DOUBLE AS contained FROM part",
    ),
    "m04_rank_occupations": (_ranked, f"SELECT * FROM {RANKED}"),
    "m05_combine_candidates": (_combined, f"SELECT * FROM {COMBINED}"),
    "m06_penalize": (_penalized, f"SELECT * FROM {PENALIZED}"),
    "m07_dictionary_match": (
        _dictionary,
        f"SELECT p_partkey, arg_min(code, {{'c': context IS NULL, 'p': place}}) AS code FROM part JOIN ({DICTIONARY}) ON contains(p_name, term) AND (context IS NULL OR contains(p_name, context)) GROUP BY 1",
    ),
    "m08_apply_rules": (
        lambda s, d: m.apply_rules(table(s, d, "part").select("p_partkey", "p_name", "p_type"), _rules(), table(s, d, "part"), "p_brand"),
        f"SELECT p_partkey, p_name, p_type, {RULE_SQL} AS rule, CASE {RULE_SQL} WHEN 'a' THEN 'Brand#2' WHEN 'b' THEN 'Brand#1' WHEN 'c' THEN 'Brand#3' END AS rule_label FROM part",
    ),
    "m09_resolve_label": (
        _names,
        "WITH l AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN upper(c_name) WHEN c_custkey % 3 = 0 THEN 'Supplier#00000001' ELSE 'supplier#000000055' END AS label FROM customer) SELECT l.*, coalesce(e.s_name, n.s_name) AS resolved, coalesce(e.s_suppkey, n.s_suppkey) AS s_suppkey "
        "FROM l LEFT JOIN supplier e ON lower(e.s_name) = lower(label) LEFT JOIN (SELECT s_name, s_suppkey FROM supplier WHERE s_name LIKE 'Supplier#00000001%' ORDER BY length(s_name), s_name LIMIT 1) n ON e.s_name IS NULL AND label = 'Supplier#00000001'",
    ),
    "m10_decide": (
        _decided,
        f"SELECT *, CASE WHEN rule IS NOT NULL THEN 'rule' WHEN dict IS NOT NULL THEN 'dictionary' WHEN blend IS NOT NULL THEN 'blended' ELSE 'none' END AS method, coalesce(rule, dict, blend) AS decided, coalesce(coalesce(rule, dict, blend)::VARCHAR[1:4] = blend::VARCHAR[1:4], false) AS agrees FROM {DECIDED}".replace("coalesce(rule, dict, blend)::VARCHAR[1:4]", "substr(coalesce(rule, dict, blend)::VARCHAR, 1, 4)").replace("blend::VARCHAR[1:4]", "substr(blend::VARCHAR, 1, 4)"),
    ),
    "m11_prefix_filter": (
        lambda s, d: m.prefix_filter(table(s, d, "part").select("p_partkey", "p_type", F.regexp_extract("p_brand", "([0-9]+)", 1).alias("code")), "p_type", "code", {"PROMO": ["1"], "SMALL": ["2", "3"], "LARGE": []}),
        "SELECT p_partkey, p_type, split_part(p_brand, '#', 2) AS code FROM part WHERE CASE p_type WHEN 'PROMO' THEN split_part(p_brand, '#', 2) LIKE '1%' WHEN 'SMALL' THEN regexp_matches(split_part(p_brand, '#', 2), '^[23]') WHEN 'LARGE' THEN false ELSE true END",
    ),
    "m12_adjust_scores": (
        lambda s, d: m.adjust_scores(table(s, d, "part").select("p_partkey", "p_brand", (F.col("p_size") / 50).alias("score"), (F.col("p_size") + 10).alias("code"), F.when(F.col("p_partkey") % 3 > 0, F.col("p_partkey") % 60 + 10).alias("wanted")), _boosts(s, d), ["p_brand"], "code", "wanted"),
        "WITH b AS (SELECT p_brand, round(sum(CASE WHEN p_size > 45 THEN 0.05 ELSE -0.001 END)::DOUBLE, 6) AS b FROM part GROUP BY 1), p AS (SELECT p_partkey, p_brand, p_size / 50 AS score, p_size + 10 AS code, CASE WHEN p_partkey % 3 > 0 THEN p_partkey % 60 + 10 END AS wanted FROM part) "
        "SELECT p_partkey, p_brand, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, score + b + CASE WHEN wanted IS NULL THEN 0.0::DOUBLE WHEN code = wanted THEN 0.2 WHEN substr(code::VARCHAR, 1, 1) = substr(wanted::VARCHAR, 1, 1) THEN 0.05 ELSE -0.1 END)), 4) AS score, code, wanted FROM p JOIN b USING (p_brand)",
    ),
    "m13_multicriteria": (
        lambda s, d: m.multicriteria(table(s, d, "part").select("p_partkey", (F.col("p_size") / 50).alias("t"), (F.col("p_partkey") % 11 / 10).alias("k"), (F.col("p_partkey") % 7 / 6).alias("x"), (F.col("p_partkey") % 5 / 4).alias("filled")), "t", "k", "x", F.col("filled")),
        "WITH p AS (SELECT p_partkey, p_size / 50 AS t, (p_partkey % 11) / 10 AS k, (p_partkey % 7) / 6 AS x, (p_partkey % 5) / 4 AS filled FROM part), f AS (SELECT *, round(CASE WHEN filled >= 0.6 THEN t * 0.4::DOUBLE + k * 0.4::DOUBLE + x * 0.2::DOUBLE WHEN filled >= 0.3 THEN t * 0.5::DOUBLE + k * 0.3::DOUBLE + x * 0.2::DOUBLE "
        "ELSE t * 0.7::DOUBLE + k * 0.1::DOUBLE + x * 0.2::DOUBLE END, 4) AS final FROM p) SELECT *, CASE WHEN final >= 0.6 THEN 'confirmed' WHEN final >= 0.4 THEN 'review' ELSE 'rejected' END AS status FROM f",
    ),
    "m14_fuzzy_match": (
        _fuzzy,
        "WITH t AS (SELECT DISTINCT p_name || CASE WHEN p_partkey % 2 = 0 THEN 's extra' ELSE 's' END AS t FROM part), n AS (SELECT DISTINCT p_name AS n FROM part), "
        "c AS (SELECT t, n, round(0.6::DOUBLE * (1 - levenshtein(t, n) / greatest(length(t), length(n))::DOUBLE) + 0.4::DOUBLE * (len(list_intersect(string_split(t, ' '), string_split(n, ' '))) / len(list_distinct(list_concat(string_split(t, ' '), string_split(n, ' '))))::DOUBLE), 4) AS score FROM t, n), "
        "b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY score DESC, n) AS r FROM c WHERE score >= 0.5) WHERE r = 1) SELECT p_partkey, title, n AS name, score FROM (SELECT p_partkey, p_name || CASE WHEN p_partkey % 2 = 0 THEN 's extra' ELSE 's' END AS title FROM part) LEFT JOIN b ON t = title",
    ),
    "m15_skill_overlap": (
        lambda s, d: m.skill_overlap(table(s, d, "lineitem").join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select("l_suppkey", F.concat("p_name", F.lit("s")).alias("skill")), "l_suppkey", "skill", table(s, d, "part"), "p_brand", "p_name"),
        "WITH s AS (SELECT DISTINCT l_suppkey, p_name || 's' AS s FROM lineitem JOIN part ON l_partkey = p_partkey), c AS (SELECT DISTINCT p_brand, p_name AS c FROM part), k AS (SELECT s, c FROM (SELECT DISTINCT s FROM s), (SELECT DISTINCT c FROM c) WHERE 1 - levenshtein(s, c) / greatest(length(s), length(c))::DOUBLE >= 0.8), "
        "h AS (SELECT l_suppkey, p_brand, count(DISTINCT c) AS found FROM s JOIN k USING (s) JOIN c USING (c) GROUP BY 1, 2) SELECT h.l_suppkey, h.p_brand, found, size, round(found * 100.0::DOUBLE / size, 2) AS share_pct FROM h JOIN (SELECT p_brand, count(*) AS size FROM c GROUP BY 1) USING (p_brand)",
    ),
    "m16_cascade": (
        lambda s, d: m.cascade(*_two_matches(s, d), "p_partkey"),
        "WITH r AS (SELECT p_partkey, CASE WHEN p_size > 10 THEN p_name END AS f, CASE WHEN p_size > 10 THEN p_size / 50 END AS fs, CASE WHEN p_size < 45 THEN CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE 'other' END END AS v, CASE WHEN p_size < 45 THEN 0.55::DOUBLE END AS vs FROM part) "
        "SELECT p_partkey, CASE WHEN fs >= 0.8 THEN f ELSE coalesce(v, f) END AS name, CASE WHEN fs >= 0.8 THEN 'fuzzy' WHEN v IS NOT NULL THEN 'vector' WHEN f IS NOT NULL THEN 'weak' ELSE 'none' END AS method, round(least(1.0::DOUBLE, CASE WHEN fs >= 0.8 THEN fs ELSE coalesce(vs, fs) END + CASE WHEN f = v THEN 0.1::DOUBLE ELSE 0 END), 4) AS score FROM r",
    ),
    "m17_coded_ancestor": (
        lambda s, d: m.coded_ancestor(_nodes(s, d), "node", "parent", "code"),
        "WITH r AS (SELECT a.p_partkey AS node, b.p_size || '00' AS found, a.p_partkey % 10 AS steps FROM part a LEFT JOIN part b ON b.p_partkey = a.p_partkey - a.p_partkey % 10) SELECT *, substr(found, 1, 1) AS level_1, substr(found, 1, 2) AS level_2 FROM r",
    ),
    "m18_categorize_skills": (
        lambda s, d: m.categorize_skills(table(s, d, "part").select("p_partkey", "p_name"), "p_partkey", "p_name", table(s, d, "part").where("p_size > 45").select(F.col("p_partkey").alias("key"), F.col("p_type").alias("category")), table(s, d, "part").where("p_name LIKE 'red%'").select(F.col("p_name").alias("key"), F.lit("red things").alias("category")), [("ring", "rings"), ("bolt", "bolts")], "other"),
        "SELECT p_partkey, p_name, CASE WHEN p_size > 45 THEN p_type WHEN p_name LIKE 'red%' THEN 'red things' WHEN p_name LIKE '%ring%' THEN 'rings' WHEN p_name LIKE '%bolt%' THEN 'bolts' ELSE 'other' END AS category, CASE WHEN p_size > 45 THEN 'uri' WHEN p_name LIKE 'red%' THEN 'label' WHEN p_name LIKE '%ring%' OR p_name LIKE '%bolt%' THEN 'keyword' ELSE 'default' END AS way FROM part",
    ),
    "m19_roll_up": (
        lambda s, d: m.roll_up(table(s, d, "lineitem").select("l_suppkey", "l_partkey"), table(s, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey", "s_nationkey", "l_partkey"),
        "SELECT s_nationkey, count(DISTINCT l_suppkey) AS occupations, count(DISTINCT l_partkey) AS skills FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1",
    ),
    "m20_skill_gap": (
        lambda s, d: m.skill_gap(table(s, d, "labels").where("quality = 1"), table(s, d, "labels").where("toxic = 1"), table(s, d, "documents").select("doc_id"), "doc_id"),
        "SELECT CASE WHEN quality = 1 AND toxic = 1 THEN 'both' WHEN quality = 1 THEN 'parsed' WHEN toxic = 1 THEN 'catalogue' ELSE 'neither' END AS kind, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1",
    ),
    "m21_pending": (
        lambda s, d: m.pending(table(s, d, "documents").select("doc_id", "lang"), table(s, d, "labels"), "doc_id", F.col("quality") == 1),
        "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    ),
    "m21_pending_forced": (
        lambda s, d: m.pending(table(s, d, "documents").select("doc_id", "lang"), table(s, d, "labels"), "doc_id", F.col("quality") == 1, True),
        "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)",
    ),
    "m22_method_agreement": (
        _agreement,
        "SELECT o_orderstatus AS confidence_a, CASE WHEN o_totalprice > 250000 THEN 'F' ELSE 'O' END AS confidence_b, count(*) AS n, count(*) FILTER (WHERE o_custkey % 2 = 0) AS same_label, count(*) FILTER (WHERE o_custkey % 7 = o_orderkey % 7) AS same_code FROM orders GROUP BY 1, 2",
    ),
}
