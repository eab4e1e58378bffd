"""Queries of duplicate detection."""

from __future__ import annotations

from pyspark.sql import functions as F

from vacantia.operators import dedup
from vacantia.operators.terms import bounded
from vacantia.plans.normalize_queries import key_sql
from vacantia.sources.tables import table

#: Ids up to which their table is broadcast: one column of numbers, some 16 MB.
IDS = 1_000_000


def _parts(s, d):
    """What an offer has of its part; a part stands once."""
    p = table(s, d, "part").groupBy("p_partkey").agg(F.min(F.struct("p_name", "p_brand", "p_type", "p_size")).alias("x")).select("p_partkey", "x.*")
    company = F.when(F.col("p_size") > 40, "Confidential").otherwise(F.col("p_brand"))
    pay = F.when(F.col("p_size") % 7 > 0, F.col("p_size").cast("double"))
    return p.select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("title"), F.concat_ws(" ", "p_name", "p_type").alias("text"), company.alias("company"), pay.alias("pay"))


def _offers(s, d, parts=None, ids=None):
    """Lines of orders as offers: the part's name as title, brand as company, supplier as place, by
    week of shipping. Lines of one order with one number and part are one offer. With a table of ids
    only those offers; others go before lines are brought together."""
    key = (F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1_000_000_000 + F.col("l_partkey")
    lines = table(s, d, "lineitem")
    if ids is not None:
        lines = lines.withColumn("id", key).join(bounded(ids.select("id"), IDS), "id", "left_semi")
    first = lines.groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.min(F.struct("l_shipdate", "l_suppkey")).alias("x"))
    day = F.col("x.l_shipdate")
    monday = F.floor((F.dayofyear(day) + 6 - F.weekday(day)) / 7).cast("string")
    week = F.concat(F.date_format(day, "yyyy"), F.lit("-"), F.lpad(monday, 2, "0"))
    lines = first.select(key.alias("id"), (F.col("l_orderkey") % 5).alias("src"), F.col("x.l_suppkey").alias("place"), week.alias("week"), F.date_format(day, "yyyy-MM-dd").alias("day"), "l_partkey")
    return lines.join(_parts(s, d) if parts is None else parts, "l_partkey").select("id", "src", "place", "week", "day", "title", "text", "company", "pay")


O = (
    "(SELECT id, l_orderkey % 5 AS src, l_suppkey AS place, strftime(l_shipdate, '%Y-%W') AS week, strftime(l_shipdate, '%Y-%m-%d') AS day, p_name AS title, p_name || ' ' || p_type AS text, CASE WHEN p_size > 40 THEN 'Confidential' ELSE p_brand END AS company, "
    "CASE WHEN p_size % 7 > 0 THEN p_size::DOUBLE END AS pay FROM (SELECT *, (l_orderkey * 8 + l_linenumber) * 1000000000 + l_partkey AS id, "
    "row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey ORDER BY l_shipdate, l_suppkey, l_quantity, l_extendedprice) AS r FROM lineitem JOIN part ON l_partkey = p_partkey) WHERE r = 1)"
)
COLS = ("title", "text", "company", "pay")


def _pairs(s, d, offers=None):
    return dedup.candidate_pairs(offers or _offers(s, d), ["place", "week"], "src", "id", COLS)


P = (
    "(SELECT coalesce(a.place::VARCHAR, 'unknown') AS place, coalesce(a.week, 'unknown') AS week, a.id AS a, a.src AS source_a, b.id AS b, b.src AS source_b, " + ", ".join(f"{t}.{c} AS {c}_{t}" for t in "ab" for c in COLS)
    + f" FROM {O} a JOIN {O} b ON coalesce(a.week, 'unknown') = coalesce(b.week, 'unknown') AND coalesce(a.place::VARCHAR, 'unknown') = coalesce(b.place::VARCHAR, 'unknown') AND a.id < b.id AND a.src <> b.src)"
)


def _sim(a, b):
    return f"CASE WHEN greatest(length({a}), length({b})) = 0 THEN 1.0 ELSE 1.0 - levenshtein({a}, {b}) / greatest(length({a}), length({b}))::DOUBLE END"


def _window_sim(a, b):
    """Of the shorter text and the most like window of the longer one."""
    short, long = (f"CASE WHEN length({a}) <= length({b}) THEN {x} ELSE {y} END" for x, y in ((a, b), (b, a)))
    each = f"list_transform(range(1, length({long}) - length({short}) + 2), lambda i: 1.0 - levenshtein({short}, substr({long}, i::INT, length({short})::INT)) / length({short})::DOUBLE)"
    return f"CASE WHEN least(length({a}), length({b})) = 0 THEN 0.0 ELSE list_max({each}) END"


def _title_sim(a, b):
    a, b = key_sql(a), key_sql(b)
    in_order = [f"array_to_string(list_sort(string_split({x}, ' ')), ' ')" for x in (a, b)]
    return f"greatest({_sim(a, b)}, 0.95::DOUBLE * ({_sim(*in_order)}), 0.9::DOUBLE * {_window_sim(a, b)})"


def _tokens(c):
    return f"list_filter(list_distinct(string_split({key_sql(c)}, ' ')), lambda x: x <> '')"


SCORED = (
    f"(SELECT *, round({_title_sim('title_a', 'title_b')} * (0.40::DOUBLE + CASE WHEN hid THEN 0.15::DOUBLE ELSE 0 END * 0.6) + "
    f"(len(list_intersect({_tokens('text_a')}, {_tokens('text_b')})) / len(list_distinct(list_concat({_tokens('text_a')}, {_tokens('text_b')})))::DOUBLE) * (0.35::DOUBLE + CASE WHEN hid THEN 0.15::DOUBLE ELSE 0 END * 0.4) + "
    f"CASE WHEN hid THEN 0.0 ELSE greatest({_sim(key_sql('company_a'), key_sql('company_b'))}, 0.9::DOUBLE * {_window_sim(key_sql('company_a'), key_sql('company_b'))}) * 0.15::DOUBLE END + CASE WHEN pay_a IS NULL OR pay_b IS NULL THEN 0.5::DOUBLE ELSE least(pay_a, pay_b) / greatest(pay_a, pay_b) END * 0.10::DOUBLE, 8) AS score "
    f"FROM (SELECT *, company_a = 'Confidential' OR company_b = 'Confidential' AS hid FROM {P}))"
)


def _scored(s, d):
    parts = dedup.prepared(_parts(s, d), "title", "text", "company")  # once a part
    return dedup.score_pairs(_pairs(s, d, _offers(s, d, parts)), "title", "text", "company", "pay", values=parts)


def _grouped(s, d):
    groups = dedup.duplicate_groups(_scored(s, d)).withColumnRenamed("node", "id")
    return _offers(s, d, ids=groups).join(groups, "id")


def _signatures(s, d):
    return dedup.minhash(table(s, d, "documents").select("doc_id", "text"), "text")


CONFIRMED = f"(SELECT a, b FROM {SCORED} WHERE score >= 0.85)"


def groups_sql(pairs: str) -> str:
    """(node, component): the smallest node that each reaches over pairs (a, b)."""
    return (
        f"(WITH RECURSIVE p AS MATERIALIZED (SELECT * FROM {pairs}), e AS (SELECT a, b FROM p UNION SELECT b, a FROM p), "
        "r AS (SELECT a AS node, a AS c FROM e UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.node) SELECT node, min(c) AS component FROM r GROUP BY node)"
    )


_S = key_sql("s_name")
FUZZY = (
    f"(WITH f AS (SELECT s_nationkey AS n, {_S} AS k, min(s_suppkey) AS id FROM supplier GROUP BY ALL) SELECT x.id AS a, y.id AS b FROM f x JOIN f y ON x.n = y.n AND x.id < y.id "
    f"WHERE {_sim('x.k', 'y.k')} >= 0.9)"
)

QUERIES = {
    "d01_dedup_exact": (
        lambda s, d: dedup.dedup_exact(_offers(s, d), ["title", "company", "week"], [F.asc("day"), F.asc("id")]),
        f"SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY title, company, week ORDER BY day, id) AS r FROM {O}) WHERE r = 1",
    ),
    "d02_dedup_fuzzy": (
        lambda s, d: dedup.dedup_fuzzy(table(s, d, "supplier"), "s_suppkey", ["s_name"], ["s_nationkey"], 0.9),
        f"SELECT * FROM supplier WHERE s_suppkey IN (SELECT min(s_suppkey) FROM supplier GROUP BY s_nationkey, {_S}) AND s_suppkey NOT IN (SELECT node FROM {groups_sql(FUZZY)} WHERE node <> component)",
    ),
    "d03_minhash": (lambda s, d: dedup.minhash_pairs(_signatures(s, d), "doc_id", "signature", 0.5), None),
    "d04_candidate_pairs": (_pairs, f"SELECT * FROM {P}"),
    "d05_score_pairs": (lambda s, d: _scored(s, d).select("a", "b", "score"), f"SELECT a, b, score FROM {SCORED}"),
    "d06_label_pairs": (
        lambda s, d: dedup.label_pairs(_scored(s, d)).select("a", "b", "label"),
        f"SELECT a, b, CASE WHEN score >= 0.85 THEN 'confirmed' ELSE 'probable' END AS label FROM {SCORED} WHERE score >= 0.70",
    ),
    "d06_duplicate_groups": (lambda s, d: dedup.duplicate_groups(_scored(s, d)), f"SELECT * FROM {groups_sql(CONFIRMED)}"),
    "d07_canonical": (
        lambda s, d: dedup.canonical(_offers(s, d), "title", "day", "id"),
        f"SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY title ORDER BY day, id) AS r FROM {O}) WHERE r = 1",
    ),
    "d07_canonical_groups": (
        lambda s, d: dedup.canonical(_grouped(s, d), "component", "day", "id"),
        f"SELECT * EXCLUDE (r, node) FROM (SELECT *, row_number() OVER (PARTITION BY component ORDER BY day, id) AS r FROM {O} JOIN {groups_sql(CONFIRMED)} ON id = node) WHERE r = 1",
    ),
}
