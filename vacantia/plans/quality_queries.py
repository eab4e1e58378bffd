"""Queries of validation and quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from vacantia.functions.rules import Rule, Test
from vacantia.operators import quality
from vacantia.sources.tables import table

RULES = (
    Rule("negative", "balance", "critical", (Test("c_acctbal", "less", 0),)),
    Rule("odd_segment", "segment", "warning", (Test("c_mktsegment", "in_list", ["FURNITURE"]), Test("c_nationkey", "greater_equal", 20))),
    Rule("rich_or_far", "balance", "info", (Test("c_acctbal", "greater", 9000), Test("c_nationkey", "equals", 24)), any=True),
    Rule("name_has", "name", "error", (Test("c_name", "contains_any", ["#00000001", "#00000099"]), Test("c_name", "contains_all", ["customer", "9"]))),
    Rule("name_form", "name", "error", (Test("c_name", "matches", "5{2}$"), Test("c_name", "is_not_empty"), Test("c_mktsegment", "not_in_list", ["BUILDING"]), Test("c_acctbal", "between", (0, 5000)))),
)
CONDITIONS = {
    "negative": "c_acctbal < 0",
    "odd_segment": "c_mktsegment = 'FURNITURE' AND c_nationkey >= 20",
    "rich_or_far": "c_acctbal > 9000 OR c_nationkey = 24",
    "name_has": "(c_name LIKE '%#00000001%' OR c_name LIKE '%#00000099%') AND c_name LIKE '%9%'",
    "name_form": "c_name LIKE '%55' AND c_mktsegment <> 'BUILDING' AND c_acctbal BETWEEN 0 AND 5000",
}
E = " UNION ALL ".join(f"SELECT c_custkey, c_acctbal, c_nationkey, '{r.id}' AS rule, '{r.kind}' AS kind, '{r.severity}' AS severity FROM customer WHERE {CONDITIONS[r.id]}" for r in RULES)
def _patterns():
    return [("negative", F.col("c_acctbal") < -500, "debt"), ("negative", None, "small debt"), ("rich_or_far", F.col("c_nationkey") == 24, "far"), ("name_has", None, "name")]


DIAGNOSIS = "CASE WHEN rule = 'negative' AND c_acctbal < -500 THEN 'debt' WHEN rule = 'negative' THEN 'small debt' WHEN rule = 'rich_or_far' AND c_nationkey = 24 THEN 'far' WHEN rule = 'name_has' THEN 'name' ELSE 'review by hand' END"
ACTIONS = {"debt": "escalate", "small debt": "auto", "far": "auto", "name": "reprocess"}
ACTION = "CASE diagnosis WHEN 'small debt' THEN 'auto' WHEN 'far' THEN 'auto' WHEN 'name' THEN 'reprocess' ELSE 'escalate' END"
ROUTED = f"(SELECT *, {ACTION} AS action FROM (SELECT *, {DIAGNOSIS} AS diagnosis FROM ({E})))"


def _errors(s, d, rows=None):
    return quality.validate(rows or table(s, d, "customer"), "c_custkey", RULES, ["c_acctbal", "c_nationkey"])


def _routed(s, d, rows=None):
    return quality.route(quality.diagnose(_errors(s, d, rows), _patterns()), ACTIONS)


def _states(s, d):
    a = F.col("action")
    return _routed(s, d).withColumn("state", F.when(a == "auto", "fixed").when((a == "escalate") & (F.col("rule") == "negative"), "escalated").otherwise("open"))


STATES = f"(SELECT *, CASE WHEN action = 'auto' THEN 'fixed' WHEN action = 'escalate' AND rule = 'negative' THEN 'escalated' ELSE 'open' END AS state FROM {ROUTED})"


FIXES = {"small debt": ("c_acctbal", 0.0), "far": ("c_name", "far ")}


def _fixed(s, d):
    c = table(s, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment", "c_nationkey")
    values = {x: (f, F.concat(F.lit(v), f) if isinstance(v, str) else F.lit(v)) for x, (f, v) in FIXES.items()}
    return quality.apply_fixes(c, _routed(s, d), "c_custkey", values)


def _passes(s, d):
    """Validation, diagnosis and automatic correction, and validation of what was corrected: errors by
    pass, rule and action."""
    by = lambda n, errors: errors.groupBy(F.lit(n).alias("pass"), "rule", "action").agg(F.count("*").alias("n"))
    return by(1, _routed(s, d)).union(by(2, _routed(s, d, _fixed(s, d).drop("fixed"))))


FIXED = (
    f"(WITH r AS (SELECT DISTINCT c_custkey, diagnosis FROM {ROUTED} WHERE action = 'auto'), f AS (SELECT *, "
    "c_custkey IN (SELECT c_custkey FROM r WHERE diagnosis = 'small debt') AS a, c_custkey IN (SELECT c_custkey FROM r WHERE diagnosis = 'far') AS b FROM customer) "
    "SELECT c_custkey, CASE WHEN b THEN 'far ' || c_name ELSE c_name END AS c_name, CASE WHEN a THEN 0.0 ELSE c_acctbal END AS c_acctbal, c_mktsegment, c_nationkey, a OR b AS fixed FROM f)"
)


def _sparse(s, d):
    c = table(s, d, "customer")
    return c.select("c_nationkey", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("balance"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_name")).otherwise(" ").alias("name"), "c_mktsegment")


def _flags():
    return [F.col("c_acctbal") > 0, F.col("c_mktsegment") == "BUILDING", F.col("c_nationkey") > 12, F.col("c_custkey") % 2 == 0]


RICH = "((c_acctbal > 0)::INT + (c_mktsegment = 'BUILDING')::INT + (c_nationkey > 12)::INT + (c_custkey % 2 = 0)::INT)"


def _checks(s, d):
    c, o = table(s, d, "customer"), table(s, d, "orders")
    return quality.run_checks([
        ("positive", c, F.col("c_acctbal") > 0, 95.0), ("named", c, F.trim("c_name") != "", 100.0),
        ("dated", o, F.to_date("o_orderdate").isNotNull(), 99.0), ("open", o, F.col("o_orderstatus") != "F", 70.0),
    ])


def _failures(s, d):
    docs, labels = table(s, d, "documents"), table(s, d, "labels")
    good = docs.where("lang <> 'de'").select("doc_id", "n_chars")
    return quality.stage_failures(docs, [("extract", good, F.col("n_chars") > 200), ("match", labels, F.col("quality") == 1), ("check", labels, F.col("toxic") == 0)], "doc_id")


def _filled(c):
    return f"round(count(*) FILTER (WHERE {c}) * 100.0::DOUBLE / count(*), 2)"


QUERIES = {
    "v01_validate": (lambda s, d: _errors(s, d), f"SELECT * FROM ({E})"),
    "v02_validation_summary": (
        lambda s, d: quality.validation_summary(table(s, d, "customer"), _errors(s, d), "c_custkey"),
        f"SELECT (SELECT count(*) FROM customer) AS n, count(DISTINCT c_custkey) AS failing, count(*) AS errors, (SELECT count(*) FROM customer) - count(DISTINCT c_custkey) AS clean FROM ({E})",
    ),
    "v02_errors_by": (lambda s, d: quality.errors_by(_errors(s, d), "kind", "severity"), f"SELECT kind, severity, count(*) AS n FROM ({E}) GROUP BY 1, 2"),
    "v03_diagnose": (lambda s, d: quality.diagnose(_errors(s, d), _patterns()), f"SELECT *, {DIAGNOSIS} AS diagnosis FROM ({E})"),
    "v04_route": (lambda s, d: _routed(s, d), f"SELECT * FROM {ROUTED}"),
    "e01_two_passes": (
        _passes,
        f"SELECT 1 AS pass, rule, action, count(*) AS n FROM {ROUTED} GROUP BY ALL UNION ALL SELECT 2, rule, action, count(*) FROM {ROUTED.replace('FROM customer', 'FROM ' + FIXED)} GROUP BY ALL",
    ),
    "v04_correct": (
        lambda s, d: _fixed(s, d).drop("c_nationkey"),
        f"WITH r AS (SELECT DISTINCT c_custkey, diagnosis FROM {ROUTED} WHERE action = 'auto'), f AS (SELECT c_custkey, c_name, c_acctbal, c_mktsegment, "
        "c_custkey IN (SELECT c_custkey FROM r WHERE diagnosis = 'small debt') AS a, c_custkey IN (SELECT c_custkey FROM r WHERE diagnosis = 'far') AS b FROM customer) "
        "SELECT c_custkey, CASE WHEN b THEN 'far ' || c_name ELSE c_name END AS c_name, CASE WHEN a THEN 0.0 ELSE c_acctbal END AS c_acctbal, c_mktsegment, a OR b AS fixed FROM f",
    ),
    "v05_error_groups": (
        lambda s, d: quality.error_groups(_routed(s, d), "c_custkey", "c_nationkey"),
        f"SELECT diagnosis, kind, count(*) AS n, count(DISTINCT c_custkey) AS rows, array_to_string(list_sort(list(DISTINCT c_nationkey::VARCHAR))[1:5], '|') AS samples FROM {ROUTED} GROUP BY 1, 2",
    ),
    "v05_error_group_ids": (lambda s, d: quality.error_group_ids(_routed(s, d), "c_custkey"), f"SELECT DISTINCT diagnosis, kind, c_custkey FROM {ROUTED}"),
    "v06_open_errors": (
        lambda s, d: quality.open_errors(_states(s, d)),
        f"SELECT CASE severity WHEN 'critical' THEN 0 WHEN 'error' THEN 1 WHEN 'warning' THEN 2 ELSE 3 END::BIGINT AS place, severity, count(*) AS n FROM {STATES} WHERE state = 'open' GROUP BY 1, 2",
    ),
    "v06_error_states": (
        lambda s, d: quality.error_states(_states(s, d)),
        f"SELECT kind, count(*) AS n, count(*) FILTER (WHERE state = 'fixed') AS fixed, count(*) FILTER (WHERE state = 'escalated') AS escalated, count(*) FILTER (WHERE state = 'open') AS open FROM {STATES} GROUP BY 1",
    ),
    "v07_completeness": (
        lambda s, d: quality.completeness(_sparse(s, d)),
        " UNION ALL ".join(f"SELECT '{n}' AS \"column\", count(*) FILTER (WHERE {c}) AS filled, {_filled(c)} AS pct FROM customer" for n, c in (("c_nationkey", "true"), ("balance", "c_acctbal > 0"), ("name", "c_custkey % 3 > 0"), ("c_mktsegment", "true"))),
    ),
    "v08_source_quality": (
        lambda s, d: quality.source_quality(table(s, d, "documents"), "source", {"english": F.col("lang") == "en", "long": F.col("n_chars") > 1000}),
        f"SELECT *, round((english + long) / 2, 2) AS score FROM (SELECT source, count(*) AS n, {_filled("lang = 'en'")} AS english, {_filled('n_chars > 1000')} AS long FROM documents GROUP BY 1)",
    ),
    "v08_completeness_by": (
        lambda s, d: quality.completeness(_sparse(s, d), "c_nationkey"),
        " UNION ALL ".join(f"SELECT c_nationkey, '{n}' AS \"column\", count(*) FILTER (WHERE {c}) AS filled, {_filled(c)} AS pct FROM customer GROUP BY 1" for n, c in (("balance", "c_acctbal > 0"), ("name", "c_custkey % 3 > 0"), ("c_mktsegment", "true"))),
    ),
    "v09_run_checks": (
        _checks,
        "WITH c AS (SELECT 'positive' AS \"check\", count(*) AS n, " + _filled("c_acctbal > 0") + " AS pct, 95.0::DOUBLE AS least FROM customer UNION ALL SELECT 'named', count(*), " + _filled("trim(c_name) <> ''") + ", 100 FROM customer "
        "UNION ALL SELECT 'dated', count(*), " + _filled("o_orderdate IS NOT NULL") + ", 99 FROM orders UNION ALL SELECT 'open', count(*), " + _filled("o_orderstatus <> 'F'") + ", 70 FROM orders) "
        "SELECT *, pct >= least AS passed, CASE WHEN pct >= least THEN 'ok' WHEN pct >= least - 10 THEN 'warning' ELSE 'critical' END AS level FROM c",
    ),
    "v10_integrity": (
        lambda s, d: quality.integrity(table(s, d, "lineitem").withColumn("k", F.when(F.col("l_quantity") > 2, F.col("l_orderkey"))), "k", "l_returnflag", "l_shipdate", "1995-06-01", "2001-01-01"),
        "SELECT count(*) FILTER (WHERE l_quantity <= 2) AS null_keys, 0 AS bad_characters, count(*) FILTER (WHERE l_shipdate::DATE > DATE '2001-01-01') AS future, count(*) FILTER (WHERE l_shipdate::DATE < DATE '1995-06-01') AS too_old, "
        "(SELECT count(*) FROM (SELECT l_orderkey FROM lineitem WHERE l_quantity > 2 GROUP BY 1 HAVING count(*) > 1)) AS repeated_keys FROM lineitem",
    ),
    "v10_child_coverage": (
        lambda s, d: quality.child_coverage(table(s, d, "orders").where("o_orderstatus <> 'P'"), table(s, d, "lineitem"), "o_orderkey", "l_orderkey"),
        "WITH p AS (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P'), n AS (SELECT (SELECT count(*) FROM p) AS n, (SELECT count(*) FROM p WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)) AS covered, "
        "(SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM p)) AS orphans) SELECT *, round(covered * 100.0::DOUBLE / n, 2) AS covered_pct FROM n",
    ),
    "v11_schema_check": (
        lambda s, d: quality.schema_check(_sparse(s, d), ["name", "balance", "absent"]),
        "SELECT 'name' AS \"column\", true AS present, 0 AS nulls, true AS ok UNION ALL SELECT 'balance', true, count(*) FILTER (WHERE NOT coalesce(c_acctbal > 0, false)), count(*) FILTER (WHERE NOT coalesce(c_acctbal > 0, false)) = 0 FROM customer "
        "UNION ALL SELECT 'absent', false, NULL, false",
    ),
    "v12_richness": (
        lambda s, d: quality.richness_by(table(s, d, "customer"), quality.richness(_flags()), "c_nationkey"),
        f"SELECT c_nationkey, count(*) AS n, round(avg({RICH}), 4) AS mean_score FROM customer GROUP BY 1",
    ),
    "v12_length_bands": (
        lambda s, d: quality.richness_by(table(s, d, "documents"), quality.richness([F.col("lang") == "en", F.col("n_chars") > 100]), quality.length_band(F.col("n_chars")).alias("band")),
        "SELECT CASE WHEN n_chars <= 500 THEN '<=500' WHEN n_chars <= 1000 THEN '501-1000' WHEN n_chars <= 2000 THEN '1001-2000' WHEN n_chars <= 5000 THEN '2001-5000' ELSE '>5000' END AS band, count(*) AS n, round(avg((lang = 'en')::INT + (n_chars > 100)::INT), 4) AS mean_score FROM documents GROUP BY 1",
    ),
    "v13_gold_precision": (
        lambda s, d: quality.gold_precision(table(s, d, "documents").where("lang <> 'fr'").select("doc_id", F.when(F.col("n_chars") > 300, 1).otherwise(0).alias("got")), table(s, d, "labels"), "doc_id", "got", "quality"),
        "WITH r AS (SELECT quality, CASE WHEN lang <> 'fr' THEN (n_chars > 300)::INT END AS got FROM labels LEFT JOIN documents USING (doc_id)) SELECT count(*) AS n, count(*) FILTER (WHERE got = quality) AS correct, count(*) FILTER (WHERE got <> quality) AS wrong, "
        "count(*) FILTER (WHERE got IS NULL) AS pending, round(count(*) FILTER (WHERE got = quality) * 100.0::DOUBLE / count(got), 2) AS precision_pct FROM r",
    ),
    "v14_stage_failures": (
        _failures,
        "WITH r AS (SELECT doc_id, CASE WHEN lang = 'de' THEN 'extract missing' WHEN n_chars <= 200 THEN 'extract rejected' WHEN quality IS NULL THEN 'match missing' WHEN quality <> 1 THEN 'match rejected' WHEN toxic <> 0 THEN 'check rejected' END AS f FROM documents LEFT JOIN labels USING (doc_id)) "
        "SELECT doc_id, split_part(f, ' ', 1) AS stage, split_part(f, ' ', 2) AS reason FROM r WHERE f IS NOT NULL",
    ),
}
