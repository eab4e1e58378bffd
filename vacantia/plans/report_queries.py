"""Queries of the reporting operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from vacantia.operators import report
from vacantia.plans.matching_queries import _parts
from vacantia.sources.tables import table

AS_OF = "2024-01-28"


def _money(df, col):
    return df.withColumn(col, F.col(col).cast("decimal(18,2)"))


def _priced(s, d):
    rows = table(s, d, "lineitem").join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey")).join(table(s, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.join(table(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))


def _readings(s, d):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(s, d, "events").select("event_type", "ts", k.alias("found"), F.lit(90).cast("long").alias("reported"))


def _day_counts(s, d):
    return table(s, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


def _users(s, d):
    return table(s, d, "customer").select(F.col("c_nationkey").alias("org"), F.col("c_custkey").alias("user_id"))


KEYWORDS = ("license", "the", "pour", "und", "error", "email")


def _bands():
    return {
        "price": [("low", F.col("o_totalprice") < 100000), ("mid", F.col("o_totalprice") < 300000), ("high", F.col("o_totalprice") >= 300000)],
        "priority": [(p, F.col("o_orderpriority") == p) for p in ("1-URGENT", "2-HIGH", "3-MEDIUM")] + [("other", F.col("o_orderpriority").isNotNull())],
    }


def _stratified(s, d):
    df = table(s, d, "documents")
    df = df.select("doc_id", "source", F.when(F.col("n_chars") > 3000, "long").when(F.col("n_chars") > 500, "mid").otherwise("short").alias("stratum"))
    return report.stratified_sample(df, "doc_id", "source", "stratum", 200, 2, {"long": 0.4, "mid": 0.4, "short": 0.2})


def _region():
    n = F.substring_index("n_name", "_", -1).cast("int")
    return F.when(n < 8, "north").when(n < 16, "centre").otherwise("south")


def _customers(s, d):
    return table(s, d, "customer").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))


QUERIES = {
    "a01_kpis": (
        lambda s, d: report.kpis(table(s, d, "documents"), {"langs": "lang", "sources": "source"}),
        "SELECT count(*) AS n, count(DISTINCT lang) AS langs, count(DISTINCT source) AS sources FROM documents",
    ),
    "a02_share": (
        lambda s, d: report.share(table(s, d, "documents"), "source"),
        "SELECT coalesce(source, 'unknown') AS source, count(*) AS n, "
        "round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 2) AS pct FROM documents GROUP BY 1",
    ),
    "a03_top_n": (
        lambda s, d: report.top_n(table(s, d, "part"), "p_brand", 10),
        "SELECT p_brand, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_brand LIMIT 10",
    ),
    "a04_code_tree": (
        lambda s, d: report.code_tree(table(s, d, "part"), "p_type", "p_brand"),
        "SELECT CASE WHEN grouping(p_brand) = 1 THEN 1 ELSE 2 END::BIGINT AS level, p_type, p_brand, count(*) AS n "
        "FROM part GROUP BY ROLLUP (p_type, p_brand) HAVING grouping(p_type) = 0",
    ),
    "a05_requirements": (
        lambda s, d: report.banded(table(s, d, "orders"), _bands()),
        "SELECT 'price' AS dimension, CASE WHEN o_totalprice < 100000 THEN 0 WHEN o_totalprice < 300000 THEN 1 ELSE 2 END::BIGINT AS place, "
        "CASE WHEN o_totalprice < 100000 THEN 'low' WHEN o_totalprice < 300000 THEN 'mid' ELSE 'high' END AS band, count(*) AS n FROM orders GROUP BY ALL "
        "UNION ALL SELECT 'priority', CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 ELSE 3 END::BIGINT, "
        "CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN o_orderpriority ELSE 'other' END, count(*) FROM orders GROUP BY ALL",
    ),
    "a06_list_counts": (
        lambda s, d: report.list_counts(table(s, d, "part"), "p_name", " "),
        "SELECT item, count(*) AS n FROM (SELECT unnest(list_transform(string_split(p_name, ' '), lambda x: lower(trim(x)))) AS item FROM part) WHERE item <> '' GROUP BY 1",
    ),
    "a07_category_shares": (
        lambda s, d: report.category_shares(table(s, d, "lineitem").withColumnRenamed("l_orderkey", "k"), table(s, d, "orders").where("o_orderstatus = 'F'").withColumnRenamed("o_orderkey", "k"), "k", "l_returnflag", F.col("l_discount") > 0.05),
        "SELECT l_returnflag, count(*) AS n, count(*) FILTER (WHERE l_discount > 0.05) AS flagged, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 2) AS pct "
        "FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1",
    ),
    "a08_top_per_group": (
        lambda s, d: report.top_per_group(table(s, d, "part"), "p_type", "p_brand", 3),
        "SELECT * FROM (SELECT p_type, p_brand, count(*) AS n, row_number() OVER (PARTITION BY p_type ORDER BY count(*) DESC, p_brand) AS rank FROM part GROUP BY 1, 2) WHERE rank <= 3",
    ),
    "a09_matrix": (
        lambda s, d: report.matrix(table(s, d, "customer"), "c_nationkey", "c_mktsegment", 10),
        "WITH t AS (SELECT c_nationkey FROM customer GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 10), g AS (SELECT DISTINCT c_mktsegment FROM customer) "
        "SELECT t.c_nationkey, g.c_mktsegment, count(c.c_custkey) AS n FROM t CROSS JOIN g LEFT JOIN customer c ON c.c_nationkey = t.c_nationkey AND c.c_mktsegment = g.c_mktsegment GROUP BY 1, 2",
    ),
    "a10_page": (
        lambda s, d: report.page(table(s, d, "customer").select("c_custkey", "c_name", "c_acctbal"), [F.desc("c_acctbal"), F.asc("c_custkey")], 25, 50),
        "SELECT c_custkey, c_name, c_acctbal, (SELECT count(*) FROM customer) AS total FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 25 OFFSET 50",
    ),
    "a11_funnel": (
        lambda s, d: report.funnel(table(s, d, "events").withColumnRenamed("event_id", "doc_id"), table(s, d, "labels"), "doc_id", "ts", AS_OF, "quality"),
        f"SELECT count(*) AS n, count(*) FILTER (WHERE ts::DATE = DATE '{AS_OF}') AS today, count(*) FILTER (WHERE ts::DATE > DATE '{AS_OF}' - 7 AND ts::DATE <= DATE '{AS_OF}') AS last_7_days, "
        "count(DISTINCT CASE WHEN event_id IN (SELECT doc_id FROM labels) THEN event_id END) AS processed, (SELECT round(avg(quality), 4) FROM labels) AS mean_score, "
        "round(count(DISTINCT CASE WHEN event_id IN (SELECT doc_id FROM labels) THEN event_id END) * 100.0::DOUBLE / count(*), 2) AS processed_pct FROM events",
    ),
    "a12_funnel_daily": (
        lambda s, d: report.funnel_daily(
            {"events": (table(s, d, "events"), "event_id", "ts"), "buyers": (table(s, d, "events").where("event_type = 'purchase'"), "user_id", "ts")}, "2023-12-30", "2024-01-31"
        ).withColumn("day", F.date_format("day", "yyyy-MM-dd")),
        "WITH s AS (SELECT unnest(generate_series(DATE '2023-12-30', DATE '2024-01-31', INTERVAL 1 DAY))::DATE AS day) "
        "SELECT strftime(day, '%Y-%m-%d') AS day, count(DISTINCT event_id) AS events, count(DISTINCT CASE WHEN event_type = 'purchase' THEN user_id END) AS buyers FROM s LEFT JOIN events ON ts::DATE = day GROUP BY 1",
    ),
    "a13_daily_cumulative": (
        lambda s, d: report.daily_cumulative(table(s, d, "orders"), "o_orderdate").withColumn("day", F.date_format("day", "yyyy-MM-dd")),
        "SELECT strftime(day, '%Y-%m-%d') AS day, n, sum(n) OVER (ORDER BY day)::BIGINT AS total FROM (SELECT o_orderdate::DATE AS day, count(*) AS n FROM orders GROUP BY 1)",
    ),
    "a14_coverage": (
        lambda s, d: report.coverage(_readings(s, d), "event_type", "ts", "found", "reported").withColumn("day", F.date_format("day", "yyyy-MM-dd")),
        "WITH r AS (SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, arg_max(CAST(props->>'$.k' AS BIGINT), ts) AS found, 90::BIGINT AS reported FROM events GROUP BY 1, 2) "
        "SELECT *, reported - found AS gap, round(found * 100.0::DOUBLE / reported, 2) AS pct, CASE WHEN round(found * 100.0::DOUBLE / reported, 2) >= 95 THEN 'complete' "
        "WHEN round(found * 100.0::DOUBLE / reported, 2) >= 80 THEN 'partial' ELSE 'low' END AS status FROM r",
    ),
    "a15_occupations_top": (
        lambda s, d: report.in_demand(_priced(s, d), "p_name", "l_quantity", "l_suppkey", "n_name", 20),
        "SELECT p_name, count(*) AS n, round(avg(l_quantity), 2) AS mean_score, count(DISTINCT l_suppkey) AS skills, array_to_string(list_sort(list(DISTINCT n_name)), ', ') AS places "
        "FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1 ORDER BY n DESC, p_name LIMIT 20",
    ),
    "a16_skills_top": (
        lambda s, d: report.skills_top(table(s, d, "part"), table(s, d, "lineitem").withColumnRenamed("l_partkey", "p_partkey"), "p_partkey", "p_name", "l_returnflag", "A", 50),
        "SELECT p_partkey, p_name, count(l_partkey) AS n, count(*) FILTER (WHERE l_returnflag = 'A') AS essential, count(l_partkey) - count(*) FILTER (WHERE l_returnflag = 'A') AS optional "
        "FROM part LEFT JOIN lineitem ON p_partkey = l_partkey GROUP BY 1, 2 ORDER BY n DESC, p_partkey LIMIT 50",
    ),
    "a17_match_quality": (
        lambda s, d: report.match_quality(table(s, d, "events"), "value", 75.0, 55.0),
        "SELECT count(*) AS n, min(value) AS least, max(value) AS most, round(quantile_cont(value, 0.5), 4) AS median, count(*) FILTER (WHERE value >= 75) AS high, "
        "count(*) FILTER (WHERE value >= 55 AND value < 75) AS mid, count(*) FILTER (WHERE value < 55) AS low FROM events",
    ),
    "a18_hierarchy_counts": (
        lambda s, d: report.hierarchy_counts(table(s, d, "nation"), table(s, d, "supplier"), "n_nationkey", "s_nationkey", "n_name", "s_suppkey"),
        "SELECT n_nationkey, n_name, count(DISTINCT s_suppkey) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2",
    ),
    "a19_occupation_by": (
        lambda s, d: report.counts_by(_priced(s, d), "p_type", "n_name", F.date_format("l_shipdate", "yyyy-MM-dd").alias("day")),
        "SELECT p_type, n_name, strftime(l_shipdate, '%Y-%m-%d') AS day, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey "
        "JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL",
    ),
    "a20_series": (
        lambda s, d: report.series(_money(table(s, d, "orders"), "o_totalprice"), "o_orderdate", "o_totalprice").select("period", "n", *[F.col(c).cast("double").alias(c) for c in ("mean", "median", "least", "most")]),
        "SELECT strftime(o_orderdate, '%Y-W%U') AS period, count(*) AS n, sum(o_totalprice::DECIMAL(18,2))::DOUBLE / count(*) AS mean, quantile_cont(o_totalprice, 0.5) AS median, "
        "min(o_totalprice) AS least, max(o_totalprice) AS most FROM orders GROUP BY 1",
    ),
    "a21_heatmap": (
        lambda s, d: report.heatmap(table(s, d, "orders"), "o_orderdate"),
        "SELECT (isodow(o_orderdate) - 1)::BIGINT AS weekday, " + ", ".join(f"count(*) FILTER (WHERE month(o_orderdate) = {m}) AS m{m:02d}" for m in range(1, 13)) + " FROM orders GROUP BY 1",
    ),
    "a22_moving_avg": (
        lambda s, d: report.moving_avg(_day_counts(s, d), "day", "n"),
        "SELECT day, n, CASE WHEN count(*) OVER w = 7 THEN round(avg(n) OVER w, 4) END AS moving_avg FROM (SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS n FROM orders GROUP BY 1) "
        "WINDOW w AS (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)",
    ),
    "a23_month_over_month": (
        lambda s, d: report.month_over_month(table(s, d, "orders"), "o_orderdate"),
        "SELECT month, n, round((n - lag(n) OVER (ORDER BY month)) * 100.0::DOUBLE / lag(n) OVER (ORDER BY month), 2) AS change_pct FROM (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1)",
    ),
    "a24_keyword_yield": (
        lambda s, d: report.keyword_yield(table(s, d, "lineitem").select(F.col("l_suppkey").alias("keyword"), F.col("l_quantity").cast("long").alias("found"), F.when(F.col("l_returnflag") == "N", F.col("l_quantity").cast("long")).otherwise(0).alias("new")), "keyword", "found", "new", 590),
        "SELECT l_suppkey AS keyword, count(*) AS runs, sum(l_quantity)::BIGINT AS found, sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END)::BIGINT AS new, count(*) FILTER (WHERE l_quantity = 0) AS empty_runs, "
        "round(sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END) * 100.0 / sum(l_quantity), 2) AS novelty_pct FROM lineitem GROUP BY 1 HAVING count(*) >= 590",
    ),
    "a25_keyword_overlap": (
        lambda s, d: report.keyword_overlap(table(s, d, "lineitem"), "l_suppkey", "l_orderkey"),
        "WITH p AS (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem), k AS (SELECT l_orderkey, count(*) AS k FROM p GROUP BY 1) "
        "SELECT l_suppkey, count(*) AS ids, count(*) FILTER (WHERE k = 1) AS only_here, count(*) FILTER (WHERE k > 1) AS shared, round(count(*) FILTER (WHERE k > 1) * 100.0::DOUBLE / count(*), 2) AS redundancy_pct FROM p JOIN k USING (l_orderkey) GROUP BY 1",
    ),
    "a25_overlap_pairs": (
        lambda s, d: report.overlap_pairs(table(s, d, "lineitem"), "l_suppkey", "l_orderkey", 30, _parts(s, d)),
        "WITH p AS (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem) SELECT x.l_suppkey AS a, y.l_suppkey AS b, count(*) AS n FROM p x JOIN p y ON x.l_orderkey = y.l_orderkey AND x.l_suppkey < y.l_suppkey GROUP BY 1, 2 ORDER BY n DESC, a, b LIMIT 30",
    ),
    "a26_snapshot_metrics": (
        lambda s, d: report.snapshot_metrics(_money(table(s, d, "orders"), "o_totalprice"), "o_orderstatus", "o_totalprice").select("o_orderstatus", "n", *[F.col(c).cast("double").alias(c) for c in ("mean", "upper_median")]),
        "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice::DECIMAL(18,2))::DOUBLE / count(*), 2) AS mean, list_sort(list(o_totalprice))[(count(*) // 2) + 1] AS upper_median FROM orders GROUP BY 1",
    ),
    "a26_first_digits": (
        lambda s, d: report.first_digits(table(s, d, "orders"), "o_orderkey"),
        "SELECT substr(o_orderkey::VARCHAR, 1, 1) AS digit, count(*) AS n FROM orders GROUP BY 1",
    ),
    "a27_json_stats": (
        lambda s, d: report.json_stats(table(s, d, "events"), "props", "k", "event_type"),
        "SELECT event_type, count(*) AS n, round(avg(v), 2) AS mean, min(v) AS least, max(v) AS most FROM (SELECT event_type, CAST(props->>'$.k' AS DOUBLE) AS v FROM events) WHERE v IS NOT NULL GROUP BY 1",
    ),
    "a28_stratified_sample": (_stratified, None),
    "a29_usage": (
        lambda s, d: report.usage(table(s, d, "nation").select(F.col("n_nationkey").alias("org")), _users(s, d), table(s, d, "events"), "org", "user_id", "ts", "event_type", "2024-02-15", ("click", "signup")),
        "WITH u AS (SELECT c_nationkey AS org, c_custkey AS user_id FROM customer), a AS (SELECT org, count(DISTINCT CASE WHEN ts::DATE > DATE '2024-02-15' - 30 THEN user_id END) AS active_users, count(*) AS events, "
        "count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'signup') AS signup FROM events JOIN u USING (user_id) GROUP BY 1) "
        "SELECT n_nationkey AS org, coalesce(m.users, 0) AS users, coalesce(active_users, 0) AS active_users, coalesce(events, 0) AS events, coalesce(click, 0) AS click, coalesce(signup, 0) AS signup "
        "FROM nation LEFT JOIN (SELECT org, count(*) AS users FROM u GROUP BY 1) m ON m.org = n_nationkey LEFT JOIN a ON a.org = n_nationkey",
    ),
    "a30_session_rates": (
        lambda s, d: report.session_rates(table(s, d, "events"), "user_id", "ts", F.col("event_type") != "error", AS_OF),
        f"SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type <> 'error') AS ok, round(count(*) FILTER (WHERE event_type <> 'error') * 100.0::DOUBLE / count(*), 2) AS rate_pct "
        f"FROM events WHERE ts::DATE > DATE '{AS_OF}' - 7 AND ts::DATE <= DATE '{AS_OF}' GROUP BY 1",
    ),
    "a31_alerts_recent": (
        lambda s, d: report.alerts_recent(table(s, d, "events").where("event_type = 'error'"), F.when(F.col("value") >= 100, "critical").when(F.col("value") >= 50, "warning").otherwise("info"), "ts", f"{AS_OF} 12:00:00"),
        f"SELECT CASE WHEN value >= 100 THEN 'critical' WHEN value >= 50 THEN 'warning' ELSE 'info' END AS level, count(*) AS n FROM events WHERE event_type = 'error' "
        f"AND ts > TIMESTAMP '{AS_OF} 12:00:00' - INTERVAL 24 HOURS AND ts <= TIMESTAMP '{AS_OF} 12:00:00' GROUP BY 1",
    ),
    "a32_keyword_series": (
        lambda s, d: report.keyword_series(table(s, d, "documents"), KEYWORDS, F.col("source"), "text", "lang"),
        f"SELECT source AS day, keyword, count(*) AS n FROM documents, (SELECT unnest({list(KEYWORDS)}) AS keyword) WHERE contains(lower(text || chr(10) || lang), keyword) GROUP BY 1, 2",
    ),
    "a33_regional_rates": (
        lambda s, d: report.regional_profile(_customers(s, d), _region(), "c_mktsegment", F.col("c_acctbal") > 0, "n_name", 3)[0],
        "SELECT CASE WHEN split_part(n_name, '_', 2)::INT < 8 THEN 'north' WHEN split_part(n_name, '_', 2)::INT < 16 THEN 'centre' ELSE 'south' END AS region, c_mktsegment, count(*) AS n, count(*) FILTER (WHERE c_acctbal > 0) AS done, "
        "round(count(*) FILTER (WHERE c_acctbal > 0) * 100.0::DOUBLE / count(*), 2) AS done_pct FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2",
    ),
    "a33_regional_top": (
        lambda s, d: report.regional_profile(_customers(s, d), _region(), "c_mktsegment", F.col("c_acctbal") > 0, "n_name", 3)[1],
        "WITH c AS (SELECT CASE WHEN split_part(n_name, '_', 2)::INT < 8 THEN 'north' WHEN split_part(n_name, '_', 2)::INT < 16 THEN 'centre' ELSE 'south' END AS region, n_name, count(*) AS n "
        "FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY n DESC, n_name) AS rank FROM c) WHERE rank <= 3",
    ),
}
