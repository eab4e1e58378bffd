"""Queries of sources, incremental load, lifecycle and run comparison."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vacantia.operators import ingest, lifecycle, runs
from vacantia.sources.scratch import scratch_dir
from vacantia.sources.tables import table
from vacantia.sources.versioned import VersionedTable

AS_OF = "2001-08-15"


def _day(c):
    return F.date_format(c, "yyyy-MM-dd")


def _orders(s, d):
    o = table(s, d, "orders")
    return o.select("o_orderkey", "o_custkey", "o_orderstatus", F.col("o_totalprice").cast("long").alias("price"), _day("o_orderdate").alias("day"))


def _sources(s, d):
    a = table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("2024-01-05").alias("day"), "c_mktsegment")
    b = table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("2024-02-05").alias("day"), "s_acctbal")
    c = table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), F.lit(None).cast("string").alias("day"))
    return [a, b, c]


def _split_history(s, d):
    """Orders as an old and a new state: the batch has every third key, changed, and new keys."""
    o = _orders(s, d)
    old = o.where("o_orderkey % 7 > 0")
    new = o.where("o_orderkey % 3 = 0").withColumn("price", F.col("price") + F.col("o_orderkey") % 2).withColumn("day", F.lit("2002-01-01"))
    return old, new


def _read_parquet(s, d):
    schema = "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    return ingest.read_source(s, "parquet", f"{d}/customer.parquet", schema)


CUSTOMER = "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
#: One line in so many doesn't fit the schema.
BROKEN = 50


def _read_csv(s, d):
    """The table from CSV that is written before; some lines have a word for the nation."""
    path = f"{scratch_dir(s)}/source-{uuid.uuid4().hex}"
    nation = F.when(F.col("c_custkey") % BROKEN == 0, "x?").otherwise(F.col("c_nationkey").cast("string")).alias("c_nationkey")
    table(s, d, "customer").select("c_custkey", "c_name", nation, "c_acctbal", "c_mktsegment").write.option("header", True).csv(path)
    return ingest.read_source(s, "csv", path, CUSTOMER)


def _read_json(s, d):
    """The table from JSON lines that are written before; some lines lack their end."""
    path = f"{scratch_dir(s)}/source-{uuid.uuid4().hex}"
    line = F.to_json(F.struct("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"))
    cut = F.when(F.col("c_custkey") % BROKEN == 0, F.substring(line, F.lit(1), F.length(line) - 2)).otherwise(line)
    table(s, d, "customer").select(cut.alias("value")).write.text(path)
    return ingest.read_source(s, "json", path, CUSTOMER)


def _stored(s):
    return VersionedTable(s, f"{scratch_dir(s)}/table-{uuid.uuid4().hex}")


def _upsert_stored(s, d):
    """The two states one after the other into a stored target, the second one twice."""
    old, new = _split_history(s, d)
    target = _stored(s)
    for number, batch in ((0, old), (1, new), (1, new)):
        ingest.upsert_into(target, batch, ["o_orderkey"], "day", number=number)
    return target.read()


def _append_stored(s, d):
    """A stored log by status: the old state, then what is new in the batch."""
    old, new = _split_history(s, d)
    log, content = _stored(s), ["o_orderkey", "price"]
    ingest.append_into(log, old.withColumn("content_hash", ingest.content_hash(*content)), "o_orderstatus")
    ingest.append_into(log, ingest.append_versions(log.read(), new, ["o_orderkey"], content), "o_orderstatus")
    return log.read().select("o_orderkey", "o_orderstatus", "price", "content_hash")


def _append(s, d):
    old, new = _split_history(s, d)
    log = old.withColumn("content_hash", ingest.content_hash("o_orderkey", "price"))
    return ingest.append_versions(log, new, ["o_orderkey"], ["o_orderkey", "price"]).select("o_orderkey", "price", "content_hash")


def _export(s, d, part):
    valid = F.col("quality") == 1
    documents = table(s, d, "documents").select("doc_id", "lang", "source")
    skills = table(s, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("p_partkey"), "l_linenumber")
    frames = ingest.export_snapshot(documents, table(s, d, "labels"), skills, table(s, d, "part"), "doc_id", "p_partkey", valid)
    return frames[part]


def _rules():
    return {"named": F.col("c_name").startswith("Customer"), "positive": F.col("c_acctbal") > 0, "known_segment": F.col("c_mktsegment").isin("BUILDING", "MACHINERY", "HOUSEHOLD")}


VALID = "(c_name LIKE 'Customer%' AND c_acctbal > 0 AND c_mktsegment IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD'))"
OLD = "(SELECT o_orderkey, o_custkey, o_orderstatus, trunc(o_totalprice)::BIGINT AS price, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE o_orderkey % 7 > 0)"
NEW = "(SELECT o_orderkey, o_custkey, o_orderstatus, trunc(o_totalprice)::BIGINT + o_orderkey % 2 AS price, '2002-01-01' AS day FROM orders WHERE o_orderkey % 3 = 0)"


def _store(s, d):
    o = table(s, d, "orders").where("o_orderkey % 5 > 0")
    return o.select(
        F.col("o_orderkey").alias("key"),
        F.when(F.col("o_orderstatus") == "F", "delisted").otherwise("active").alias("state"),
        _day("o_orderdate").alias("first_seen"),
        _day("o_orderdate").alias("last_seen"),
        F.when(F.col("o_orderstatus") == "F", _day("o_orderdate")).alias("delisted_on"),
        F.lit(1).alias("times_seen"),
    )


def _scrape(s, d):
    return table(s, d, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("key"))


STORE = (
    "(SELECT o_orderkey AS key, CASE WHEN o_orderstatus = 'F' THEN 'delisted' ELSE 'active' END AS state, strftime(o_orderdate, '%Y-%m-%d') AS first_seen, strftime(o_orderdate, '%Y-%m-%d') AS last_seen, "
    "CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate, '%Y-%m-%d') END AS delisted_on, 1 AS times_seen FROM orders WHERE o_orderkey % 5 > 0)"
)
SCRAPE = "(SELECT o_orderkey AS key FROM orders WHERE o_orderkey % 2 = 0)"


def _stays(s, d):
    rows = table(s, d, "orders").join(table(s, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("gone")), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return lifecycle.permanence(rows, "o_orderdate", "gone", AS_OF).select("o_orderkey", "o_orderstatus", "o_orderpriority", "days", "band")


STAYS = (
    f"(SELECT o_orderkey, o_orderstatus, o_orderpriority, days, CASE WHEN days < 7 THEN 'low' WHEN days <= 30 THEN 'mid' ELSE 'high' END AS band FROM (SELECT *, date_diff('day', o_orderdate::DATE, coalesce(gone::DATE, DATE '{AS_OF}')) AS days "
    "FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS gone FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey))"
)


def _metrics(s, d):
    e = table(s, d, "events")
    return e.groupBy((F.col("user_id") % 3).alias("run"), F.col("event_type").alias("metric")).agg(F.count("*").alias("value"))


def _batches(s, d):
    o = table(s, d, "orders")
    return o.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("batch")).agg(
        F.count("*").alias("n_rows"), F.count_if(F.expr("o_totalprice > 480000")).alias("n_rules"), F.count_if(F.expr("o_orderstatus = 'F'")).alias("n_covered")
    )


BATCHES = "(SELECT strftime(o_orderdate, '%Y-%m') AS batch, count(*) AS n_rows, count(*) FILTER (WHERE o_totalprice > 480000) AS n_rules, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_covered FROM orders GROUP BY 1)"
RATES = f"(SELECT *, round(n_rules * 100.0::DOUBLE / n_rows, 2) AS learning_rate, round(n_covered * 100.0::DOUBLE / n_rows, 2) AS coverage_pct FROM {BATCHES})"


def _with_rate(s, d):
    return runs.batch_metrics(_batches(s, d), "n_rows", "n_rules", "n_covered")


def _chain(s, d):
    return _batches(s, d).withColumn("previous", F.date_format(F.add_months(F.to_date(F.concat("batch", F.lit("-01"))), -2), "yyyy-MM"))


def _phases(s, d):
    c = table(s, d, "customer").select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("segment"), F.when(F.col("c_nationkey") > 3, F.col("c_name")).otherwise(" ").alias("name"), "c_nationkey")
    b = table(s, d, "customer").select("c_custkey", F.when(F.col("c_acctbal") > -500, F.col("c_mktsegment")).alias("segment"), F.when(F.col("c_nationkey") > 1, F.col("c_name")).alias("name"), "c_nationkey")
    return c, b


PHASE_A = "(SELECT c_custkey, c_nationkey, CASE WHEN c_acctbal > 0 THEN c_mktsegment END AS segment, CASE WHEN c_nationkey > 3 THEN c_name ELSE ' ' END AS name FROM customer)"
PHASE_B = "(SELECT c_custkey, c_nationkey, CASE WHEN c_acctbal > -500 THEN c_mktsegment END AS segment, CASE WHEN c_nationkey > 1 THEN c_name END AS name FROM customer)"
FILLED = " UNION ALL ".join(f"SELECT '{f}' AS field, round(count(*) FILTER (WHERE trim(coalesce(x.{f}, '')) <> '') * 100.0::DOUBLE / count(*), 2) AS pct FROM {{0}} x" for f in ("segment", "name"))

UPSERTED = (
        f"SELECT o_orderkey, o_custkey, o_orderstatus, price, day FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY day DESC) AS r FROM (SELECT * FROM {OLD} UNION ALL SELECT * FROM {NEW})) WHERE r = 1"
)
QUERIES = {
    "s01_read_source": (_read_parquet, "SELECT * FROM customer"),
    "s01_read_csv": (
        _read_csv,
        f"SELECT c_custkey, c_name, CASE WHEN bad THEN NULL ELSE c_nationkey END AS c_nationkey, c_acctbal, c_mktsegment, CASE WHEN bad THEN c_custkey || ',' || c_name || ',x?,' || c_acctbal || ',' || c_mktsegment END AS _corrupt FROM (SELECT *, c_custkey % {BROKEN} = 0 AS bad FROM customer)",
    ),
    "s01_read_json": (
        _read_json,
        "SELECT " + ", ".join(f"CASE WHEN NOT bad THEN {c} END AS {c}" for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")) + ", CASE WHEN bad THEN '{\"c_custkey\":' || c_custkey || ',\"c_name\":\"' || c_name || '\",\"c_nationkey\":' || c_nationkey || "
        f"',\"c_acctbal\":' || c_acctbal || ',\"c_mktsegment\":\"' || c_mktsegment END AS _corrupt FROM (SELECT *, c_custkey % {BROKEN} = 0 AS bad FROM customer)",
    ),
    "s02_consolidate": (
        lambda s, d: ingest.consolidate(_sources(s, d), "day", "2024-01-01", "2024-02-28"),
        "SELECT c_custkey AS id, c_name AS name, '2024-01-05' AS day, c_mktsegment, NULL::DOUBLE AS s_acctbal FROM customer UNION ALL SELECT s_suppkey, s_name, '2024-02-05', NULL, s_acctbal FROM supplier",
    ),
    "s03_upsert": (
        lambda s, d: ingest.upsert(*_split_history(s, d), ["o_orderkey"], "day"),
        UPSERTED,
    ),
    "s03_upsert_stored": (_upsert_stored, UPSERTED),
    "s04_append_versions": (
        _append,
        f"SELECT o_orderkey, price, sha256(o_orderkey::VARCHAR || chr(31) || price::VARCHAR) AS content_hash FROM {NEW} n WHERE NOT EXISTS (SELECT 1 FROM {OLD} o WHERE o.o_orderkey = n.o_orderkey AND o.price = n.price)",
    ),
    "s04_append_stored": (
        _append_stored,
        f"SELECT o_orderkey, o_orderstatus, price, sha256(o_orderkey::VARCHAR || chr(31) || price::VARCHAR) AS content_hash FROM (SELECT * FROM {OLD} UNION ALL SELECT * FROM {NEW} n WHERE NOT EXISTS (SELECT 1 FROM {OLD} o WHERE o.o_orderkey = n.o_orderkey AND o.price = n.price))",
    ),
    "s05_filter_new": (
        lambda s, d: ingest.filter_new(*reversed(_split_history(s, d)), "o_orderkey")[0],
        f"SELECT * FROM {NEW} WHERE o_orderkey NOT IN (SELECT o_orderkey FROM {OLD})",
    ),
    "s05_seen_ids": (
        lambda s, d: ingest.filter_new(*reversed(_split_history(s, d)), "o_orderkey")[1],
        f"SELECT o_orderkey FROM {NEW} UNION SELECT o_orderkey FROM {OLD}",
    ),
    "s06_stale_ids": (
        lambda s, d: ingest.stale_ids(_orders(s, d), "day", 365, AS_OF),
        f"SELECT o_orderkey, o_custkey, o_orderstatus, trunc(o_totalprice)::BIGINT AS price, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE o_orderdate::DATE < DATE '{AS_OF}' - 365",
    ),
    "s07_latest_version": (
        lambda s, d: ingest.latest_version(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.struct("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey").alias("v")), ["l_orderkey"], "v").select("l_orderkey", "l_linenumber", "l_partkey"),
        "SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC) AS r FROM lineitem) WHERE r = 1",
    ),
    "s07_active_version": (
        lambda s, d: ingest.active_version(table(s, d, "customer"), table(s, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), (F.col("n_regionkey") == 1).alias("active")), "c_nationkey", "active"),
        "SELECT * FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)",
    ),
    "s08_export_postings": (lambda s, d: _export(s, d, "postings"), "SELECT doc_id, lang, source, quality, toxic FROM documents JOIN labels USING (doc_id) WHERE quality = 1"),
    "s08_export_dimension": (
        lambda s, d: _export(s, d, "dimension"),
        "SELECT * FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_orderkey IN (SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE quality = 1))",
    ),
    "s09_json_fields": (
        lambda s, d: ingest.json_fields(table(s, d, "events").select("event_id", "props"), "props", "k bigint, missing string"),
        "SELECT event_id, props, CAST(props->>'$.k' AS BIGINT) AS k, props->>'$.missing' AS missing FROM events",
    ),
    "s10_quarantine": (
        lambda s, d: ingest.split_batch(table(s, d, "customer"), _rules())[1].withColumn("broken", F.array_join("broken", ",")),
        "SELECT *, concat_ws(',', CASE WHEN NOT c_name LIKE 'Customer%' THEN 'named' END, CASE WHEN NOT c_acctbal > 0 THEN 'positive' END, CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD') THEN 'known_segment' END) AS broken "
        f"FROM customer WHERE NOT {VALID}",
    ),
    "s10_validity": (
        lambda s, d: ingest.validity(table(s, d, "customer"), _rules(), "c_nationkey"),
        f"SELECT c_nationkey, count(*) AS n, count(*) FILTER (WHERE {VALID}) AS n_valid, round(count(*) FILTER (WHERE {VALID}) * 100.0::DOUBLE / count(*), 2) AS valid_pct FROM customer GROUP BY 1",
    ),
    "l01_detect_delisted": (
        lambda s, d: lifecycle.detect_delisted(_store(s, d), _scrape(s, d), "key", F.col("state") == "active").select("key", "status"),
        f"SELECT key, CASE WHEN key IN (SELECT key FROM {SCRAPE}) THEN 'confirmed' ELSE 'delisted' END AS status FROM {STORE} WHERE state = 'active'",
    ),
    "l02_apply_scrape": (
        lambda s, d: lifecycle.apply_scrape(_store(s, d), _scrape(s, d), "key", AS_OF),
        f"SELECT coalesce(a.key, b.key) AS key, CASE WHEN b.key IS NOT NULL THEN 'active' WHEN state = 'active' THEN 'delisted' ELSE state END AS state, coalesce(first_seen, '{AS_OF}') AS first_seen, "
        f"CASE WHEN b.key IS NOT NULL THEN '{AS_OF}' ELSE last_seen END AS last_seen, CASE WHEN b.key IS NOT NULL THEN NULL WHEN state = 'active' THEN '{AS_OF}' ELSE delisted_on END AS delisted_on, "
        f"coalesce(times_seen, 0) + (b.key IS NOT NULL)::INT AS times_seen FROM {STORE} a FULL JOIN {SCRAPE} b ON a.key = b.key",
    ),
    "l03_permanence": (_stays, f"SELECT * FROM {STAYS}"),
    "l04_permanence_stats": (
        lambda s, d: lifecycle.permanence_stats(_stays(s, d), "band", "o_orderstatus"),
        f"SELECT band, o_orderstatus, count(*) AS n, round(avg(days), 4) AS mean, min(days) AS least, max(days) AS most FROM {STAYS} GROUP BY 1, 2",
    ),
    "l04_permanence_histogram": (
        lambda s, d: lifecycle.permanence_histogram(_stays(s, d)),
        f"SELECT CASE WHEN days <= 7 THEN '<=7' WHEN days <= 15 THEN '8-15' WHEN days <= 30 THEN '16-30' WHEN days <= 60 THEN '31-60' WHEN days <= 90 THEN '61-90' ELSE '>90' END AS bin, count(*) AS n FROM {STAYS} GROUP BY 1",
    ),
    "l05_permanence_by": (
        lambda s, d: lifecycle.permanence_by(_stays(s, d), "o_orderpriority", 2990),
        f"SELECT o_orderpriority, count(*) AS n, round(avg(days), 4) AS mean, count(*) FILTER (WHERE band = 'low') AS low, count(*) FILTER (WHERE band = 'mid') AS mid, count(*) FILTER (WHERE band = 'high') AS high FROM {STAYS} GROUP BY 1 HAVING count(*) >= 2990",
    ),
    "l06_permanence_longest": (lambda s, d: lifecycle.permanence_extremes(_stays(s, d), "o_orderkey", 20), f"SELECT * FROM {STAYS} ORDER BY days DESC, o_orderkey LIMIT 20"),
    "l06_permanence_shortest": (lambda s, d: lifecycle.permanence_extremes(_stays(s, d), "o_orderkey", 20, False), f"SELECT * FROM {STAYS} ORDER BY days, o_orderkey LIMIT 20"),
    "l07_diff_snapshots": (
        lambda s, d: lifecycle.diff_snapshots(*_split_history(s, d), "o_orderkey", ["price", "day", "o_orderstatus"]),
        f"WITH j AS (SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'insert' WHEN b.o_orderkey IS NULL THEN 'delete' ELSE 'update' END AS change, a, b FROM {OLD} a FULL JOIN {NEW} b ON a.o_orderkey = b.o_orderkey), "
        "u AS (" + " UNION ALL ".join(f"SELECT o_orderkey, change, '{f}' AS field, a.{f}::VARCHAR AS old, b.{f}::VARCHAR AS new FROM j" for f in ("price", "day", "o_orderstatus")) + ") SELECT * FROM u WHERE old IS DISTINCT FROM new",
    ),
    "l08_skill_counters": (
        lambda s, d: lifecycle.skill_counters(table(s, d, "lineitem"), "l_partkey", "l_shipdate", F.col("l_returnflag") == "A", AS_OF),
        f"SELECT l_partkey, count(*) AS n, strftime(min(l_shipdate), '%Y-%m-%d') AS first_seen, strftime(max(l_shipdate), '%Y-%m-%d') AS last_seen, count(*) FILTER (WHERE l_shipdate::DATE > DATE '{AS_OF}' - 30 AND l_shipdate::DATE <= DATE '{AS_OF}') AS recent, "
        f"count(*) FILTER (WHERE l_shipdate::DATE > DATE '{AS_OF}' - 30 AND l_shipdate::DATE <= DATE '{AS_OF}' AND l_returnflag = 'A') AS recent_mandatory FROM lineitem GROUP BY 1",
    ),
    "r01_compare_metrics": (
        lambda s, d: runs.compare_metrics(_metrics(s, d), "run", "metric", "value", 0, 1),
        "WITH m AS (SELECT event_type AS metric, count(*) FILTER (WHERE user_id % 3 = 0) AS a, count(*) FILTER (WHERE user_id % 3 = 1) AS b FROM events GROUP BY 1) SELECT *, b - a AS delta, round((b - a) * 100.0::DOUBLE / a, 2) AS delta_pct FROM m",
    ),
    "r02_compare_ids": (
        lambda s, d: runs.compare_ids(*_split_history(s, d), "o_orderkey"),
        f"SELECT count(*) FILTER (WHERE a.k IS NOT NULL AND b.k IS NOT NULL) AS both, count(*) FILTER (WHERE b.k IS NULL) AS only_a, count(*) FILTER (WHERE a.k IS NULL) AS only_b FROM (SELECT o_orderkey AS k FROM {OLD}) a FULL JOIN (SELECT o_orderkey AS k FROM {NEW}) b ON a.k = b.k",
    ),
    "r03_compare_codes": (
        lambda s, d: runs.compare_codes(*_split_history(s, d), "o_orderkey", "price"),
        f"SELECT a.o_orderkey, a.price AS code_a, b.price AS code_b FROM {OLD} a JOIN {NEW} b ON a.o_orderkey = b.o_orderkey WHERE a.price <> b.price",
    ),
    "r04_batch_metrics": (_with_rate, f"SELECT *, learning_rate < 5 AS converged FROM {RATES}"),
    "r05_convergence": (
        lambda s, d: runs.convergence(_with_rate(s, d), "batch", "learning_rate"),
        f"SELECT count(*) AS n, sum(learning_rate::DECIMAL(18,4))::DOUBLE / count(*) AS mean, min(learning_rate) AS least, (SELECT batch FROM {RATES} ORDER BY learning_rate, batch LIMIT 1) AS best, "
        f"(SELECT arg_max(learning_rate, batch) - arg_min(learning_rate, batch) FROM (SELECT * FROM {RATES} ORDER BY batch DESC LIMIT 5)) AS trend FROM {RATES}",
    ),
    "r06_cumulative": (
        lambda s, d: runs.cumulative(_batches(s, d), "batch", "n_rows", "n_rules"),
        f"SELECT *, (sum(n_rows) OVER (ORDER BY batch))::BIGINT AS total_n_rows, (sum(n_rules) OVER (ORDER BY batch))::BIGINT AS total_n_rules FROM {BATCHES}",
    ),
    "r07_runs_daily": (
        lambda s, d: runs.runs_daily(table(s, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long")), "ts", F.col("event_type") != "error", "k"),
        "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS runs, count(*) FILTER (WHERE event_type <> 'error') AS ok, round(avg(CAST(props->>'$.k' AS BIGINT)), 4) AS mean FROM events GROUP BY 1",
    ),
    "r08_run_delta": (
        lambda s, d: runs.run_delta(_chain(s, d), "batch", "previous", "n_rows", "n_rules"),
        f"WITH b AS (SELECT *, strftime((batch || '-01')::DATE - INTERVAL 2 MONTHS, '%Y-%m') AS previous FROM {BATCHES}) SELECT b.batch, b.previous, b.n_rows, b.n_rules, b.n_rows - p.n_rows AS n_rows_delta, b.n_rules - p.n_rules AS n_rules_delta FROM b LEFT JOIN b p ON p.batch = b.previous",
    ),
    "r09_phase_coverage": (
        lambda s, d: runs.phase_coverage(*_phases(s, d), ["segment", "name"]),
        f"SELECT a.field, a.pct AS pct_a, b.pct AS pct_b, round(b.pct - a.pct, 2) AS delta FROM ({FILLED.format(PHASE_A)}) a JOIN ({FILLED.format(PHASE_B)}) b ON a.field = b.field",
    ),
    "r09_phase_changes": (
        lambda s, d: runs.phase_changes(*_split_history(s, d), "o_orderkey", "price"),
        f"SELECT count(*) FILTER (WHERE b.price > a.price) AS improved, count(*) FILTER (WHERE b.price < a.price) AS worse, count(*) FILTER (WHERE b.price = a.price) AS same FROM {OLD} a JOIN {NEW} b ON a.o_orderkey = b.o_orderkey",
    ),
    "r10_compare_experiments": (
        lambda s, d: runs.compare_experiments(table(s, d, "lineitem").withColumn("x", F.col("l_orderkey") % 2), "x", "l_returnflag", "l_linenumber", "l_quantity", 0, 1, 0.01),
        "WITH m AS (SELECT l_returnflag, round(avg(l_linenumber) FILTER (WHERE l_orderkey % 2 = 0), 4) AS l_linenumber_a, round(avg(l_linenumber) FILTER (WHERE l_orderkey % 2 = 1), 4) AS l_linenumber_b, "
        "round(avg(l_quantity) FILTER (WHERE l_orderkey % 2 = 0), 4) AS l_quantity_a, round(avg(l_quantity) FILTER (WHERE l_orderkey % 2 = 1), 4) AS l_quantity_b FROM lineitem GROUP BY 1) "
        "SELECT *, round(l_linenumber_b - l_linenumber_a, 4) AS delta, round(l_quantity_a / l_quantity_b, 4) AS speedup, round(l_linenumber_b - l_linenumber_a, 4) >= -0.01 AS go FROM m",
    ),
}
