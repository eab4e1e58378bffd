"""Queries of normalization."""

from __future__ import annotations

from pyspark.sql import functions as F

from vacantia.functions.text import norm_key
from vacantia.operators import normalize
from vacantia.sources.tables import table

AS_OF = "2001-08-15"
MODES = [("urgent", ["urgent", "high"]), ("usual", ["medium"]), ("slow", ["low"])]


def key_sql(c: str) -> str:
    """A search key by decomposition, apart from how the library folds."""
    return f"trim(regexp_replace(strip_accents(lower({c})), '[^\\pL\\pN_]+', ' ', 'g'))"


CLEAN_SQL = (
    "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate(translate(text, chr(8203) || chr(8204) || chr(8205) || chr(65279) || chr(173), ''), "
    "'“”„‘’‚–—−•●▪·…' || chr(160), '\"\"\"''''''---****. '), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g'), '(https?://|www\\.)[^ \\t\\r\\n]+', ' ', 'g'), "
    "'[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g'))"
)


def _raw_dates(s, d):
    k = F.col("o_orderkey") % 4
    c = F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 1, F.date_format("o_orderdate", "dd/MM/yyyy")).when(k == 2, F.date_format("o_orderdate", "yyyyMMdd")).otherwise("soon")
    return table(s, d, "orders").select("o_orderkey", c.alias("raw")).withColumn("day", normalize.parse_date(F.col("raw"), ["yyyy-MM-dd", "dd/MM/yyyy", "yyyyMMdd"]))


RAW_DATE = "CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 2 THEN strftime(o_orderdate, '%Y%m%d') ELSE 'soon' END"


def _places(s, d):
    n = table(s, d, "nation")
    return n.select(F.explode(F.array("n_name", F.concat(F.lit("the "), "n_name"))).alias("variant"), "n_name")


def _addresses(s, d):
    n = table(s, d, "customer").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey") % 3
    return n.select("c_custkey", F.concat_ws(", ", "c_mktsegment", F.when(k == 0, F.col("n_name")).when(k == 1, F.lower("n_name")).otherwise(F.concat("n_name", F.lit("X")))).alias("address"))


ADDRESS = "(SELECT c_custkey, c_mktsegment || ', ' || CASE c_custkey % 3 WHEN 0 THEN n_name WHEN 1 THEN lower(n_name) ELSE n_name || 'X' END AS address, CASE c_custkey % 3 WHEN 2 THEN n_name || 'X' ELSE n_name END AS p, c_mktsegment AS city FROM customer JOIN nation ON c_nationkey = n_nationkey)"


def _types(s, d):
    c = table(s, d, "customer")
    df = c.select("c_custkey", F.when(F.col("c_custkey") % 5 == 0, "True").otherwise(F.col("c_name")).alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_nationkey").alias("low"), (F.lit(12) - F.col("c_nationkey")).alias("high"))
    return normalize.validate_types(df, ["name"], {"balance": (0, 9000)}, [("low", "high")])


def _categories(s, d):
    df = table(s, d, "part").select("p_partkey", F.concat(F.lit(" "), F.lower("p_type")).alias("kind"), "p_name")
    return normalize.validate_categories(df, "kind", ["promo", "economy", "large"], "p_name", {"promo": "ring|gear"})


def _values(s, d):
    mapping = table(s, d, "nation").where("n_nationkey < 20").select("n_name", F.concat(F.lit("Country "), "n_nationkey").alias("to"))
    df = table(s, d, "supplier").join(table(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.when(F.col("s_suppkey") % 6 > 0, F.concat(F.lit("State of "), "n_name", F.lit(" (HQ)"))).alias("place"))
    return normalize.normalize_values(df, "place", mapping, "n_name", "to", ["^State of ", r" \(HQ\)$"], "unknown")


def _lists(s, d):
    o = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.concat_ws(",", F.array_sort(F.collect_list(F.concat("l_returnflag", "l_linestatus")))).alias("flags"))
    return o.select("l_orderkey", normalize.clean_list(F.concat("flags", F.lit(", - x, *Ring,ring ,a"))).alias("cleaned"), normalize.merge_lists(F.col("flags"), F.lit("af, zz,,ZZ")).alias("merged"))


def _inferred(s, d):
    df = table(s, d, "part").select("p_partkey", "p_name", "p_size")
    return normalize.infer_field(df, "level", F.lower("p_name"), [(["ring", "bolt"], "junior"), (["gear"], "senior")], F.col("p_size"), [(10, "small"), (30, "medium")], "large")


def _levels(s, d):
    df = table(s, d, "part").select("p_partkey", F.when(F.col("p_type") == "PROMO", "senior").when(F.col("p_type") == "SMALL", "junior").when(F.col("p_type") == "LARGE", "semisenior").alias("level"), (F.col("p_size") % 8).alias("years"), F.when(F.col("p_size") > 40, "Sin experiencia").otherwise(F.col("p_name")).alias("text"))
    return normalize.correct_level(df, "level", "years", "text")


def _catalogue(s, d):
    return table(s, d, "supplier").select(F.col("s_name").alias("company"), F.concat(F.lit("sector "), F.col("s_nationkey") % 4).alias("sector"), (F.col("s_suppkey") % 5 == 0).alias("intermediary"))


def _sectors(s, d):
    df = table(s, d, "lineitem").select("l_orderkey", F.when(F.col("l_partkey") % 3 == 0, F.concat(F.lit("SUPPLIER#"), F.lpad(F.col("l_suppkey").cast("string"), 9, "0"))).alias("company"), F.when(F.col("l_partkey") % 2 == 0, "A firm in the business of steel mills").when(F.col("l_partkey") % 7 == 0, "steel, no marker").alias("text"), F.when(F.col("l_partkey") % 5 < 3, "given").alias("sector"))
    return normalize.assign_sector(df, "company", "text", "sector", _catalogue(s, d), ["business of"], [("steel", "metal"), ("mill", "paper")])


def _activity(s, d):
    words = table(s, d, "part").select(F.col("p_name").alias("keyword"), F.concat(F.lit("C"), F.length("p_name")).alias("code"), F.lit("sector x").alias("sector")).distinct()
    df = table(s, d, "part").select("p_partkey", F.concat_ws(" and ", "p_name", F.when(F.col("p_size") > 25, "red ring")).alias("text"), F.lit("none").alias("sector"))
    return normalize.classify_activity(df, "p_partkey", "text", "sector", words)


def _terms(s, d):
    words = F.split("p_name", " ")
    return table(s, d, "part").select(words[1].alias("term"), F.concat(F.lit("my "), words[1]).alias("common")).where("term IN ('ring', 'bolt')").distinct()


def _fixes(s, d):
    return table(s, d, "nation").where("n_regionkey = 2").select(F.col("n_name").alias("raw"), F.concat(F.lit("fixed "), "n_name").alias("fixed"))


def _corrected(s, d):
    df = table(s, d, "customer").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    return normalize.apply_corrections(df, "n_name", _fixes(s, d))


TITLES = [r"(?i)^[a-z]+, ", r"(?i)\bref[.: ]*\d+", r"(?i)\s*[-(]\s*(remote|hybrid)\s*\)?\s*$", r"(?i)\bzone \w+$"]


def _titles(s, d):
    df = table(s, d, "part").select("p_partkey", F.concat(F.lit("Rosario, "), "p_name", F.lit(" ref: "), "p_partkey", F.lit(" zone north (remote) - hybrid")).alias("raw"))
    return normalize.clean_title(df, "raw", TITLES)


CUSTOMER_NATION = "customer JOIN nation ON c_nationkey = n_nationkey"
QUERIES = {
    "n01_strip_html": (lambda s, d: normalize.strip_html(table(s, d, "pages").select("page_id", "html"), "html").drop("html"), None),
    "n02_clean_text": (lambda s, d: normalize.clean_text(table(s, d, "documents").select("doc_id", "text"), "text").drop("text"), f"SELECT doc_id, {CLEAN_SQL} AS clean FROM documents"),
    "n03_norm_key": (lambda s, d: table(s, d, "documents").select("doc_id", norm_key(F.col("text")).alias("key")), f"SELECT doc_id, {key_sql('text')} AS key FROM documents"),
    "n04_map_category": (
        lambda s, d: normalize.map_category(table(s, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", MODES, "mode"),
        "SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'urgent' WHEN o_orderpriority = '3-MEDIUM' THEN 'usual' WHEN o_orderpriority LIKE '%LOW%' THEN 'slow' ELSE 'other' END AS mode FROM orders",
    ),
    "n05_parse_date": (_raw_dates, f"SELECT o_orderkey, {RAW_DATE} AS raw, CASE WHEN o_orderkey % 4 < 3 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders"),
    "n06_match_location": (
        lambda s, d: normalize.match_location(_addresses(s, d), "address", _places(s, d), "variant", "n_name"),
        f"WITH v AS (SELECT {key_sql('x')} AS v, n_name FROM (SELECT unnest([n_name, 'the ' || n_name]) AS x, n_name FROM nation)), a AS (SELECT c_custkey, address, city, {key_sql('p')} AS p FROM {ADDRESS}), "
        "m AS (SELECT a.*, (SELECT any_value(n_name) FROM v WHERE v.v = a.p) AS e FROM a), q AS (SELECT DISTINCT p FROM m WHERE e IS NULL), "
        "n AS (SELECT p, arg_max(n_name, {'s': 1.0 - levenshtein(p, v) / greatest(length(p), length(v))::DOUBLE, 'v': v}) AS near FROM q JOIN v ON 1.0 - levenshtein(p, v) / greatest(length(p), length(v))::DOUBLE >= 0.85 GROUP BY 1) "
        "SELECT c_custkey, address, city, coalesce(e, near) AS province, CASE WHEN e IS NOT NULL THEN 'exact' WHEN near IS NOT NULL THEN 'similar' END AS method FROM m LEFT JOIN n USING (p)",
    ),
    "n07_clean_title": (_titles, None),
    "n08_date_window": (
        lambda s, d: normalize.date_window(table(s, d, "orders"), "o_orderdate", 90, AS_OF).select("o_orderkey"),
        f"SELECT o_orderkey FROM orders WHERE o_orderdate::DATE BETWEEN DATE '{AS_OF}' - 90 AND DATE '{AS_OF}'",
    ),
    "n08_date_window_counts": (
        lambda s, d: normalize.date_window_counts(_raw_dates(s, d), "day", 900, AS_OF),
        f"SELECT count(*) FILTER (WHERE o_orderkey % 4 < 3 AND o_orderdate::DATE BETWEEN DATE '{AS_OF}' - 900 AND DATE '{AS_OF}') AS kept, count(*) FILTER (WHERE o_orderkey % 4 < 3 AND o_orderdate::DATE < DATE '{AS_OF}' - 900) AS old, count(*) FILTER (WHERE o_orderkey % 4 = 3) AS no_date FROM orders",
    ),
    "n09_date_stats": (
        lambda s, d: normalize.date_stats(_raw_dates(s, d), "day"),
        "SELECT count(*) AS n, count(*) FILTER (WHERE o_orderkey % 4 = 3) AS nulls, strftime(min(o_orderdate) FILTER (WHERE o_orderkey % 4 < 3), '%Y-%m-%d') AS first, strftime(max(o_orderdate) FILTER (WHERE o_orderkey % 4 < 3), '%Y-%m-%d') AS last, "
        "date_diff('day', (min(o_orderdate) FILTER (WHERE o_orderkey % 4 < 3))::DATE, (max(o_orderdate) FILTER (WHERE o_orderkey % 4 < 3))::DATE) AS span FROM orders",
    ),
    "n10_apply_filters": (
        lambda s, d: normalize.apply_filters(table(s, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment", "c_acctbal"), {"c_mktsegment": "BUILDING"}, {"c_nationkey": [1, 2, 3, 4, 5, 6]}, {"c_acctbal": (0.0, 5000.0)}, {"c_name": "#0000001"}),
        "SELECT c_custkey, c_name, c_nationkey, c_mktsegment, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey IN (1, 2, 3, 4, 5, 6) AND c_acctbal BETWEEN 0 AND 5000 AND c_name ILIKE '%#0000001%'",
    ),
    "n11_validate_types": (
        _types,
        "SELECT c_custkey, CASE WHEN c_custkey % 5 > 0 THEN c_name END AS name, CASE WHEN c_acctbal BETWEEN 0 AND 9000 THEN c_acctbal END AS balance, least(c_nationkey, 12 - c_nationkey) AS low, greatest(c_nationkey, 12 - c_nationkey) AS high FROM customer",
    ),
    "n12_validate_categories": (
        _categories,
        "SELECT p_partkey, CASE WHEN p_type IN ('PROMO', 'ECONOMY', 'LARGE') AND NOT (p_type = 'PROMO' AND regexp_matches(lower(p_name), 'ring|gear')) THEN lower(p_type) END AS kind, p_name FROM part",
    ),
    "n13_normalize_values": (
        _values,
        "SELECT s_suppkey, CASE WHEN s_suppkey % 6 = 0 THEN 'unknown' WHEN s_nationkey < 20 THEN 'Country ' || s_nationkey ELSE n_name END AS place FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    ),
    "n14_clean_list": (
        _lists,
        "WITH o AS (SELECT l_orderkey, list_sort(list(l_returnflag || l_linestatus)) AS f FROM lineitem GROUP BY 1) "
        "SELECT l_orderkey, array_to_string(list_concat(list_distinct_ordered, ['Ring']), ', ') AS cleaned, array_to_string(list_concat(list_distinct_ordered, CASE WHEN list_contains(list_distinct_ordered, 'AF') THEN ['zz'] ELSE ['af', 'zz'] END), ', ') AS merged "
        "FROM (SELECT l_orderkey, list_filter(f, lambda x, i: list_position(f, x) = i) AS list_distinct_ordered FROM o)",
    ),
    "n15_infer_field": (
        _inferred,
        "SELECT p_partkey, p_name, p_size, CASE WHEN regexp_matches(p_name, '\\b(ring|bolt)\\b') THEN 'junior' WHEN regexp_matches(p_name, '\\bgear\\b') THEN 'senior' WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS level FROM part",
    ),
    "n16_correct_level": (
        _levels,
        "WITH p AS (SELECT p_partkey, CASE p_type WHEN 'PROMO' THEN 'senior' WHEN 'SMALL' THEN 'junior' WHEN 'LARGE' THEN 'semisenior' END AS level, p_size % 8 AS years, CASE WHEN p_size > 40 THEN 'Sin experiencia' ELSE p_name END AS text FROM part), "
        "f AS (SELECT *, CASE WHEN text = 'Sin experiencia' AND level IN ('senior', 'semisenior') THEN 'junior' WHEN years < 2 AND level = 'senior' THEN 'junior' WHEN years >= 5 AND level IN ('junior', 'trainee') THEN 'senior' ELSE level END AS level_fixed FROM p) SELECT *, level IS DISTINCT FROM level_fixed AS level_changed FROM f",
    ),
    "n17_assign_sector": (
        _sectors,
        "WITH l AS (SELECT l_orderkey, CASE WHEN l_partkey % 3 = 0 THEN 'SUPPLIER#' || lpad(l_suppkey::VARCHAR, 9, '0') END AS company, CASE WHEN l_partkey % 2 = 0 THEN 'A firm in the business of steel mills' WHEN l_partkey % 7 = 0 THEN 'steel, no marker' END AS text, "
        "CASE WHEN l_partkey % 5 < 3 THEN 'given' END AS sector, l_suppkey, l_partkey FROM lineitem), j AS (SELECT l.*, CASE WHEN l_partkey % 3 = 0 AND s_suppkey % 5 > 0 THEN 'sector ' || (s_nationkey % 4) END AS k, CASE WHEN l_partkey % 2 = 0 THEN 'metal' END AS m FROM l LEFT JOIN supplier ON s_suppkey = l_suppkey) "
        "SELECT l_orderkey, company, text, sector, coalesce(k, m, sector) AS assigned, CASE WHEN k IS NOT NULL OR m IS NOT NULL THEN 'high' WHEN sector IS NOT NULL THEN 'medium' ELSE 'none' END AS confidence FROM j",
    ),
    "n18_classify_activity": (
        _activity,
        "WITH k AS (SELECT DISTINCT p_name AS keyword, 'C' || length(p_name) AS code FROM part), t AS (SELECT p_partkey, p_name || CASE WHEN p_size > 25 THEN ' and red ring' ELSE '' END AS text, 'none' AS sector FROM part), "
        "h AS (SELECT p_partkey, code, sum(length(keyword)) AS w FROM t JOIN k ON contains(text, keyword) GROUP BY 1, 2) SELECT t.*, (SELECT code FROM h WHERE h.p_partkey = t.p_partkey ORDER BY w DESC, code LIMIT 1) AS code FROM t",
    ),
    "n19_apply_dictionary": (
        lambda s, d: normalize.apply_dictionary(table(s, d, "part").select("p_partkey", "p_name"), "p_partkey", "p_name", _terms(s, d)),
        "SELECT p_partkey, p_name, CASE WHEN p_name LIKE '% ring' THEN 'ring' WHEN p_name LIKE '% bolt' THEN 'bolt' END AS term, CASE WHEN p_name LIKE '% ring' THEN replace(p_name, ' ring', ' my ring') WHEN p_name LIKE '% bolt' THEN replace(p_name, ' bolt', ' my bolt') ELSE p_name END AS rewritten FROM part",
    ),
    "n20_level_penalty": (
        lambda s, d: table(s, d, "part").select("p_partkey", normalize.level_rank(F.col("p_name"), (("ring", 5), ("bolt", 2), ("red", 1))).cast("long").alias("a"), normalize.level_rank(F.col("p_type"), (("promo", 4), ("small", 1))).cast("long").alias("b")).withColumn("penalty", normalize.level_penalty(F.col("a"), F.col("b"))),
        "WITH r AS (SELECT p_partkey, CASE WHEN p_name LIKE '%ring' THEN 5 WHEN p_name LIKE '%bolt' THEN 2 WHEN p_name LIKE 'red%' THEN 1 END::BIGINT AS a, CASE p_type WHEN 'PROMO' THEN 4 WHEN 'SMALL' THEN 1 END::BIGINT AS b FROM part) SELECT *, CASE WHEN a IS NULL OR b IS NULL OR abs(a - b) <= 1 THEN 0.0 WHEN abs(a - b) = 2 THEN 0.1 ELSE 0.25 END::DOUBLE AS penalty FROM r",
    ),
    "n21_apply_corrections": (_corrected, f"SELECT c_custkey, CASE WHEN n_regionkey = 2 THEN 'fixed ' || n_name ELSE n_name END AS n_name, n_regionkey = 2 AS changed FROM {CUSTOMER_NATION}"),
    "n21_correction_counts": (
        lambda s, d: normalize.correction_counts(_corrected(s, d)),
        f"SELECT count(*) AS n, count(*) FILTER (WHERE n_regionkey = 2) AS changed, round(count(*) FILTER (WHERE n_regionkey = 2) * 100.0::DOUBLE / count(*), 2) AS changed_pct FROM {CUSTOMER_NATION}",
    ),
}
