"""Queries of extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from vacantia.operators import extract
from vacantia.plans.normalize_queries import key_sql
from vacantia.sources.tables import table


def _adverts(s, d):
    """The documents, each with the lines of one of six adverts somewhere behind its text."""
    o = table(s, d, "documents")
    y, k = (F.col("n_chars") % 40).cast("string"), F.col("doc_id") % 6
    lines = (
        F.when(k == 0, F.concat(F.lit("We ask for "), y, F.lit(" years of proven experience. Age 25 to 40.")))
        .when(k == 1, F.concat(F.lit("Experience of "), y, F.lit("+ years, driving licence class B2, 30% travel")))
        .when(k == 2, F.concat(F.lit("Edad entre 20 y 35 años. Minimo "), y, F.lit(" años. Incorporación inmediata")))
        .when(k == 3, F.lit("Immediate start through agency Acme. Indexed pay"))
        .when(k == 4, F.concat(F.lit("Tasks:\n- do one thing wellDo another\n- do another thing; sell\n* and one thing of "), y, F.lit("\nRequirements: none\nBenefits: gym, home office\nBenefits: none")))
    )
    return o.select("doc_id", F.concat("text", F.lit("\n"), lines).alias("text"))


T = (
    "(SELECT doc_id, text || chr(10) || CASE doc_id % 6 WHEN 0 THEN 'We ask for ' || (n_chars % 40) || ' years of proven experience. Age 25 to 40.' "
    "WHEN 1 THEN 'Experience of ' || (n_chars % 40) || '+ years, driving licence class B2, 30% travel' WHEN 2 THEN 'Edad entre 20 y 35 años. Minimo ' || (n_chars % 40) || ' años. Incorporación inmediata' "
    "WHEN 3 THEN 'Immediate start through agency Acme. Indexed pay' WHEN 4 THEN 'Tasks:' || chr(10) || '- do one thing wellDo another' || chr(10) || '- do another thing; sell' || chr(10) || '* and one thing of ' || (n_chars % 40) || chr(10) || 'Requirements: none' || chr(10) || 'Benefits: gym, home office' || chr(10) || 'Benefits: none' END AS text FROM documents)"
)


def _captured(c: str, pattern: str) -> str:
    return f"TRY_CAST(nullif(regexp_extract({c}, '{pattern}', 1), '') AS INT)"


PLAIN = "strip_accents(lower(text))"
YEARS_SQL = "coalesce(" + ", ".join(_captured("masked", p) for p in extract.YEARS) + ")"
_KEY = "regexp_extract(line, '^\\s*([^:]{2,40}):', 1)"
LINES = (
    f"(SELECT doc_id, i, {key_sql(_KEY)} AS k, trim(regexp_extract(line, '^[^:]*:\\s*(.*)$', 1)) AS v FROM "
    f"(SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM {T}) WHERE regexp_matches(line, '^\\s*[^:]{{2,40}}:\\s*\\S'))"
)
TASKS = (
    "(SELECT doc_id, text, list_filter(list_transform(string_split_regex(regexp_replace(regexp_extract(text, '(?is)(?:tasks:)(.*?)(?:requirements:|\\z)', 1), '([a-zà-ÿ])([A-ZÀ-Þ])', '\\1' || chr(10) || '\\2', 'g'), '[\\n•;]+'), "
    f"lambda x: trim(regexp_replace(x, '^[\\s*.:-]+', ''))), lambda x: length(x) >= 5) AS parts FROM {T})"
)


def _words_sql(x: str) -> str:
    return f"list_distinct(string_split({key_sql(x)}, ' '))"


TAGS = {"health": ["gym", "medical"], "remote": ["home office", "remote"], "travel": ["travel", "viaj"]}
HEADERS = {"tasks": "(?i)tasks:", "requirements": "(?i)requirements:", "benefits": "(?i)benefits:", "about": "(?i)about us"}


def _vocabulary(s, d, n):
    words = table(s, d, "benchmark").select(extract.words_of("text").alias("w"))
    return words.select(F.explode(extract.ngrams(F.col("w"), n)).alias("ngram")).distinct()


def _missing(n, least):
    def run(s, d):
        return extract.missing_ngrams(table(s, d, "documents"), "text", _vocabulary(s, d, n), n, least, 100)

    parts = " || ' ' || ".join(["word", *[f"lead(word, {i}) OVER o" for i in range(1, n)]])
    words = lambda t, k: f"SELECT {k} AS k, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM (SELECT {k}, list_filter(string_split({key_sql('text')}, ' '), lambda x: x <> '') AS w FROM {t})"
    grams = lambda t, k: f"SELECT k, ngram FROM (SELECT k, {parts} AS ngram FROM ({words(t, k)}) WINDOW o AS (PARTITION BY k ORDER BY i)) WHERE ngram IS NOT NULL"
    sql = (
        f"WITH v AS (SELECT DISTINCT ngram FROM ({grams('benchmark', 'item_id')})), c AS (SELECT ngram, count(*) AS n, count(DISTINCT k) AS rows FROM ({grams('documents', 'doc_id')}) GROUP BY 1 HAVING count(*) >= {least}) "
        "SELECT ngram, n, rows, round(rows * 100.0::DOUBLE / (SELECT count(*) FROM documents), 2) AS rows_pct FROM c WHERE ngram NOT IN (SELECT ngram FROM v) ORDER BY n DESC, ngram LIMIT 100"
    )
    return run, sql


def _stop(s, d):
    return table(s, d, "nation").select(F.element_at(F.array(*map(F.lit, ("the", "de", "la", "der", "und", "que", "of"))), (F.col("n_nationkey") % 7 + 1)).alias("word")).distinct()


def _profiles(s, d):
    p = table(s, d, "part")
    return p.select("p_partkey", "p_name", F.when(F.col("p_size") > 30, F.col("p_size") % 5).alias("years"), F.when(F.col("p_type") == "PROMO", "degree").alias("education"), F.when(F.col("p_brand") == "Brand#1", "en").alias("language"))


LISTS = {"years": [(["ring"], 5), (["bolt", "gear"], 2)], "education": [(["widget"], "technical")], "language": [(["blue", "red"], "en")]}

QUERIES = {
    "x01_extract_experience": (
        lambda s, d: extract.extract_experience(_adverts(s, d), "text").drop("text"),
        f"SELECT doc_id, CASE WHEN years <= 30 THEN years END AS years FROM (SELECT doc_id, {YEARS_SQL} AS years FROM (SELECT doc_id, regexp_replace(text, '{extract.AGES}', ' ', 'g') AS masked FROM {T}))",
    ),
    "x02_extract_fields": (
        lambda s, d: extract.extract_fields(_adverts(s, d), "text").drop("text"),
        "SELECT doc_id, " + ", ".join(f"{_captured('text', p)} AS {c}" for c, (p, _) in extract.FIELDS.items()) + ", " + ", ".join("(" + " OR ".join(f"contains({PLAIN}, '{w}')" for w in ws) + f") AS {c}" for c, ws in extract.FLAGS.items())
        + f", upper(nullif(regexp_extract(text, '{extract.LICENCE}', 1), '')) AS licence, nullif(regexp_extract(text, '(?i)\\b(?:agency|consultora) ([A-Z][\\w&]+)', 1), '') AS agency FROM {T}",
    ),
    "x03_extract_headers": (
        lambda s, d: extract.extract_headers(_adverts(s, d), "text").select("doc_id", F.array_join(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|").alias("headers")),
        f"SELECT t.doc_id, CASE WHEN t.text IS NOT NULL THEN coalesce(h, '') END AS headers FROM {T} t LEFT JOIN (SELECT doc_id, string_agg(k || '=' || v, '|' ORDER BY i) AS h FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, k ORDER BY i) AS r FROM {LINES}) WHERE r = 1 GROUP BY 1) g ON g.doc_id = t.doc_id",
    ),
    "x04_tag": (
        lambda s, d: extract.tag(_adverts(s, d), "text", TAGS).drop("text"),
        "SELECT doc_id, array_to_string(list_filter([" + ", ".join("CASE WHEN " + " OR ".join(f"contains({PLAIN}, '{w}')" for w in ws) + f" THEN '{label}' END" for label, ws in sorted(TAGS.items())) + f"], lambda x: x IS NOT NULL), ',') AS tags FROM {T}",
    ),
    "x05_section_stats": (
        lambda s, d: extract.section_stats(_adverts(s, d), "text", HEADERS, 4).drop("text"),
        "SELECT *, sections * 100.0::DOUBLE / 4 AS coverage_pct FROM (SELECT *, has_tasks::BIGINT + has_requirements::BIGINT + has_benefits::BIGINT + has_about::BIGINT AS sections FROM (SELECT doc_id, "
        + ", ".join(f"regexp_matches(text, '{p}') AS has_{k}" for k, p in HEADERS.items())
        + f", CASE WHEN text IS NOT NULL THEN len(regexp_extract_all(text, '(?m)^[ \\t]*(?:[-*•]|\\d+[.)])[ \\t]')) END AS bullets FROM {T}))",
    ),
    "x06_extract_tasks": (
        lambda s, d: extract.extract_tasks(_adverts(s, d), "text", "tasks:", "requirements:").select("doc_id", F.array_join("tasks", "|").alias("tasks")),
        "SELECT doc_id, CASE WHEN text IS NULL THEN NULL WHEN len(parts) = 0 THEN '' ELSE array_to_string(list_reduce(list_transform(parts, lambda x: [x]), lambda a, x: CASE WHEN len(list_filter(a, lambda y: "
        f"len(list_intersect({_words_sql('x[1]')}, {_words_sql('y')})) > 0.6 * least(len({_words_sql('x[1]')}), len({_words_sql('y')})))) > 0 THEN a ELSE list_concat(a, x) END)[1:10], '|') END AS tasks FROM {TASKS}",
    ),
    "x07_missing_words": _missing(1, 5),
    "x07_missing_bigrams": _missing(2, 4),
    "x07_missing_trigrams": _missing(3, 3),
    "x08_word_freq": (
        lambda s, d: extract.word_freq(table(s, d, "documents"), "text", _stop(s, d)),
        f"SELECT word, count(*) AS n FROM (SELECT unnest(string_split({key_sql('text')}, ' ')) AS word FROM documents) WHERE word NOT IN ('', 'the', 'de', 'la', 'der', 'und', 'que', 'of') GROUP BY 1",
    ),
    "x08_words_per_row": (
        lambda s, d: extract.words_per_row(table(s, d, "documents"), "text"),
        f"SELECT count(*) AS n, round(avg(len(list_filter(string_split({key_sql('text')}, ' '), lambda x: x <> ''))), 4) AS mean_words FROM documents",
    ),
    "x09_infer_from_title": (
        lambda s, d: extract.infer_from_title(_profiles(s, d), "p_name", LISTS, {"education": "secondary"}, ["years", "education", "language"]),
        "WITH p AS (SELECT p_partkey, p_name, CASE WHEN p_size > 30 THEN p_size % 5 WHEN p_name LIKE '% ring' THEN 5 WHEN p_name LIKE '% bolt' OR p_name LIKE '% gear' THEN 2 END AS years, CASE WHEN p_type = 'PROMO' THEN 'degree' WHEN p_name LIKE '% widget' THEN 'technical' ELSE 'secondary' END AS education, "
        "CASE WHEN p_brand = 'Brand#1' OR p_name LIKE 'blue %' OR p_name LIKE 'red %' THEN 'en' END AS language FROM part) SELECT *, ((years IS NOT NULL)::INT + 1 + (language IS NOT NULL)::INT)::BIGINT AS score FROM p",
    ),
}
