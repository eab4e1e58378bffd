"""Extraction from text columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.functions.columns import half_up, percent
from vacantia.functions.text import any_part, any_word, first_match, fold, norm_key, unique_in_order


def _number(c: Column, pattern: str, group: int = 1) -> Column:
    """A captured number; null without a match."""
    return F.regexp_extract(c, pattern, group).try_cast("int")


#: Spans in which a number of years is an age.
AGES = r"(?i)\b(?:age|aged|edad|entre)\b[^.\n]{0,15}?\d{1,2}[^.\n]{0,10}?(?:years|años|anos)"
YEARS = (r"(?i)(\d{1,2})\+? *(?:years|años|anos)[^.\n]{0,20}experienc", r"(?i)experienc[^.\n]{0,25}?(\d{1,2})\+? *(?:years|años|anos)", r"(?i)(?:at least|minimum|minimo|al menos) +(\d{1,2}) *(?:years|años|anos)")


def extract_experience(df: DataFrame, col: str, most: int = 30) -> DataFrame:
    """Years of experience by the first pattern that fits, outside spans that state an age."""
    masked = F.regexp_replace(F.col(col), AGES, " ")
    years = F.coalesce(*[_number(masked, p) for p in YEARS])
    return df.withColumn("years", F.when(years <= most, years))


FIELDS: Mapping[str, tuple[str, int]] = {
    "age_min": (r"(?i)\b(?:age|edad)\D{0,12}(\d{2}) *(?:-|to|a|y) *\d{2}", 1),
    "age_max": (r"(?i)\b(?:age|edad)\D{0,12}\d{2} *(?:-|to|a|y) *(\d{2})", 1),
    "travel_pct": (r"(?i)(\d{1,3}) *% *(?:travel|viaj)", 1),
}
LICENCE = r"(?i)\b(?:driving licen[cs]e|licencia|registro)[^.\n]{0,20}?\b([A-E]\d?)\b"
FLAGS: Mapping[str, tuple[str, ...]] = {"start_now": ("immediate start", "start immediately", "incorporacion inmediata"), "indexed_pay": ("indexed", "paritarias", "cost of living")}


def extract_fields(df: DataFrame, col: str, agency: str = r"(?i)\b(?:agency|consultora) ([A-Z][\w&]+)") -> DataFrame:
    """Age range, licence class, travel, start and pay flags, agency name."""
    c = F.col(col)
    out = df.withColumns({k: _number(c, p, g) for k, (p, g) in FIELDS.items()})
    text = F.lower(fold(c))
    out = out.withColumns({k: any_part(text, words) for k, words in FLAGS.items()})
    empty_to_null = lambda x: F.when(x != "", x)
    return out.withColumn("licence", F.upper(empty_to_null(F.regexp_extract(c, LICENCE, 1)))).withColumn("agency", empty_to_null(F.regexp_extract(c, agency, 1)))


def extract_headers(df: DataFrame, col: str, out: str = "headers") -> DataFrame:
    """'Key: value' lines as a map; the first value of a key counts."""
    lines = F.filter(F.split(F.col(col), "\n"), lambda x: x.rlike(r"^\s*[^:]{2,40}:\s*\S"))
    pairs = F.transform(lines, lambda x: F.struct(norm_key(F.regexp_extract(x, r"^\s*([^:]{2,40}):", 1)).alias("k"), F.trim(F.regexp_extract(x, r"^[^:]*:\s*(.*)$", 1)).alias("v")))
    keys = unique_in_order(F.transform(pairs, lambda x: x["k"]))
    first = lambda k: F.element_at(F.filter(pairs, lambda p: p["k"] == k), 1)["v"]
    return df.withColumn(out, F.map_from_arrays(keys, F.transform(keys, first)))


def tag(df: DataFrame, col: str, labels: Mapping[str, Sequence[str]], out: str = "tags") -> DataFrame:
    """Labels with a keyword in the text, sorted and comma-joined."""
    text = F.lower(fold(F.col(col)))
    found = [F.when(any_part(text, words), F.lit(label)) for label, words in sorted(labels.items())]
    return df.withColumn(out, F.array_join(F.array_compact(F.array(*found)), ","))


def section_stats(df: DataFrame, col: str, headers: Mapping[str, str], expected: int) -> DataFrame:
    """Sections found, bullets in the text, and found sections in percent of those expected."""
    c = F.col(col)
    found = reduce(Column.__add__, [c.rlike(p).cast("long") for p in headers.values()])
    out = df.withColumns({f"has_{k}": c.rlike(p) for k, p in headers.items()})
    bullets = F.regexp_count(c, F.lit(r"(?m)^[ \t]*(?:[-*•]|\d+[.)])[ \t]")).cast("long")
    return out.withColumn("sections", found).withColumn("bullets", bullets).withColumn("coverage_pct", percent(found, F.lit(expected)))


def extract_tasks(df: DataFrame, col: str, start: str, stop: str, overlap: float = 0.6, most: int = 10) -> DataFrame:
    """Tasks between two markers: split at bullets, line ends and case joins; a task of which more
    than a part of the words is in an earlier one is dropped."""
    block = F.regexp_extract(F.col(col), rf"(?is)(?:{start})(.*?)(?:{stop}|\z)", 1)
    parts = F.filter(F.transform(F.split(block, r"[\n•;]+|(?<=[a-zà-ÿ])(?=[A-ZÀ-Þ])"), lambda x: F.trim(F.regexp_replace(x, r"^[\s\-*.:]+", ""))), lambda x: F.length(x) >= 5)
    words = lambda x: F.array_distinct(F.split(norm_key(x), " "))
    like = lambda a, b: F.size(F.array_intersect(words(a), words(b))) > overlap * F.least(F.size(words(a)), F.size(words(b)))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when(F.exists(acc, lambda y: like(x, y)), acc).otherwise(F.concat(acc, F.array(x))))
    return df.withColumn("tasks", F.slice(kept, 1, most))


def words_of(col: str) -> Column:
    """Words of a text's search key."""
    return F.filter(F.split(norm_key(F.col(col)), " "), lambda w: w != "")


def ngrams(words: Column, n: int) -> Column:
    """Space-joined runs of n words. ``words`` should be a stored column: it's read for each run."""
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))


def missing_ngrams(df: DataFrame, col: str, vocabulary: DataFrame, n: int, least: int, top: int) -> DataFrame:
    """Frequent n-grams that the vocabulary lacks: occurrences, and share of rows that have them. The
    first occurrence in each row is marked inside the row, so only counts of n-grams are shuffled."""
    grams = df.select(words_of(col).alias("__w")).select(F.sort_array(ngrams(F.col("__w"), n)).alias("__g"))
    marked = F.transform("__g", lambda g, i: F.struct(g.alias("ngram"), ((i == 0) | (F.get("__g", i - 1) != g)).alias("first")))
    grams = grams.select(F.explode(marked).alias("x")).select("x.ngram", "x.first")
    counts = grams.groupBy("ngram").agg(F.count("*").alias("n"), F.count_if("first").alias("rows")).where(F.col("n") >= least)
    counts = counts.join(vocabulary.select("ngram"), "ngram", "left_anti").orderBy(F.desc("n"), "ngram").limit(top)
    return counts.crossJoin(df.agg(F.count("*").alias("all"))).withColumn("rows_pct", percent(F.col("rows"), F.col("all"))).drop("all")


def word_freq(df: DataFrame, col: str, stop: DataFrame) -> DataFrame:
    """Frequencies of the words that are no stop words."""
    words = df.select(F.explode(words_of(col)).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).join(stop.select("word"), "word", "left_anti")


def words_per_row(df: DataFrame, col: str) -> DataFrame:
    """Rows and mean words per row."""
    n = F.size(words_of(col))
    return df.agg(F.count("*").alias("n"), half_up(F.avg(n), 4).alias("mean_words"))


def infer_from_title(df: DataFrame, title: str, lists: Mapping[str, Sequence[tuple[Sequence[str], object]]], defaults: Mapping[str, object], scored: Sequence[str]) -> DataFrame:
    """Missing fields by word lists of the title, defaults last; ``score`` counts filled fields."""
    text = norm_key(F.col(title))
    fields = {f: F.coalesce(F.col(f), first_match([(any_word(text, w), F.lit(v)) for w, v in rules]), F.lit(defaults.get(f))) for f, rules in lists.items()}
    out = df.withColumns(fields)
    return out.withColumn("score", reduce(Column.__add__, [F.col(c).isNotNull().cast("long") for c in scored]))
