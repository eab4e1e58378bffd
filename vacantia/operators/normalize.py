"""Projections, filters, text and date normalization of postings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacantia.functions.columns import percent
from vacantia.functions.text import FANCY, SIMPLE, ZERO_WIDTH, any_part, any_word, first_match, norm_key, similarity, spaced, unique_in_order
from vacantia.operators.terms import bounded, containing, like_texts

def strip_html(df: DataFrame, col: str, out: str = "text") -> DataFrame:
    """Visible text of an HTML column: comments, scripts, styles and tags go, block ends become line
    breaks, the common entities are resolved."""
    c = F.regexp_replace(F.col(col), r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", " ")
    c = F.regexp_replace(c, r"(?i)<br\s*/?>|</(?:p|div|li|h[1-6]|tr)\s*>", "\n")
    c = F.regexp_replace(c, r"(?s)<[^>]*>", " ")
    for entity, char in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("apos", "'"), ("copy", "©"), ("middot", "·"), ("amp", "&")):
        c = F.replace(c, F.lit(f"&{entity};"), F.lit(char))
    lines = F.filter(F.transform(F.split(c, "\n"), lambda x: spaced(x)), lambda x: x != "")
    return df.withColumn(out, F.array_join(lines, "\n"))


def clean_text(df: DataFrame, col: str, out: str = "clean") -> DataFrame:
    """Plain quotes, dashes and bullets, no control or zero-width characters, URLs or e-mails."""
    c = F.translate(F.translate(F.col(col), ZERO_WIDTH, ""), FANCY, SIMPLE)
    c = F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    c = F.regexp_replace(c, r"(https?://|www\.)[^ \t\r\n]+", " ")
    c = F.regexp_replace(c, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", " ")
    return df.withColumn(out, spaced(c))


def add_key(df: DataFrame, col: str, out: str = "key") -> DataFrame:
    """``df`` with a search key of a column."""
    return df.withColumn(out, norm_key(F.col(col)))


def map_category(df: DataFrame, col: str, rules: Sequence[tuple[str, Sequence[str]]], out: str, other: str = "other") -> DataFrame:
    """Category of the first rule with a keyword in the text; null stays null, no hit is ``other``."""
    key = norm_key(F.col(col))
    return df.withColumn(out, F.when(F.col(col).isNotNull(), first_match([(any_part(key, words), c) for c, words in rules], other)))


def parse_date(c: Column, formats: Sequence[str]) -> Column:
    """ISO day of the first format that fits; null if none does."""
    return F.date_format(F.coalesce(*[F.try_to_timestamp(F.trim(c), F.lit(f)) for f in formats]), "yyyy-MM-dd")


def match_location(df: DataFrame, col: str, places: DataFrame, variant: str, name: str, least: float = 0.85) -> DataFrame:
    """City and province of 'City, Province': the province whose variant equals it, else the most
    similar one. Only distinct provinces without an exact variant are compared, and only with the
    variants that share a segment as every pair so alike does."""
    parts = F.split(F.col(col), ",")
    rows = df.withColumn("city", F.trim(parts[0])).withColumn("__p", norm_key(F.element_at(parts, -1)))
    known = places.select(norm_key(F.col(variant)).alias("__p"), F.col(name).alias("province")).dropDuplicates(["__p"])
    exact = rows.join(bounded(known), "__p", "left")
    missed = exact.where("province IS NULL AND __p <> ''").select("__p").distinct()
    names = known.select(F.col("__p").alias("__n"), F.col("province").alias("name"))
    alike = similarity(F.col("__t"), F.col("__n"))
    near = like_texts(missed.withColumnRenamed("__p", "__t"), names, least).where(alike >= least)
    near = near.groupBy(F.col("__t").alias("__p")).agg(F.max_by("name", F.struct(alike, F.col("__n"))).alias("near"))
    out = exact.join(near, "__p", "left").withColumn("method", F.when(F.col("province").isNotNull(), "exact").when(F.col("near").isNotNull(), "similar"))
    return out.withColumn("province", F.coalesce("province", "near")).drop("__p", "near")


def clean_title(df: DataFrame, col: str, patterns: Sequence[str], out: str = "title", rounds: int = 5) -> DataFrame:
    """A title without the parts that patterns match, taken off again until nothing changes."""
    c = F.col(col)
    for _ in range(rounds):
        for p in patterns:
            c = F.regexp_replace(c, p, " ")
        c = spaced(c)
    return df.withColumn(out, c)


def date_window(df: DataFrame, col: str, days: int, as_of: str) -> DataFrame:
    """Rows of the last days; rows without a day go."""
    return df.where((F.to_date(col) >= F.date_sub(F.to_date(F.lit(as_of)), days)) & (F.to_date(col) <= F.to_date(F.lit(as_of))))


def date_window_counts(df: DataFrame, col: str, days: int, as_of: str) -> DataFrame:
    """Rows that ``date_window`` keeps, and those it drops for being old or without a day."""
    d, first = F.to_date(col), F.date_sub(F.to_date(F.lit(as_of)), days)
    return df.agg(F.count_if((d >= first) & (d <= F.to_date(F.lit(as_of)))).alias("kept"), F.count_if(d < first).alias("old"), F.count_if(d.isNull()).alias("no_date"))


def date_stats(df: DataFrame, col: str) -> DataFrame:
    """Rows, nulls, first and last day, and the days between them."""
    d = F.to_date(col)
    return df.agg(F.count("*").alias("n"), F.count_if(d.isNull()).alias("nulls"), F.date_format(F.min(d), "yyyy-MM-dd").alias("first"), F.date_format(F.max(d), "yyyy-MM-dd").alias("last"), F.datediff(F.max(d), F.min(d)).cast("long").alias("span"))


def apply_filters(df: DataFrame, equal: Mapping[str, object] | None = None, isin: Mapping[str, Sequence] | None = None, between: Mapping[str, tuple] | None = None, contains: Mapping[str, str] | None = None) -> DataFrame:
    """Rows for which all given conditions hold; empty ones are left out, so they push down as they are."""
    for c, v in (equal or {}).items():
        df = df.where(F.col(c) == v) if v is not None else df
    for c, v in (isin or {}).items():
        df = df.where(F.col(c).isin(list(v))) if v else df
    for c, (a, b) in (between or {}).items():
        df = df.where(F.col(c).between(a, b))
    for c, v in (contains or {}).items():
        df = df.where(F.lower(F.col(c)).contains(v.lower())) if v else df
    return df


BOOLEAN_WORDS = ("true", "false", "yes", "no", "si", "1", "0")


def validate_types(df: DataFrame, texts: Sequence[str], ranges: Mapping[str, tuple[float, float]], pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Nulls for texts that look like booleans and numbers out of range; inverted pairs swapped."""
    df = df.withColumns({c: F.when(~F.lower(F.trim(c)).isin(*BOOLEAN_WORDS), F.col(c)) for c in texts})
    df = df.withColumns({c: F.when(F.col(c).between(a, b), F.col(c)) for c, (a, b) in ranges.items()})
    for low, high in pairs:
        a, b = F.col(low), F.col(high)
        swap = a > b
        df = df.withColumns({low: F.when(swap, b).otherwise(a), high: F.when(swap, a).otherwise(b)})
    return df


def validate_categories(df: DataFrame, col: str, allowed: Sequence[str], title: str, exclude: Mapping[str, str]) -> DataFrame:
    """Null for values that are not allowed, or that the title rules out by a pattern."""
    c = F.lower(F.trim(F.col(col)))
    ok = c.isin(list(allowed))
    for value, pattern in exclude.items():
        ok = ok & ~((c == value) & F.coalesce(F.lower(title).rlike(pattern), F.lit(False)))
    return df.withColumn(col, F.when(ok, c))


def bool_flag(c: Column) -> Column:
    """1 or 0 of boolean-like text, else null."""
    t = F.lower(F.trim(c.cast("string")))
    return F.when(t.isin("1", "true", "yes", "si"), 1).when(t.isin("0", "false", "no"), 0)


def normalize_values(df: DataFrame, col: str, mapping: DataFrame, key: str, value: str, affixes: Sequence[str] = (), default: str | None = None) -> DataFrame:
    """Values without affixes, replaced by a mapping table, with a default for missing ones."""
    c = F.col(col)
    for p in affixes:
        c = F.regexp_replace(c, p, "")
    rows = df.withColumn("__k", norm_key(c)).withColumn("__v", F.trim(c))
    to = bounded(mapping.select(norm_key(F.col(key)).alias("__k"), F.col(value).alias("__to")).dropDuplicates(["__k"]))
    out = rows.join(to, "__k", "left")
    return out.withColumn(col, F.coalesce("__to", F.when(F.col("__v") != "", F.col("__v")), F.lit(default))).drop("__k", "__v", "__to")


def clean_list(c: Column, sep: str = ",", prefix: str = r"^[-*\s]+", least: int = 2, most: int = 20) -> Column:
    """A delimited list: trimmed items without prefixes, short ones and repeats dropped, first ones kept."""
    items = F.transform(F.split(c, sep), lambda x: F.trim(F.regexp_replace(x, prefix, "")))
    return F.array_join(F.slice(unique_in_order(F.filter(items, lambda x: F.length(x) >= least)), 1, most), ", ")


def merge_lists(a: Column, b: Column, sep: str = ",") -> Column:
    """Items of the first list, then new ones of the second."""
    split = lambda c: F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), sep), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_join(unique_in_order(F.concat(split(a), split(b))), ", ")


def infer_field(df: DataFrame, out: str, text: Column, rules: Sequence[tuple[Sequence[str], str]], number: Column | None = None, ranges: Sequence[tuple[float, str]] = (), default: str | None = None) -> DataFrame:
    """Value of the first keyword rule, else of the first range that the number is under, else a default."""
    words = [(any_word(text, w), v) for w, v in rules]
    bands = [(number < limit, v) for limit, v in ranges] if number is not None else []
    return df.withColumn(out, first_match([*words, *bands], default))


LEVELS = ("trainee", "junior", "semisenior", "senior")


def correct_level(df: DataFrame, level: str, years: str, text: str, none: Sequence[str] = ("no experience", "sin experiencia")) -> DataFrame:
    """Level that agrees with the years asked for: a phrase of no experience makes a senior a
    junior; under 2 years nobody is senior, from 5 years on nobody is junior or trainee."""
    y, l = F.col(years), F.col(level)
    fixed = first_match([
        (any_part(F.lower(text), none) & l.isin("senior", "semisenior"), F.lit("junior")),
        ((y < 2) & (l == "senior"), F.lit("junior")),
        ((y >= 5) & l.isin("junior", "trainee"), F.lit("senior")),
    ], l)
    return df.withColumn("level_fixed", fixed).withColumn("level_changed", ~fixed.eqNullSafe(l))


def assign_sector(df: DataFrame, company: str, text: str, sector: str, catalogue: DataFrame, markers: Sequence[str], words: Sequence[tuple[str, str]], reach: int = 100) -> DataFrame:
    """Sector with its confidence: the company's in the catalogue (high; intermediaries don't count),
    else a sector word soon after a marker phrase (high), else the given one (medium)."""
    known = bounded(catalogue.select(norm_key(F.col("company")).alias("__k"), F.col("sector").alias("__known"), "intermediary").dropDuplicates(["__k"]))
    rows = df.withColumn("__k", norm_key(F.col(company))).join(known, "__k", "left")
    body = F.lower(F.col(text))
    spans = [F.substring(body, F.locate(m, body) + len(m), F.lit(reach)) for m in markers]
    by_marker = F.coalesce(*[F.when(F.locate(m, body) > 0, first_match([(s.contains(w), v) for w, v in words])) for m, s in zip(markers, spans, strict=True)])
    from_catalogue = F.when(~F.coalesce("intermediary", F.lit(False)), F.col("__known"))
    out = rows.withColumn("assigned", F.coalesce(from_catalogue, by_marker, sector))
    confidence = F.when(from_catalogue.isNotNull() | by_marker.isNotNull(), "high").when(F.col(sector).isNotNull(), "medium").otherwise("none")
    return out.withColumn("confidence", confidence).drop("__k", "__known", "intermediary")


def classify_activity(df: DataFrame, key: str, text: str, sector: str, keywords: DataFrame) -> DataFrame:
    """Activity code: the sector's own, else the code whose keywords in the text are longest in sum."""
    k = keywords.select("code", F.lower("keyword").alias("keyword"), F.lower("sector").alias("__s"))
    exact = df.join(bounded(k.select("__s", F.col("code").alias("by_sector")).distinct()), F.lower(sector) == F.col("__s"), "left").drop("__s")
    hits = containing(df, key, F.lower(text), k, "keyword").withColumnRenamed("term", "keyword").join(bounded(k), "keyword")
    hits = hits.groupBy(key, "code").agg(F.sum(F.length("keyword")).alias("w"))
    best = hits.groupBy(key).agg(F.min_by("code", F.struct(-F.col("w"), "code")).alias("by_words"))
    return exact.join(best, key, "left").withColumn("code", F.coalesce("by_sector", "by_words")).drop("by_sector", "by_words")


def apply_dictionary(df: DataFrame, key: str, title: str, terms: DataFrame) -> DataFrame:
    """Titles with their longest regional term as a whole word replaced by the common one."""
    spaces = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    t = terms.select(F.lower("term").alias("term"), "common", spaces(F.lower("term")).alias("__term"))
    padded = spaces(norm_key(F.col(title)))
    found = containing(df, key, padded, t, "__term").withColumnRenamed("term", "__term").join(bounded(t), "__term")
    hits = found.groupBy(key).agg(F.max_by(F.struct("term", "common"), F.struct(F.length("term"), "term")).alias("h"))
    out = df.join(hits, key, "left")
    swapped = F.trim(F.replace(padded, F.concat(F.lit(" "), F.col("h.term"), F.lit(" ")), F.concat(F.lit(" "), F.col("h.common"), F.lit(" "))))
    return out.withColumn("term", F.col("h.term")).withColumn("rewritten", F.when(F.col("h").isNull(), F.col(title)).otherwise(swapped)).drop("h")


RANKS = (("director", 5), ("manager", 4), ("lead", 3), ("senior", 3), ("analyst", 2), ("junior", 1), ("trainee", 0))


def level_rank(c: Column, ranks: Sequence[tuple[str, int]] = RANKS, exceptions: Sequence[tuple[str, int]] = ()) -> Column:
    """Rank of a text by its first keyword as a whole word; exceptions come first."""
    t = F.lower(c)
    return first_match([(any_word(t, [w]), F.lit(r)) for w, r in (*exceptions, *ranks)])


def level_penalty(a: Column, b: Column) -> Column:
    """Penalty by the distance of two ranks; none if one is unknown."""
    far = F.abs(a - b)
    return F.when(far.isNull() | (far <= 1), 0.0).when(far == 2, 0.1).otherwise(0.25)


def apply_corrections(df: DataFrame, col: str, fixes: DataFrame) -> DataFrame:
    """Values replaced by reviewed corrections (raw, fixed) of the raw value."""
    f = bounded(fixes.select(F.col("raw").alias(col), "fixed").dropDuplicates([col]))
    out = df.join(f, col, "left")
    return out.withColumn("changed", F.col("fixed").isNotNull() & ~F.col("fixed").eqNullSafe(F.col(col))).withColumn(col, F.coalesce("fixed", col)).drop("fixed")


def correction_counts(df: DataFrame) -> DataFrame:
    """Rows and changed rows of ``apply_corrections``."""
    return df.agg(F.count("*").alias("n"), F.count_if("changed").alias("changed"), percent(F.count_if("changed"), F.count("*")).alias("changed_pct"))


def first_of(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key in a fixed order."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")
