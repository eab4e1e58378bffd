"""Licence scan with a positional index of rare words. DataFrame operations only.

A template is a word sequence with a mandatory key phrase inside it. The index holds, for each
template, the places of its words; document frequencies of these words are counted over all
documents. A file is probed only with each template's two highest-IDF key words: the starts that
both imply by their relative positions are intersected, the key phrase is verified there in
full, and the rest of the template is compared word by word, which gives the score.

The scan is a map over rows: nothing is shuffled, so copies, hot sources and repeated rows cost
no more than others. A null text has no words; an empty text or table gives zero counts, null
places, empty labels and score 0. Other columns of the input pass through.

``lower`` also folds letters outside A-Z, but maps none of them to a letter of a template (only
the Kelvin sign folds into ASCII, to ``k``; templates hold no ``k``), so words and places are those
of an A-Z fold.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.llm.ids import unused

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Share of a template's words that must stand at their places.
MIN_SCORE = 0.8


@dataclass(frozen=True)
class Template:
    """A licence text: its label, words, and the mandatory phrase among them."""

    label: str
    words: tuple[str, ...]
    key: tuple[str, ...]
    base: bool = False

    @property
    def key_at(self) -> int:
        n = len(self.key)
        return next(i for i in range(len(self.words)) if self.words[i : i + n] == self.key)


def template(label: str, text: str, key: str | None = None, base: bool = False) -> Template:
    words = tuple(text.split())
    made = Template(label, words, tuple((key or text).split()), base)
    if "k" in text or made.key_at < 0 or len(made.key) < 2:
        raise ValueError(f"template {label}: needs a key phrase of two words, without the letter k")
    return made


TEMPLATES = (
    template("gpl", "gnu general public license", base=True),
    template("apache", "apache license", base=True),
    template("cc-by", "cc by", base=True),
    template("mit", "mit license", base=True),
    template("gpl-2.0", "gnu general public license version 2", "gnu general public license"),
    template("gpl-3.0", "gnu general public license version 3", "gnu general public license"),
    template("lgpl", "gnu lesser general public license"),
    template("agpl", "gnu affero general public license"),
    template("apache-2.0", "apache license version 2 0", "apache license"),
    template("mpl-2.0", "mozilla public license version 2 0", "mozilla public license"),
    template("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    template("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa"),
    template("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc"),
    template("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    template("bsd-text", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
)


def words(text: Column) -> Column:
    """Lower-case words of a text; none for null."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def document_frequencies(df: DataFrame, templates: tuple[Template, ...], text: str = "text") -> dict[str, int]:
    """Documents that hold each key word. At most one row a template word reaches the driver."""
    vocabulary = sorted({w for t in templates for w in t.key})
    found = F.array_intersect(F.array(*map(F.lit, vocabulary)), words(F.col(text)))
    rows = df.select(F.explode(found).alias("word")).groupBy("word").count().collect()
    return dict.fromkeys(vocabulary, 0) | {r["word"]: r["count"] for r in rows}


def _pivots(t: Template, frequency: dict[str, int]) -> list[int]:
    """Offsets of the two rarest words of the key phrase that differ, rarest first."""
    ranked = sorted(range(len(t.key)), key=lambda i: (frequency[t.key[i]], i))
    first = ranked[0]
    return [first, next((i for i in ranked if t.key[i] != t.key[first]), ranked[1])]


def scan(df: DataFrame, templates: tuple[Template, ...] = TEMPLATES, text: str = "text") -> DataFrame:
    """``df`` with ``license_words`` (their number) and ``licenses``: an array with one struct for
    each template, in order, of its ``label`` and the ``places`` (start in words, score) where its
    key phrase stands. Columns of these names are replaced."""
    frequency = document_frequencies(df, templates, text)
    rare = sorted({t.key[i] for t in templates for i in _pivots(t, frequency)})
    held, sought = unused(df, "__words"), unused(df, "__probes")
    w, probes = F.col(held), F.col(sought)
    df = df.withColumn(held, words(F.col(text)))
    at = F.when(F.size(w) > 0, F.sequence(F.lit(0), F.size(w) - 1)).otherwise(F.array().cast("array<int>"))
    df = df.withColumn(sought, F.filter(at, lambda i: F.get(w, i).isin(rare)))

    def places(t: Template) -> Column:
        key = F.array(*map(F.lit, t.key))

        def implied(i: int) -> Column:
            return F.transform(F.filter(probes, lambda p: F.get(w, p) == t.key[i]), lambda p: p - i)

        starts = F.array_intersect(*map(implied, _pivots(t, frequency)))
        starts = F.filter(starts, lambda p: (p >= 0) & (F.slice(w, F.greatest(p, F.lit(0)) + 1, len(t.key)) == key))

        def hit(p: Column) -> Column:
            same = [F.coalesce((F.get(w, p + (i - t.key_at)) == x).cast("int"), F.lit(0)) for i, x in enumerate(t.words)]
            score = F.lit(1.0) if t.words == t.key else reduce(Column.__add__, same) / len(same)
            return F.struct((p - t.key_at).cast("long").alias("start"), score.cast("double").alias("score"))

        return F.struct(F.lit(t.label).alias("label"), F.transform(starts, hit).alias("places"))

    df = df.withColumn("licenses", F.array(*map(places, templates)))
    return df.withColumn("license_words", F.size(w).cast("long")).drop(held, sought)


def _labels(structs: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(structs, lambda x: x["label"]))), ",")


def report(df: DataFrame, templates: tuple[Template, ...] = TEMPLATES, text: str = "text") -> DataFrame:
    """Per document: words, places of the base phrases, labels and the best score."""
    base = [t.label for t in templates if t.base]
    rows = scan(df.select("doc_id", text), templates, text)
    hits = F.filter("licenses", lambda x: F.size(x["places"]) > 0)
    rows = rows.select("doc_id", F.col("license_words").alias("n_words"), hits.alias("hits"))
    of_base = F.filter("hits", lambda x: x["label"].isin(base))
    good = F.filter("hits", lambda x: x["label"].isin(base) | F.exists(x["places"], lambda p: p["score"] >= MIN_SCORE))
    starts = F.flatten(F.transform(of_base, lambda x: F.transform(x["places"], lambda p: p["start"])))
    scores = F.flatten(F.transform(good, lambda x: F.transform(x["places"], lambda p: p["score"])))
    return rows.select(
        "doc_id",
        "n_words",
        F.size(starts).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        _labels(of_base).alias("base_labels"),
        _labels(good).alias("labels"),
        F.coalesce(F.array_max(scores), F.lit(0.0)).alias("score"),
    )


def report_sql(templates: tuple[Template, ...] = TEMPLATES) -> str:
    """DuckDB SQL for ``report``, by comparing every place of every text."""

    def places(t: Template) -> str:
        same = " AND ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(t.key))
        score = " + ".join(f"(i + {k + 1 - t.key_at} > 0 AND coalesce(w[i + {k + 1 - t.key_at}] = '{x}', false))::INT" for k, x in enumerate(t.words))
        return f"list_transform(list_filter(range(len(w)), lambda i: coalesce({same}, false)), lambda i: {{'start': i - {t.key_at}, 'score': ({score}) / {len(t.words)}.0::DOUBLE}})"

    base = ", ".join(f"'{t.label}'" for t in templates if t.base)
    hits = ", ".join(f"{{'label': '{t.label}', 'places': {places(t)}}}" for t in templates)
    return f"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
found AS (SELECT doc_id, len(w) AS n_words, list_filter([{hits}], lambda x: len(x.places) > 0) AS hits FROM split),
kept AS (SELECT doc_id, n_words, list_filter(hits, lambda x: x.label IN ({base})) AS b,
  list_filter(hits, lambda x: x.label IN ({base}) OR len(list_filter(x.places, lambda p: p.score >= {MIN_SCORE})) > 0) AS g FROM found),
flat AS (SELECT *, flatten(list_transform(b, lambda x: list_transform(x.places, lambda p: p.start))) AS starts,
  flatten(list_transform(g, lambda x: list_transform(x.places, lambda p: p.score))) AS scores FROM kept)
SELECT doc_id, n_words, len(starts) AS n_base, list_min(starts) AS first_word, list_max(starts) AS last_word,
  array_to_string(list_sort(list_distinct(list_transform(b, lambda x: x.label))), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_transform(g, lambda x: x.label))), ',') AS labels,
  coalesce(list_max(scores), 0.0)::DOUBLE AS score FROM flat"""
