"""Joins of texts with many terms: which terms stand in a text, begin it, or are like it.

None of them compares all texts with all terms: each is an equi-join on keys that every match shares
for certain, with a check of the pairs that it gives. Terms are broadcast while they are few, as
counted, and joined by a shuffle beyond; the plan has no nested loop at any number of them.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.sources.scratch import checkpointed

#: Rows up to which a dimension is broadcast, and characters of the keys of terms.
BROADCAST_ROWS, GRAM = 100_000, 4
#: Keys that a text may have for partners of one length, and characters that may be left out for them.
LEFT_OUT_KEYS, LEFT_OUT = 512, 3


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has few rows, as counted; otherwise joins shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def grams(text: Column, n: int) -> Column:
    """Different runs of ``n`` characters of a text."""
    cut = F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n)))
    return F.when(F.length(text) >= n, F.array_distinct(cut)).otherwise(F.array().cast("array<string>"))


def _keys(text: Column, sizes: list[int]) -> Column:
    return F.concat(*[grams(text, n) for n in sizes])


def containing(df: DataFrame, key: str, text: Column, terms: DataFrame, term: str) -> DataFrame:
    """(key, text, term): the terms that stand in a text, each once; empty terms stand in none.

    Each term is keyed by that one of its runs of ``GRAM`` characters (the whole of a shorter term)
    which the fewest texts have; a text meets only terms whose key it has, and is searched for them.
    Terms of which a run is in no text are out before the join.
    """
    texts = df.select(F.col(key), text.alias("text"))
    wanted = terms.select(F.col(term).cast("string").alias("term")).where("term <> ''").distinct()
    size = F.least(F.lit(GRAM), F.length("term"))
    sizes = sorted(r[0] for r in wanted.select(size.alias("n")).distinct().collect())  # four at most
    if not sizes:
        return texts.select(key, "text", F.lit(None).cast("string").alias("term")).limit(0)
    pieces = wanted.select("term", F.explode(F.coalesce(*[F.when(size == n, grams(F.col("term"), n)) for n in sizes])).alias("gram"))
    cut = texts.select(F.explode(_keys(F.col("text"), sizes)).alias("gram"))
    often = cut.join(bounded(pieces.select("gram").distinct()), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    found = pieces.join(often, "gram", "left").groupBy("term").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"), F.min(F.coalesce("n", F.lit(0))).alias("n"))
    keyed = checkpointed(found.where("n > 0").select("gram", "term"))
    if keyed.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        pairs = texts.select(key, "text", F.explode(_keys(F.col("text"), sizes)).alias("gram")).join(F.broadcast(keyed), "gram")
    else:  # the keys are shuffled and not the texts with them
        pairs = texts.select(key, F.explode(_keys(F.col("text"), sizes)).alias("gram")).join(keyed, "gram").join(texts, key)
    return pairs.where(F.col("text").contains(F.col("term"))).select(key, "text", "term")


def begun_by(df: DataFrame, label: str, names: DataFrame, name: str, best: Column, order: Column) -> DataFrame:
    """(label, best): of the names that begin with a label, ``best`` of the first in an order. Names
    are cut to each length that a label has and grouped by what is left, so a label meets one row."""
    labels = df.select(F.col(label)).where(F.col(label).isNotNull()).distinct()
    lengths = bounded(labels.select(F.length(label).alias("__size")).distinct())
    cut = names.select("*", F.explode(F.sequence(F.lit(0), F.length(name))).alias("__size")).join(lengths, "__size")
    heads = cut.groupBy(F.substring(F.col(name), F.lit(1), F.col("__size")).alias(label)).agg(F.min_by(best, order).alias("best"))
    return labels.join(heads, label)


def like_texts(titles: DataFrame, names: DataFrame, least: float, by: Sequence[str] = ()) -> DataFrame:
    """Candidate pairs (__t, __n) that hold every pair with an edit likeness of ``least`` or more, and
    equal (not null) values of the columns ``by``.

    Such a pair has lengths within that ratio, so a name of length L is at most
    ``k = (1 - least) / least * L`` edits away. Of its k + 1 segments one at least is in the title as
    it is, moved by no more than k places. At a half or less the segments are empty, and the letters
    are joined instead.
    """
    if least <= 0.5:
        return like_letters(titles, names, least, by)
    slack = 1e-9
    names, titles = names.where("length(__n) > 0"), titles.where("length(__t) > 0")
    k = F.floor(F.col("__len") * ((1 - least) / least) + slack).cast("int")
    start = lambda i: F.floor(F.col("__len") * i / (F.col("__k") + 1)).cast("int")
    cut = lambda d: d.withColumn("__k", k).withColumn("__i", F.explode(F.sequence(F.lit(0), "__k"))).withColumns({"__from": start(F.col("__i")), "__size": start(F.col("__i") + 1) - start(F.col("__i"))})
    mine = cut(names.withColumn("__len", F.length("__n")))
    mine = mine.select(*by, "__n", "name", "__len", "__i", F.substring("__n", F.col("__from") + 1, F.col("__size")).alias("__s"))
    t = F.length("__t")
    lengths = F.sequence(F.ceil(t * least - slack).cast("int"), F.floor(t / least + slack).cast("int"))
    theirs = cut(titles.withColumn("__len", F.explode(lengths)))
    low, high = F.greatest(F.lit(0), F.col("__from") - F.col("__k")), F.least(t - F.col("__size"), F.col("__from") + F.col("__k"))
    theirs = theirs.where(low <= high).withColumn("__at", F.explode(F.sequence(low, high)))
    theirs = theirs.select(*by, "__t", "__len", "__i", F.substring("__t", F.col("__at") + 1, F.col("__size")).alias("__s")).distinct()
    return theirs.join(mine, [*by, "__len", "__i", "__s"]).select(*by, "__t", "__n", "name").distinct()


def like_letters(titles: DataFrame, names: DataFrame, least: float, by: Sequence[str] = ()) -> DataFrame:
    """``like_texts`` by letters, for any likeness above 0: such a pair has at least ``least`` of the
    longer one's letters in common, so in an order of all letters and of how often each has come
    before they share one of the first ``L - ceil(least L) + 1``. Letters that come again go first."""
    if least <= 0:
        raise ValueError("all texts are alike to 0")

    def first(text: Column) -> Column:
        letters = F.split(text, "")
        one = F.transform(letters, lambda c, i: F.struct((-F.size(F.filter(F.slice(letters, 1, i + 1), lambda x: x == c))).alias("again"), c.alias("letter")))
        return F.slice(F.array_sort(one), 1, F.length(text) - F.ceil(F.length(text) * least - 1e-9).cast("int") + 1)

    mine = names.where("length(__n) > 0").select(*by, "__n", "name", F.explode(first(F.col("__n"))).alias("__s"))
    theirs = titles.where("length(__t) > 0").select(*by, "__t", F.explode(first(F.col("__t"))).alias("__s"))
    close = (F.length("__t") >= F.length("__n") * least - 1e-9) & (F.length("__n") >= F.length("__t") * least - 1e-9)
    return theirs.join(mine, [*by, "__s"]).where(close).select(*by, "__t", "__n", "name").distinct()


def left_out(text: Column, n: int) -> Column:
    """Different texts that are left of one when ``n`` of its characters go."""
    found = F.array(text)
    for _ in range(n):
        one = lambda t: F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t))))
        found = F.array_distinct(F.flatten(F.transform(found, one)))
    return found


def like_pairs(texts: DataFrame, text: str, least: float, by: Sequence[str] = ()) -> DataFrame:
    """Candidate pairs (__t, __n), ``__t < __n``, of the texts of one table that hold every pair with an
    edit likeness of ``least`` or more and equal (not null) values of the columns ``by``.

    Texts of lengths L and M <= L that are so alike are at most ``k = (1 - least) L`` edits away, so
    they have a text of L - k characters in common that is left when others go. Those are the keys,
    and few other pairs share one, also where all texts begin alike. For lengths with more than
    ``LEFT_OUT_KEYS`` such texts the keys are the segments of ``like_texts``.
    """
    slack, own = 1e-9, F.length(text)
    ways = lambda n: [1, *(math.prod(range(n - j + 1, n + 1)) // math.factorial(j) for j in range(1, LEFT_OUT + 1))]
    lengths = {r[0] for r in texts.where(own > 0).select(own.alias("n")).distinct().collect()}  # lengths, not texts
    kinds, far = [], set()
    for long in lengths:
        k = math.floor((1 - least) * long + slack)
        for short in (m for m in lengths if long - k <= m <= long):
            if k <= LEFT_OUT and k < long and ways(long)[k] <= LEFT_OUT_KEYS:
                kinds += {(long, long, short, k), (short, long, short, k - (long - short))}
            else:
                far |= {long, short}
    keys = texts.limit(0).select(*by, text, F.lit(0).alias("long"), F.lit(0).alias("short"), F.lit(0).cast("long").alias("key"))
    if kinds:
        kinds = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(("len", "long", "short", "out"), kind, strict=True)]) for kind in sorted(set(kinds))])
        kinds = F.broadcast(texts.sparkSession.range(1).select(F.inline(kinds)))
        rows = texts.select(*by, text, own.alias("len")).join(kinds, "len")
        keys = rows.select(*by, text, "long", "short", F.explode(first_of_n(F.col("out"), [left_out(F.col(text), n) for n in range(LEFT_OUT + 1)])).alias("key")).withColumn("key", F.xxhash64("key"))
    a, b = (keys.select(*by, "long", "short", "key", F.col(text).alias(x)) for x in ("__t", "__n"))
    pairs = a.hint("merge").join(b, [*by, "long", "short", "key"]).where("__t < __n").select(*by, "__t", "__n")
    if far:
        rest = texts.where(own.isin(sorted(far)))
        near = like_texts(rest.select(*by, F.col(text).alias("__t")), rest.select(*by, F.col(text).alias("__n"), F.col(text).alias("name")), least, by)
        pairs = pairs.union(near.where("__t < __n").select(*by, "__t", "__n"))
    return pairs.distinct()


def first_of_n(n: Column, values: Sequence[Column]) -> Column:
    """The value at a place; only that one is computed."""
    return F.coalesce(*[F.when(n == i, v) for i, v in enumerate(values)])
