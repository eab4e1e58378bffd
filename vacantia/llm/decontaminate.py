"""Benchmark decontamination by spaced-seed hashing. DataFrame operations only.

A mask selects some of the token positions in a short span and ignores the others, so a window
still meets its source if the tokens at ignored positions were substituted. Seeds of all masks at
all positions of the benchmark items are joined with those of all documents. Around each hit, item
and document are aligned and compared token by token: the overlap is the stretch with the highest
score, a match counting 1 and a substitution -1. A pair is a leak if, of an item of n tokens, that
score reaches ``min(MIN_SCORE, ceil(MIN_SHARE * n))`` and the matched tokens ``min(MIN_MATCHED, n -
floor(n / 5))``: so an item under five tokens has to stand in the document as it is, one of five to
nine may have one token substituted, and of longer ones a stretch is enough. Masks find nearly all
of these overlaps; for items under ``SPAN`` tokens, which they may not fit, the seeds are the two
halves of the item, one of which a single substitution leaves as it is (under five tokens: the whole
item), so of these none is missed.

Tokens are runs of letters and digits, lower-cased, so punctuation and case don't hide a copy. All
masks begin with two adjacent positions; positions whose first two tokens don't stand together in
the benchmark are passed over before seeds are made. A position carries no more of its text than
the window of a mask, and alignments are compared on slices as long as their item, so memory grows
with the length of a text and not with its square. Seeds are broadcast only while the benchmark
has at most ``BROADCAST_TOKENS`` tokens; beyond that the same seeds are joined by a shuffle.

Defined results: null and empty texts and items have no tokens and no leaks; rows without an id have
no leaks; repeated documents or items with one id count as one; ties take the smallest start; empty
tables give no leaks. Other columns of the inputs are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.llm.ids import counted, unused, without
from vacantia.sources.scratch import checkpointed

#: Selected positions of each mask, and the longest span of one.
MASKS = ((0, 1, 2, 3, 5, 6), (0, 1, 3, 4, 7, 8), (0, 1, 4, 6, 7, 9))
SPAN = 10
MIN_SCORE, MIN_SHARE, MIN_MATCHED = 10, 0.6, 8
BROADCAST_TOKENS = 1_000_000
#: Starts of alignments and items that are compared in one row of a document.
STARTS, ITEMS = 512, 16


def token_hashes(text: Column) -> Column:
    """Hashes of the lower-case tokens of a text, in order."""
    tokens = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    return F.transform(tokens, lambda t: F.xxhash64(t))


def _windows(tokens: Column) -> Column:
    """The tokens from each position on, as many as a mask spans."""
    return F.transform(tokens, lambda _, i: F.slice(tokens, i + 1, SPAN))


def _pair(window: Column) -> Column:
    return F.xxhash64(F.get(window, 0), F.get(window, 1))


def _seeds(window: Column) -> Column:
    """Structs of a mask and its seed for the masks that fit in a window."""
    fits = [F.when(F.size(window) > m[-1], F.struct(F.lit(i).alias("mask"), F.xxhash64(F.lit(i), *[F.get(window, o) for o in m]).alias("seed"))) for i, m in enumerate(MASKS)]
    return F.filter(F.array(*fits), lambda x: x.isNotNull())


def _grams(window: Column, lengths: list[int]) -> Column:
    """Structs of a length and the hash of so many tokens, of a window."""
    fits = [F.when(F.size(window) >= n, F.struct(F.lit(-n).alias("mask"), F.xxhash64(F.lit(n), F.slice(window, 1, n)).alias("seed"))) for n in lengths]
    return F.filter(F.array(*fits), lambda x: x.isNotNull()) if fits else F.array().cast("array<struct<mask:int,seed:bigint>>")


def tolerated(n: Column) -> Column:
    """Tokens that may differ of an item that has to match as a whole."""
    return F.floor(n / 5).cast("int")


def _items(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    items = benchmark.select(F.col(item_id).cast("long").alias("item_id"), token_hashes(F.col(text)).alias("item"))
    return items.where((F.size("item") > 0) & F.col("item_id").isNotNull()).dropDuplicates()


def _alignments(tokens: DataFrame, items: DataFrame, small: bool) -> DataFrame:
    """(doc_id, item_id, shift) where a seed of a document is one of an item."""
    hint = F.broadcast if small else (lambda df: df)
    w, n = F.col("w"), F.size("item")
    placed = items.select("item_id", n.alias("n"), F.posexplode(_windows(F.col("item"))).alias("place", "w"))
    long = placed.select("item_id", "place", F.explode(_seeds(w)).alias("s"))
    # (start, length) of the parts of a short item
    half = F.floor(n / 2).cast("int")
    cut = lambda at, size: F.struct(F.lit(at).cast("int").alias("place") if isinstance(at, int) else at.alias("place"), size.alias("size"))
    parts = F.when(n < 5, F.array(cut(0, n))).otherwise(F.array(cut(0, half), cut(half, n - half)))
    short = items.where(n < SPAN).select("item_id", "item", F.explode(parts).alias("p")).select("item_id", "p.place", "p.size", F.slice("item", F.col("p.place") + 1, F.col("p.size")).alias("part"))
    lengths = sorted(r[0] for r in short.select("size").distinct().collect())  # five at most
    brief = short.select("item_id", "place", (-F.col("size")).alias("mask"), F.xxhash64("size", "part").alias("seed"))
    pairs = placed.where(F.size("w") > 1).select(_pair(w).alias("pair")).distinct()
    seeds = long.select("item_id", "place", "s.mask", "s.seed").union(brief.where("mask < -1"))

    found = tokens.select("doc_id", F.posexplode(_windows(F.col("tokens"))).alias("at", "w"))
    found = found.where(F.size("w") > 1).withColumn("pair", _pair(w)).join(hint(pairs), "pair", "left_semi")
    found = found.select("doc_id", "at", F.explode(F.concat(_seeds(w), _grams(w, [x for x in lengths if x > 1]))).alias("s")).select("doc_id", "at", "s.mask", "s.seed")
    found = found.join(hint(seeds), ["mask", "seed"]).select("doc_id", "item_id", (F.col("at") - F.col("place")).alias("shift"))
    if 1 in lengths:
        single = items.where(n == 1).select("item_id", F.get("item", 0).alias("token"))
        # once in a document is enough for an item of one token
        one = tokens.select("doc_id", "tokens", F.explode(F.array_distinct("tokens")).alias("token")).join(hint(single), "token")
        found = found.union(one.select("doc_id", "item_id", (F.array_position("tokens", F.col("token")) - 1).cast("int").alias("shift")))
    return found.distinct()


def _compared(tokens: DataFrame, items: DataFrame, found: DataFrame, small: bool) -> DataFrame:
    """(doc_id, item_id, shift, n, same): which tokens of an item match at each alignment. A row of
    alignments has so many starts and items that it stays small; a document's tokens are repeated for
    each such row."""
    packs = max(1, -(-items.count() // ITEMS))
    found = found.join(F.broadcast(items) if small else items, "item_id")
    one = F.struct("item_id", "item", "shift")
    groups = found.groupBy("doc_id", F.floor(F.col("shift") / STARTS).alias("stretch"), F.pmod(F.xxhash64("item_id"), F.lit(packs)).alias("pack")).agg(F.collect_list(one).alias("found"))
    t = F.col("tokens")

    def same(x: Column) -> Column:
        begin = F.greatest(x["shift"], F.lit(0))
        part = F.slice(t, begin + 1, F.greatest(F.lit(0), F.size(x["item"]) + x["shift"] - begin))
        match = F.transform(x["item"], lambda h, i: F.coalesce(F.when(x["shift"] + i >= 0, F.get(part, F.greatest(x["shift"] + i - begin, F.lit(0))) == h), F.lit(False)))
        return F.struct(x["item_id"].alias("item_id"), x["shift"].alias("shift"), match.alias("same"))

    rows = groups.join(tokens, "doc_id").select("doc_id", F.explode(F.transform("found", same)).alias("x"))
    return rows.select("doc_id", "x.*", F.size("x.same").alias("n"))


def _scored(rows: DataFrame) -> DataFrame:
    """The best overlap (score, start, end, matched, item tokens) of each alignment that is a leak."""
    zero = F.struct(*[F.lit(0).alias(x) for x in ("at", "score", "begin", "matched", "best", "start", "end", "same")])

    def step(s: Column, ok: Column) -> Column:
        fresh = s["score"] <= 0
        score = F.when(fresh, F.lit(0)).otherwise(s["score"]) + F.when(ok, 1).otherwise(-1)
        begin = F.when(fresh, s["at"]).otherwise(s["begin"])
        matched = F.when(fresh, F.lit(0)).otherwise(s["matched"]) + F.when(ok, 1).otherwise(0)
        better = score > s["best"]
        end = s["at"] + 1
        pick = [F.when(better, a).otherwise(b) for a, b in ((score, s["best"]), (begin, s["start"]), (end, s["end"]), (matched, s["same"]))]
        names = ("at", "score", "begin", "matched", "best", "start", "end", "same")
        return F.struct(*[v.alias(n) for v, n in zip((end, score, begin, matched, *pick), names, strict=True)])

    rows = rows.select("doc_id", "item_id", "shift", "n", F.aggregate("same", zero, step).alias("b"))
    enough = F.least(F.lit(MIN_SCORE), F.ceil(F.col("n") * MIN_SHARE))
    matched = F.least(F.lit(MIN_MATCHED), F.col("n") - tolerated(F.col("n")))
    return rows.where((F.col("b.best") >= enough) & (F.col("b.same") >= matched)).select(
        "doc_id",
        "item_id",
        F.col("b.best").cast("long").alias("score"),
        (F.col("shift") + F.col("b.start")).cast("long").alias("start"),
        (F.col("shift") + F.col("b.end")).cast("long").alias("end"),
        F.col("b.same").cast("long").alias("matched"),
        F.col("n").cast("long").alias("item_tokens"),
    )


def leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """One row per leaked pair: doc_id, item_id, its best overlap (score, start and end in tokens of
    the document, matched tokens) and the item's tokens."""
    items = checkpointed(_items(benchmark, item_id, text))
    small = (items.agg(F.sum(F.size("item"))).first()[0] or 0) <= BROADCAST_TOKENS
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("doc_id IS NOT NULL")
    hashed = docs.select("doc_id", token_hashes(F.col("text")).alias("tokens"))
    found = checkpointed(_alignments(hashed, items, small))
    # only the texts with an alignment are read again
    some = docs.join(counted(found.select("doc_id").distinct()), "doc_id", "left_semi").select("doc_id", token_hashes(F.col("text")).alias("tokens"))
    rows = _scored(_compared(some, items, found, small))
    best = F.max_by(F.struct("score", "start", "end", "matched", "item_tokens"), F.struct("score", -F.col("start"), "end")).alias("b")
    return rows.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.*")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows without a leak. Rows are told apart by id and text, so of several texts of one id only
    those with a leak go, and rows without an id are compared as well."""
    key = unused(docs, "row_hash")
    rows = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    return without(rows, leaks(rows, benchmark, doc_id=key).withColumnRenamed("doc_id", key), key).select(docs.columns)


def report_sql() -> str:
    """DuckDB SQL for ``leaks`` over all alignments of seeds."""
    masks = ", ".join(f"{list(m)}" for m in MASKS)
    return f"""
WITH RECURSIVE
d AS (SELECT DISTINCT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\pL\\pN]+'), lambda x: x <> '') AS t FROM documents),
b AS (SELECT DISTINCT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\pL\\pN]+'), lambda x: x <> '') AS t FROM benchmark),
items AS (SELECT * FROM b WHERE len(t) > 0),
brief AS (SELECT d.doc_id, b.item_id, unnest(range(-1, len(d.t) - len(b.t) + 2)) AS shift FROM d JOIN items b ON len(b.t) < {SPAN}),
masks AS (SELECT m, row_number() OVER () AS k FROM (SELECT unnest([{masks}]) AS m)),
dp AS (SELECT doc_id, t, unnest(range(len(t))) AS p FROM d),
ip AS (SELECT item_id, t, unnest(range(len(t))) AS q FROM items),
pairs AS (SELECT DISTINCT t[q + 1] AS a, t[q + 2] AS b FROM ip WHERE q + 2 <= len(t)),
dq AS (SELECT doc_id, t, p FROM dp SEMI JOIN pairs ON t[p + 1] = a AND t[p + 2] = b),
ds AS (SELECT doc_id, p, k, list_transform(m, lambda o: t[p + o + 1]) AS s FROM dq, masks WHERE p + m[-1] < len(t)),
bs AS (SELECT item_id, q, k, list_transform(m, lambda o: t[q + o + 1]) AS s FROM ip, masks WHERE q + m[-1] < len(t)),
al AS (SELECT DISTINCT doc_id, item_id, p - q AS shift FROM ds JOIN bs USING (k, s) UNION SELECT * FROM brief),
same AS (SELECT a.doc_id, a.item_id, shift, len(i.t) AS n, list_transform(i.t, lambda x, j: shift + j > 0 AND coalesce(d.t[shift + j] = x, false)) AS e
  FROM al a JOIN d ON a.doc_id = d.doc_id JOIN items i ON a.item_id = i.item_id),
seg AS (SELECT doc_id, item_id, shift, n, u.i AS i, v.j AS j,
    list_sum(list_transform(e[u.i + 1 : v.j], lambda x: CASE WHEN x THEN 1 ELSE -1 END)) AS score,
    list_sum(list_transform(e[u.i + 1 : v.j], lambda x: x::INT)) AS matched
  FROM same, LATERAL (SELECT unnest(range(n)) AS i) u, LATERAL (SELECT unnest(range(u.i + 1, n + 1)) AS j) v),
one AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id, shift ORDER BY score DESC, j, i DESC) AS r FROM seg)
SELECT doc_id, item_id, score::BIGINT AS score, shift + i AS "start", shift + j AS "end", matched::BIGINT AS matched, n AS item_tokens
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY score DESC, shift + i, shift + j DESC) AS r2
  FROM one WHERE r = 1 AND score >= least({MIN_SCORE}, ceil(n * {MIN_SHARE})) AND matched >= least({MIN_MATCHED}, n - n // 5)) WHERE r2 = 1"""
