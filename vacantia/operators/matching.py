"""Occupation and skill matching: vectors, candidate lists, rules, decision."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacantia.functions.columns import half_up, percent
from vacantia.functions.text import first_match, norm_key, similarity
from vacantia.operators.dedup import jaccard, token_set
from vacantia.operators.ingest import append_into, replace_into, upsert_into
from vacantia.operators.terms import begun_by, bounded, containing, like_texts
from vacantia.sources.scratch import checkpointed
from vacantia.sources.versioned import VersionedTable

#: Query vectors and catalogue vectors of a task's group; queries that are multiplied with it at once,
#: and pairs that are multiplied one by one.
QUERY_BLOCK, ITEM_BLOCK, QUERY_ROWS, SCORED_ROWS = 4_000, 8_000, 128, 20_000
#: Hyperplanes of the bucketed search, and how many of them a probed bucket may differ in.
PLANES, RADIUS = 8, 5


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, name: str = "rank") -> DataFrame:
    """The first rows per key with their rank."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")
    return df.withColumn(name, rank).where(F.col(name) <= n)


def _unit(vectors: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows of length 1; NaN where they have none."""
    flat = vectors.combine_chunks()
    sizes = np.diff(flat.offsets.to_numpy())
    if len(set(sizes.tolist())) > 1:
        raise ValueError("vectors of different lengths have no cosine")
    m = flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)
    n = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, n, out=np.full_like(m, np.nan), where=n > 0)


def _vectors(df: DataFrame, key: str, vector: str, name: str) -> DataFrame:
    rows = df.select(F.col(key).cast("long").alias(name), F.col(vector).cast("array<double>").alias("v"))
    return rows.where("v IS NOT NULL")


def _packs(df: DataFrame, rows: int, packs: str) -> DataFrame:
    """Packs of about ``rows`` rows in each bucket ``code``."""
    return bounded(df.groupBy("code").agg(F.ceil(F.count("*") / rows).alias(packs)))


def _best(queries: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """The k best items (item_id, code, v) of each query (query_id, code, v) with its code. In each
    bucket packs of queries meet packs of items, as groups of plain rows of which a task holds one;
    each returns k rows a query at most."""
    sizes = _packs(queries, QUERY_BLOCK, "query_packs").join(_packs(items, ITEM_BLOCK, "item_packs"), "code")
    sizes = bounded(checkpointed(sizes))
    own = lambda key, packs: F.pmod(F.xxhash64(key), F.col(packs))
    every = lambda packs: F.explode(F.sequence(F.lit(0).cast("long"), F.col(packs) - 1))
    q = queries.join(sizes, "code").select("code", "query_id", "v", own("query_id", "query_packs").alias("p"), every("item_packs").alias("r"))
    c = items.join(sizes, "code").select("code", "item_id", "v", every("query_packs").alias("p"), own("item_id", "item_packs").alias("r"))

    def search(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        ids, found_ids, items, scores = mine["query_id"].to_numpy(), [], [], []
        if len(mine) and len(theirs):
            a, b, names = _unit(mine["v"]), _unit(theirs["v"]), theirs["item_id"].to_numpy()
            fit = ~np.isnan(b).any(axis=1)
            b, names = b[fit], names[fit]
            for at in range(0, len(a) if len(b) else 0, QUERY_ROWS):
                near = a[at : at + QUERY_ROWS] @ b.T
                least = np.partition(near, len(b) - k, axis=1)[:, len(b) - k] if len(b) > k else np.full(len(near), -2.0)
                # products of blocks differ in their last bits: what is as near is computed again, row by row
                row, col = np.nonzero(near >= least[:, None] - 1e-9)
                score = np.concatenate([(a[at + row[i : i + SCORED_ROWS]] * b[col[i : i + SCORED_ROWS]]).sum(axis=1) for i in range(0, len(row), SCORED_ROWS)] or [np.zeros(0)])
                order = np.lexsort((names[col], -score, row))
                place = np.arange(len(order)) - np.searchsorted(row[order], row[order])
                order = order[place < k]
                found_ids.append(ids[at + row[order]]), items.append(names[col[order]]), scores.append(score[order])
        none = np.zeros(0, dtype=np.int64)
        return pa.table({"query_id": np.concatenate([none, *found_ids]), "item_id": np.concatenate([none, *items]), "score": np.concatenate([none.astype(np.float64), *scores])})

    keys = ("code", "p", "r")
    best = q.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInArrow(search, "query_id long, item_id long, score double")
    return ranked(best, ["query_id"], [F.desc("score"), F.asc("item_id")], k)


def topk_cosine(queries: DataFrame, catalogue: DataFrame, k: int, query_id: str = "query_id", item_id: str = "item_id", vector: str = "vector") -> DataFrame:
    """(query_id, item_id, score, rank): the k most similar vectors of a stated query set against all
    of a catalogue. Blocks of queries meet blocks of the catalogue. Vectors of length zero and nulls
    match nothing; ties go by item id."""
    q, c = _vectors(queries, query_id, vector, "query_id"), _vectors(catalogue, item_id, vector, "item_id")
    return _best(q.withColumn("code", F.lit(0)), c.withColumn("code", F.lit(0)), k)  # the query set, block by block


def plane_codes(v: Column, bits: int, seed: int = 1) -> Column:
    """On which sides of ``bits`` random hyperplanes a vector lies, as the bits of a number."""

    @F.arrow_udf(T.IntegerType())
    def codes(vectors: pa.Array) -> pa.Array:
        sizes = np.diff(vectors.offsets.to_numpy())
        out = np.zeros(len(vectors), dtype=np.int32)
        for n in set(sizes.tolist()) - {0}:  # one length, as a rule
            rows = np.flatnonzero(sizes == n)
            planes = np.random.default_rng([seed, n]).standard_normal((n, bits))
            side = vectors.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), n) @ planes > 0
            out[rows] = side @ (1 << np.arange(bits))
        return pa.array(out)

    return codes(v)


def topk_bucketed(queries: DataFrame, catalogue: DataFrame, k: int, query_id: str = "query_id", item_id: str = "item_id", vector: str = "vector", bits: int = PLANES, radius: int = RADIUS, seed: int = 1) -> DataFrame:
    """``topk_cosine`` over the buckets near each query only. A bucket holds the vectors on the same
    sides of random hyperplanes; a query probes those that differ from its own in up to ``radius``
    of the ``bits`` planes. What it misses lies in farther buckets; with ``radius = bits`` it misses
    nothing, and ``topk_cosine`` is the exact way without buckets. Every vector is in the index, and
    a bucket that holds very many is dealt out in blocks."""
    q = _vectors(queries, query_id, vector, "query_id").withColumn("code", plane_codes(F.col("v"), bits, seed))
    c = _vectors(catalogue, item_id, vector, "item_id").withColumn("code", plane_codes(F.col("v"), bits, seed))
    masks = [m for m in range(1 << bits) if m.bit_count() <= radius]
    probes = q.withColumn("code", F.explode(F.transform(F.array(*map(F.lit, masks)), lambda m: F.col("code").bitwiseXOR(m))))
    return _best(probes, c, k)


def match_texts(hits: DataFrame, row: str, text_order: str, label: str, score: str, least: float = 0.55) -> DataFrame:
    """Hits above a threshold, one per row and label: that of the first text, then the best."""
    return ranked(hits.where(F.col(score) >= least), [row, label], [F.asc(text_order), F.desc(score)], 1).drop("rank")


def skill_weight(skill: Column, generic: Sequence[str], context: Mapping[str, float], low: float = 0.3, contained: bool = False) -> Column:
    """Weight of a skill: low for generic ones (equal, or containing and contained), else by context."""
    key = F.lower(skill)
    if contained:
        hit = reduce(Column.__or__, [key.contains(g) | F.lit(g).contains(key) for g in generic], F.lit(False))
    else:
        hit = key.isin(list(generic))
    return first_match([(hit, F.lit(low)), *[(key.contains(w), F.lit(v)) for w, v in context.items()]], F.lit(1.0))


def _dealt(df: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    return df.repartition(parts, *keys) if parts else df


def rank_occupations(skills: DataFrame, links: DataFrame, row: str, skill: str, occupation: str, n: int, parts: int | None = None) -> DataFrame:
    """Occupations of a row's skills: sum of score, link, origin and generic weights; matched skills.
    One shuffle by row serves sums, sets and ranks; ``parts`` are its partitions, for tasks of one size."""
    points = F.col("score") * F.col("link_weight") * F.col("origin_weight") * F.col("generic_weight")
    found = skills.join(links, skill).select(row, occupation, skill, points.cast("decimal(18,6)").alias("points"))
    dealt = found.repartition(parts, row) if parts else found.repartition(row)
    hits = dealt.groupBy(row, occupation).agg(F.sum("points").cast("double").alias("score"), F.sort_array(F.collect_set(skill)).alias("set"))
    best = ranked(hits, [row], [F.desc("score"), F.asc(occupation)], n)
    return best.select(row, occupation, "score", F.array_join("set", ",").alias("matched"), F.size("set").cast("long").alias("n_matched"), "rank")


def combine_candidates(a: DataFrame, b: DataFrame, row: str, label: str, weight: float = 0.6, parts: int | None = None) -> DataFrame:
    """Two candidate lists as one: the first one's scores are scaled by the row's highest. They meet in
    ``parts`` partitions."""
    scaled = a.withColumn("sa", F.try_divide("score", F.max("score").over(Window.partitionBy(row)))).select(row, label, "sa")
    both = _dealt(scaled, parts, row, label).join(_dealt(b.select(row, label, F.col("score").alias("sb")), parts, row, label), [row, label], "full")
    return both.select(row, label, half_up(weight * F.coalesce("sa", F.lit(0.0)) + (1 - weight) * F.coalesce("sb", F.lit(0.0)), 9).alias("score"))


def penalize(candidates: DataFrame, row: str, label: str, code: str, prefixes: Mapping[str, float], level: Column, parts: int | None = None) -> DataFrame:
    """Scores less the penalties of their code's prefix and of the level, floored at 0, ranked again in
    ``parts`` partitions."""
    by_code = first_match([(F.col(code).startswith(p), F.lit(v)) for p, v in prefixes.items()], F.lit(0.0))
    out = candidates.withColumn("score", half_up(F.greatest(F.lit(0.0), F.col("score") - by_code - level), 9))
    return ranked(_dealt(out, parts, row), [row], [F.desc("score"), F.asc(label)], 2**31)


def dictionary_match(df: DataFrame, key: str, title: str, entries: DataFrame) -> DataFrame:
    """Code of the first dictionary entry (place, term, context, code) with its term in the title and
    its context word, if it has one, too; codes that aren't of four digits don't count. Distinct titles meet
    the first entry of each term and context, so repeats of either cost once."""
    e = entries.where(F.col("code").rlike("^[0-9]{4}$")).select("place", F.lower("term").alias("term"), F.lower("context").alias("context"), "code")
    e = e.groupBy("term", "context").agg(F.min(F.struct("place", "code")).alias("entry"))  # the others are never first
    titles = df.select(F.lower(title).alias("__t")).distinct()
    found = containing(titles, "__t", F.col("__t"), e, "term")
    hits = found.join(bounded(e), "term").where(F.col("context").isNull() | F.col("text").contains(F.col("context")))
    first = checkpointed(hits.groupBy("__t").agg(F.min(F.struct(F.col("context").isNull().alias("plain"), "entry")).alias("hit")))
    rows = df.select(key, F.lower(title).alias("__t")).join(bounded(first), "__t")
    return rows.groupBy(key).agg(F.min("hit").alias("hit")).select(key, F.col("hit.entry.code").alias("code"))


def business_rule(title: Column, tasks: Column, all_of: Sequence[str] = (), any_of: Sequence[str] = (), tasks_any: Sequence[str] = (), exclude: Sequence[str] = ()) -> Column:
    """Condition of a rule: all words, any word, any task word; none excluded in the raw title."""
    parts = [F.lower(title).contains(w) for w in all_of]
    if any_of:
        parts.append(reduce(Column.__or__, [F.lower(title).contains(w) for w in any_of]))
    if tasks_any:
        parts.append(reduce(Column.__or__, [F.lower(tasks).contains(w) for w in tasks_any]))
    parts += [~F.lower(title).contains(w) for w in exclude]
    return F.coalesce(reduce(Column.__and__, parts, F.lit(True)), F.lit(False))


def apply_rules(df: DataFrame, rules: Sequence[tuple[int, str, Column, str]], catalogue: DataFrame, label: str) -> DataFrame:
    """(rule, label) of the rule (priority, id, condition, label) with the lowest priority number
    whose label is in the catalogue; rows without one keep nulls."""
    wanted = [r[3] for r in rules]
    known = {r[0] for r in catalogue.where(F.col(label).isin(wanted)).select(label).distinct().collect()}  # at most a row a rule
    usable = sorted((r for r in rules if r[3] in known), key=lambda r: (r[0], r[1]))
    hit = first_match([(c, F.struct(F.lit(i).alias("rule"), F.lit(to).alias("rule_label"))) for _, i, c, to in usable])
    out = df.withColumn("__h", hit if usable else F.lit(None).cast("struct<rule:string,rule_label:string>"))
    return out.select(*df.columns, "__h.*")


def resolve_label(df: DataFrame, label: str, catalogue: DataFrame, name: str, code: str) -> DataFrame:
    """Catalogue row of a label: equal without case, else the shortest name that begins with it."""
    c = catalogue.select(F.lower(name).alias("__n"), F.col(name).alias("resolved"), code)
    exact = df.withColumn("__l", F.lower(label)).join(bounded(c.groupBy("__n").agg(F.min("resolved").alias("resolved"), F.min(code).alias(code))), F.col("__l") == F.col("__n"), "left").drop("__n")
    missed = exact.where("resolved IS NULL AND __l IS NOT NULL").select("__l").distinct()
    near = begun_by(missed, "__l", c, "__n", F.struct(F.col("resolved").alias("__r"), F.col(code).alias("__c")), F.struct(F.length("__n"), "__n", "resolved", code))
    near = near.withColumnRenamed("best", "__m")
    out = exact.join(near, "__l", "left")
    return out.withColumn("resolved", F.coalesce("resolved", "__m.__r")).withColumn(code, F.coalesce(F.col(code), F.col("__m.__c"))).drop("__l", "__m")


def decide(df: DataFrame, sources: Sequence[tuple[str, str]], other: str) -> DataFrame:
    """Code and method of the first source (method, code column) that has one; whether its four
    digits agree with another column's."""
    method = first_match([(F.col(c).isNotNull(), F.lit(m)) for m, c in sources], F.lit("none"))
    code = F.coalesce(*[F.col(c) for _, c in sources])
    agrees = F.substring(code.cast("string"), 1, 4) == F.substring(F.col(other).cast("string"), 1, 4)
    return df.withColumns({"method": method, "decided": code, "agrees": F.coalesce(agrees, F.lit(False))})


def prefix_filter(candidates: DataFrame, group: str, code: str, allowed: Mapping[str, Sequence[str]]) -> DataFrame:
    """Candidates whose code begins with a prefix that their group allows; other groups pass."""
    tests = [(F.col(group) == g, reduce(Column.__or__, [F.col(code).startswith(p) for p in ps], F.lit(False))) for g, ps in allowed.items()]
    return candidates.where(first_match(tests, F.lit(True)))


def adjust_scores(df: DataFrame, boosts: DataFrame, keys: Sequence[str], code: str, wanted: str) -> DataFrame:
    """Scores with the boosts and penalties of a table and of code agreement (equal, same group,
    different), clamped to [0, 1]."""
    total = bounded(boosts.groupBy(*keys).agg(half_up(F.sum("boost"), 6).alias("__b")))
    a, b = F.col(code).cast("string"), F.col(wanted).cast("string")
    agreement = F.when(a.isNull() | b.isNull(), 0.0).when(a == b, 0.2).when(F.substring(a, 1, 1) == F.substring(b, 1, 1), 0.05).otherwise(-0.1)
    out = df.join(total, list(keys), "left")
    return out.withColumn("score", half_up(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score") + F.coalesce("__b", F.lit(0.0)) + agreement)), 4)).drop("__b")


def multicriteria(df: DataFrame, title: str, skills: str, text: str, filled: Column) -> DataFrame:
    """Weighted score with weights by extraction coverage, and its status. Skills count for more
    where more was extracted."""
    s = [F.col(c) for c in (title, skills, text)]
    mixes = ((0.6, (0.4, 0.4, 0.2)), (0.3, (0.5, 0.3, 0.2)), (-1.0, (0.7, 0.1, 0.2)))
    score = first_match([(filled >= least, reduce(Column.__add__, [a * F.lit(w) for a, w in zip(s, ws, strict=True)])) for least, ws in mixes])
    status = F.when(F.col("final") >= 0.6, "confirmed").when(F.col("final") >= 0.4, "review").otherwise("rejected")
    return df.withColumn("final", half_up(score, 4)).withColumn("status", status)


def fuzzy_match(df: DataFrame, key: str, title: str, catalogue: DataFrame, name: str, least: float) -> DataFrame:
    """Best catalogue name of a title: edit likeness .6 and word overlap .4. Candidates are names
    that share a word, and names that reach the least score by edit likeness alone. Distinct titles
    are compared, so frequent ones cost once."""
    titles = df.select(norm_key(F.col(title)).alias("__t")).distinct()
    names = catalogue.select(F.col(name).alias("name"), norm_key(F.col(name)).alias("__n")).distinct()
    words = lambda d, c: d.select("*", F.explode(token_set(F.col(c))).alias("__w"))
    pairs = words(titles, "__t").join(words(names, "__n"), "__w").select("__t", "__n", "name")
    alone = (least - 0.00005) / 0.6  # scores are rounded to four places
    if alone <= 1:
        pairs = pairs.union(like_texts(titles, names, alone))
    pairs = pairs.distinct()
    score = half_up(0.6 * similarity(F.col("__t"), F.col("__n")) + 0.4 * jaccard(token_set(F.col("__t")), token_set(F.col("__n"))), 4)
    best = pairs.withColumn("score", score).where(F.col("score") >= least)
    best = ranked(best, ["__t"], [F.desc("score"), F.asc("name")], 1).select("__t", "name", "score")
    return df.select(key, title, norm_key(F.col(title)).alias("__t")).join(best, "__t", "left").drop("__t")


def skill_overlap(df: DataFrame, row: str, skill: str, catalogue: DataFrame, occupation: str, catalogue_skill: str, least: float = 0.8) -> DataFrame:
    """Share of an occupation's skills that are like a row's. Distinct skills are compared once, and
    only those that ``like_texts`` proves to hold all pairs."""
    mine = df.select(row, norm_key(F.col(skill)).alias("__s")).distinct()
    theirs = catalogue.select(occupation, norm_key(F.col(catalogue_skill)).alias("__c")).distinct()
    skills, known = mine.select(F.col("__s").alias("__t")).distinct(), theirs.select(F.col("__c").alias("__n"), F.col("__c").alias("name")).distinct()
    empty = skills.where("__t = ''").join(known.where("__n = ''"), F.col("__t") == F.col("__n"))  # two empty texts are alike
    like = like_texts(skills, known, least).select("__t", "__n").where(similarity(F.col("__t"), F.col("__n")) >= least)
    like = like.union(empty.select("__t", "__n")).distinct().withColumnsRenamed({"__t": "__s", "__n": "__c"})
    size = theirs.groupBy(occupation).agg(F.count("*").alias("size"))
    hits = mine.join(like, "__s").join(theirs, "__c").groupBy(row, occupation).agg(F.count_distinct("__c").alias("found"))
    return hits.join(size, occupation).withColumn("share_pct", percent(F.col("found"), F.col("size")))


def confidence_tier(title_score: Column, share_pct: Column) -> Column:
    """Confidence by title score and skill share."""
    return F.when((title_score >= 0.8) & (share_pct >= 50), "high").when((title_score >= 0.6) | (share_pct >= 50), "medium").otherwise("low")


def cascade(fuzzy: DataFrame, vector: DataFrame, key: str, least: float = 0.8) -> DataFrame:
    """Fuzzy match if good enough, else the vector match; agreement raises confidence."""
    both = fuzzy.select(key, F.col("name").alias("f"), F.col("score").alias("fs")).join(vector.select(key, F.col("name").alias("v"), F.col("score").alias("vs")), key, "full")
    good = F.col("fs") >= least
    name = F.when(good, F.col("f")).otherwise(F.coalesce("v", "f"))
    method = F.when(good, "fuzzy").when(F.col("v").isNotNull(), "vector").when(F.col("f").isNotNull(), "weak").otherwise("none")
    raised = F.when(F.coalesce(F.col("f") == F.col("v"), F.lit(False)), 0.1).otherwise(0.0)
    score = half_up(F.least(F.lit(1.0), F.when(good, F.col("fs")).otherwise(F.coalesce("vs", "fs")) + raised), 4)
    return both.select(key, name.alias("name"), method.alias("method"), score.alias("score"))


def coded_ancestor(nodes: DataFrame, node: str, parent: str, code: str, depth: int = 10) -> DataFrame:
    """Nearest node upward, itself included, that has a code, and the code's level-1 and level-2 parts.
    Links that lead back to a node passed before end with the depth. By doubling: each round looks as
    far again as all before, so a depth of 10 takes four joins."""
    steps = F.when(F.col(code).isNotNull(), F.lit(0).cast("long")).alias("steps")
    seen = nodes.select(F.col(node).alias("__node"), F.col(code).alias("found"), steps, F.col(parent).alias("__next"))
    reach = 1
    while reach <= depth:
        far = seen.select(F.col("__node").alias("__next"), "found", (F.col("steps") + reach).alias("steps"), F.col("__next").alias("__then"))
        waits = F.col("found").isNull() & F.col("__next").isNotNull()
        further = seen.where(waits).select("__node", "__next").join(far, "__next", "left").select("__node", "found", "steps", F.col("__then").alias("__next"))
        seen = checkpointed(seen.where(~waits).union(further))
        reach *= 2
    done = seen.where(F.col("steps") <= depth).select(F.col("__node").alias(node), "found", "steps")
    text = F.col("found").cast("string")
    return nodes.select(node).join(done, node, "left").withColumns({"level_1": F.substring(text, 1, 1), "level_2": F.substring(text, 1, 2)})


def categorize_skills(df: DataFrame, uri: str, label: str, by_uri: DataFrame, by_label: DataFrame, words: Sequence[tuple[str, str]], default: str) -> DataFrame:
    """Category of a skill by uri, else by label, else by keyword, else a default, with the way."""
    u = bounded(by_uri.select(F.col("key").alias(uri), F.col("category").alias("__u")).dropDuplicates([uri]))
    l = bounded(by_label.select(F.lower("key").alias("__l"), F.col("category").alias("__c")).dropDuplicates(["__l"]))
    rows = df.join(u, uri, "left").withColumn("__k", F.lower(label)).join(l, F.col("__k") == F.col("__l"), "left")
    by_word = first_match([(F.col("__k").contains(w), F.lit(c)) for w, c in words])
    way = F.when(F.col("__u").isNotNull(), "uri").when(F.col("__c").isNotNull(), "label").when(by_word.isNotNull(), "keyword").otherwise("default")
    return rows.withColumn("category", F.coalesce("__u", "__c", by_word, F.lit(default))).withColumn("way", way).drop("__u", "__l", "__k", "__c")


def roll_up(links: DataFrame, occupations: DataFrame, occupation: str, code: str, skill: str) -> DataFrame:
    """Distinct skills per code."""
    rows = links.join(occupations.select(occupation, code), occupation).groupBy(code).agg(F.collect_set(skill).alias("s"), F.count_distinct(occupation).alias("occupations"))
    return rows.select(code, "occupations", F.size("s").cast("long").alias("skills"))


def skill_gap(parsed: DataFrame, catalogue: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows with parsed skills, catalogue skills, both or neither."""
    p, c = (x.select(key).distinct().withColumn(n, F.lit(True)) for x, n in ((parsed, "p"), (catalogue, "c")))
    kind = F.when(F.expr("p AND c"), "both").when(F.col("p"), "parsed").when(F.col("c"), "catalogue").otherwise("neither")
    return rows.join(p, key, "left").join(c, key, "left").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def pending(df: DataFrame, matches: DataFrame, key: str, validated: Column, force: bool = False) -> DataFrame:
    """Rows to match: those without a match, or all if forced, but never validated ones."""
    return df.join(matches.where(validated) if force else matches, key, "left_anti")


def method_agreement(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows of two methods by confidence in each, with how many agree in label and in code."""
    x, y = (df.select(key, *[F.col(c).alias(f"{c}_{n}") for c in ("label", "code", "confidence")]) for df, n in ((a, "a"), (b, "b")))
    return x.join(y, key).groupBy("confidence_a", "confidence_b").agg(F.count("*").alias("n"), F.count_if(F.expr("label_a = label_b")).alias("same_label"), F.count_if(F.expr("code_a = code_b")).alias("same_code"))


def save_matches(results: VersionedTable, history: VersionedTable, details: VersionedTable, matches: DataFrame, skills: DataFrame, key: str, run: str, number: int) -> None:
    """Keeps what a matching run has found: the latest result of each row, every result by run, and
    the skills of each row's latest result, all of which replace those before. A run that is saved
    again, also after a failure between the three, changes nothing that it has saved."""
    matches = checkpointed(matches)
    upsert_into(results, matches, [key], run, number=number)
    append_into(history, matches, run, number=number)
    replace_into(details, skills, [key], number=number)
