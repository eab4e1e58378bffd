"""Reporting aggregations and windows.

All operators take DataFrames and return one; ``as_of`` stands for the current time. Grouping runs
on partial aggregates, and windows without a partition only see rows that are already aggregated.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacantia.functions.columns import half_up, percent
from vacantia.operators.selection import kth
from vacantia.operators.terms import bounded
from vacantia.sources.scratch import checkpointed


def kpis(df: DataFrame, distinct: Mapping[str, str]) -> DataFrame:
    """Rows, and distinct values of a column for each name."""
    return df.agg(F.count("*").alias("n"), *[F.count_distinct(c).alias(name) for name, c in distinct.items()])


def share(df: DataFrame, dim: str, unknown: str = "unknown") -> DataFrame:
    """Rows per value with their share of all rows in percent; null counts as ``unknown``."""
    counts = df.groupBy(F.coalesce(F.col(dim), F.lit(unknown)).alias(dim)).agg(F.count("*").alias("n"))
    return counts.withColumn("pct", percent(F.col("n"), F.sum("n").over(Window.partitionBy())))


def top_n(df: DataFrame, dim: str, n: int) -> DataFrame:
    """The most frequent values; ties by value."""
    return df.groupBy(dim).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc(dim)).limit(n)


def code_tree(df: DataFrame, major: str, code: str) -> DataFrame:
    """Counts of major groups (level 1, null code) and of their codes (level 2)."""
    rolled = df.rollup(major, code).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    return rolled.where("g < 3").select(F.when(F.col("g") == 1, 1).otherwise(2).cast("long").alias("level"), major, code, "n")


def banded(df: DataFrame, bands: Mapping[str, Sequence[tuple[str, Column]]]) -> DataFrame:
    """Several banded distributions in one pass: dimension, band, its place in the domain, rows.

    ``bands``: for each dimension its bands in order; the first condition that holds counts.
    """
    structs = []
    for dimension, rules in bands.items():
        picked = F.coalesce(*[F.when(c, F.struct(F.lit(i).cast("long").alias("place"), F.lit(b).alias("band"))) for i, (b, c) in enumerate(rules)])
        structs.append(F.struct(F.lit(dimension).alias("dimension"), picked.alias("b")))
    rows = df.select(F.explode(F.array(*structs)).alias("x")).where("x.b IS NOT NULL")
    return rows.groupBy("x.dimension", "x.b.place", "x.b.band").agg(F.count("*").alias("n"))


def list_counts(df: DataFrame, col: str, sep: str = ",", n: int | None = None) -> DataFrame:
    """Counts of the trimmed lower-case items of a delimited list column."""
    items = F.filter(F.transform(F.split(F.col(col), sep), lambda x: F.lower(F.trim(x))), lambda x: x != "")
    counts = df.select(F.explode(items).alias("item")).groupBy("item").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "item").limit(n) if n else counts


def category_shares(rows: DataFrame, ids: DataFrame, key: str, category: str, flag: Column) -> DataFrame:
    """Shares of categories among the rows of some ids, and how many rows of each are flagged."""
    kept = rows.join(ids.select(key).distinct(), key, "left_semi")
    counts = kept.groupBy(category).agg(F.count("*").alias("n"), F.count_if(flag).alias("flagged"))
    return counts.withColumn("pct", percent(F.col("n"), F.sum("n").over(Window.partitionBy())))


def top_per_group(df: DataFrame, group: str, item: str, n: int) -> DataFrame:
    """The most frequent items of each group, ranked; ties by item."""
    counts = df.groupBy(group, item).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), item)).cast("long")
    return counts.withColumn("rank", rank).where(F.col("rank") <= n)


def matrix(df: DataFrame, row: str, col: str, n: int) -> DataFrame:
    """Zero-filled counts of the most frequent rows against all columns."""
    top = top_n(df, row, n).select(row)
    counts = df.groupBy(row, col).agg(F.count("*").alias("n"))
    keys = top.crossJoin(df.select(col).distinct())  # at most n rows a column value
    return keys.join(counts, [row, col], "left").select(row, col, F.coalesce("n", F.lit(0)).alias("n"))


def page(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page of rows in a fixed order with the number of all rows."""
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).offset(offset).limit(limit).crossJoin(total)


def funnel(postings: DataFrame, done: DataFrame, key: str, day: str, as_of: str, score: str) -> DataFrame:
    """Counts of a pipeline's stages: all, of the day, of the last 7 days, processed, mean score."""
    d, now = F.to_date(day), F.to_date(F.lit(as_of))
    total = postings.agg(
        F.count("*").alias("n"),
        F.count_if(d == now).alias("today"),
        F.count_if((d > F.date_sub(now, 7)) & (d <= now)).alias("last_7_days"),
    )
    processed = postings.join(done, key, "left_semi").agg(F.count_distinct(key).alias("processed"))
    quality = done.agg(half_up(F.avg(score), 4).alias("mean_score"))
    return total.crossJoin(processed).crossJoin(quality).withColumn("processed_pct", percent(F.col("processed"), F.col("n")))


def funnel_daily(stages: Mapping[str, tuple[DataFrame, str, str]], first: str, last: str) -> DataFrame:
    """Distinct rows of each stage per day, on every day of a span. stages: (frame, key, day)."""
    days = F.explode(F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)))).alias("day")
    out = next(iter(stages.values()))[0].sparkSession.range(1).select(days)
    for name, (df, key, day) in stages.items():
        counts = df.groupBy(F.to_date(day).alias("day")).agg(F.count_distinct(key).alias(name))
        out = out.join(counts, "day", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def daily_cumulative(df: DataFrame, day: str) -> DataFrame:
    """Rows per day with the running total."""
    counts = df.groupBy(F.to_date(day).alias("day")).agg(F.count("*").alias("n"))
    return counts.withColumn("total", F.sum("n").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)))


def coverage(df: DataFrame, source: str, ts: str, found: str, reported: str) -> DataFrame:
    """Last reading per source and day: gap to the reported total, coverage and its status."""
    last = F.max_by(F.struct(F.col(found).alias("found"), F.col(reported).alias("reported")), F.col(ts)).alias("r")
    rows = df.groupBy(source, F.to_date(ts).alias("day")).agg(last).select(source, "day", "r.found", "r.reported")
    pct = percent(F.col("found"), F.col("reported"))
    status = F.when(F.col("reported") == 0, "unknown").when(pct >= 95, "complete").when(pct >= 80, "partial").otherwise("low")
    return rows.withColumns({"gap": F.col("reported") - F.col("found"), "pct": pct, "status": status})


def in_demand(rows: DataFrame, occupation: str, score: str, skill: str, place: str, n: int) -> DataFrame:
    """Occupations by rows, with their mean score, distinct skills and sorted list of places."""
    places = F.array_join(F.array_sort(F.collect_set(place)), ", ").alias("places")
    found = rows.groupBy(occupation).agg(F.count("*").alias("n"), half_up(F.avg(score), 2).alias("mean_score"), F.count_distinct(skill).alias("skills"), places)
    return found.orderBy(F.desc("n"), occupation).limit(n)


def skills_top(skills: DataFrame, links: DataFrame, key: str, name: str, kind: str, essential: str, n: int) -> DataFrame:
    """Skills by links, with essential and optional ones; skills without a link stay in the ranking."""
    counts = links.groupBy(key).agg(F.count("*").alias("n"), F.count_if(F.col(kind) == essential).alias("essential"))
    out = skills.select(key, name).join(counts, key, "left").na.fill(0, ["n", "essential"])
    return out.withColumn("optional", F.col("n") - F.col("essential")).orderBy(F.desc("n"), key).limit(n)


def match_quality(df: DataFrame, score: str, high: float, mid: float) -> DataFrame:
    """Score statistics and rows in each band of confidence; null scores are left out."""
    s = F.col(score)
    return df.where(s.isNotNull()).agg(
        F.count("*").alias("n"),
        F.min(s).alias("least"),
        F.max(s).alias("most"),
        half_up(F.percentile(s, 0.5), 4).alias("median"),
        F.count_if(s >= high).alias("high"),
        F.count_if((s >= mid) & (s < high)).alias("mid"),
        F.count_if(s < mid).alias("low"),
    )


def hierarchy_counts(groups: DataFrame, members: DataFrame, key: str, parent: str, name: str, member: str) -> DataFrame:
    """Members of each group, empty groups kept."""
    counts = members.groupBy(F.col(parent).alias(key)).agg(F.count_distinct(member).alias("n"))
    return groups.select(key, name).join(counts, key, "left").na.fill(0, ["n"])


def counts_by(df: DataFrame, *dims: str | Column) -> DataFrame:
    """Rows per combination of values."""
    return df.groupBy(*dims).agg(F.count("*").alias("n"))


def monday_week(day: Column) -> Column:
    """Week of the year with Monday as its first day, days before the first Monday in week 0."""
    return F.floor((F.dayofyear(day) + 6 - F.weekday(day)) / 7)


def sunday_week(day: Column) -> Column:
    """Week of the year with Sunday as its first day, days before the first Sunday in week 0."""
    return F.floor((F.dayofyear(day) + 7 - F.dayofweek(day)) / 7)


def series(df: DataFrame, day: str, value: str, grain: str = "week") -> DataFrame:
    """Rows, mean, median, least and most of a value per day, week of the year or month."""
    d = F.to_date(day)
    keys = {"day": F.date_format(d, "yyyy-MM-dd"), "week": F.concat_ws("-W", F.date_format(d, "yyyy"), F.lpad(sunday_week(d).cast("string"), 2, "0")), "month": F.date_format(d, "yyyy-MM")}
    v = F.col(value)
    return df.groupBy(keys[grain].alias("period")).agg(
        F.count("*").alias("n"), (F.sum(v).cast("double") / F.count(v)).alias("mean"), F.median(v).alias("median"), F.min(v).alias("least"), F.max(v).alias("most")
    )


def heatmap(df: DataFrame, day: str, months: Sequence[int] = tuple(range(1, 13))) -> DataFrame:
    """Rows by weekday (Monday is 0) and month."""
    d = F.to_date(day)
    counts = df.select(F.weekday(d).cast("long").alias("weekday"), F.month(d).alias("m")).groupBy("weekday").pivot("m", list(months)).count()
    return counts.na.fill(0).select("weekday", *[F.col(str(m)).alias(f"m{m:02d}") for m in months])


def moving_avg(df: DataFrame, order: str, value: str, rows: int = 7) -> DataFrame:
    """Mean over the last rows that are present, null until there are so many."""
    w = Window.orderBy(order).rowsBetween(1 - rows, 0)
    return df.withColumn("moving_avg", F.when(F.count("*").over(w) == rows, half_up(F.avg(value).over(w), 4)))


def month_over_month(df: DataFrame, day: str) -> DataFrame:
    """Rows per month and their change on the month before in percent."""
    counts = df.groupBy(F.date_format(day, "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))
    before = F.lag("n").over(Window.orderBy("month"))
    return counts.withColumn("change_pct", percent(F.col("n") - before, before))


def keyword_yield(df: DataFrame, keyword: str, found: str, new: str, least: int) -> DataFrame:
    """Totals, novelty rate and rows without a result per keyword that was run often enough."""
    out = df.groupBy(keyword).agg(
        F.count("*").alias("runs"), F.sum(found).alias("found"), F.sum(new).alias("new"), F.count_if(F.col(found) == 0).alias("empty_runs")
    )
    return out.where(F.col("runs") >= least).withColumn("novelty_pct", percent(F.col("new"), F.col("found")))


def keyword_overlap(df: DataFrame, keyword: str, key: str) -> DataFrame:
    """Ids that only one keyword finds against shared ones, and the redundancy in percent."""
    pairs = df.select(keyword, key).distinct()
    by_id = pairs.groupBy(key).agg(F.count("*").alias("k"))
    out = pairs.join(by_id, key).groupBy(keyword).agg(F.count("*").alias("ids"), F.count_if(F.col("k") == 1).alias("only_here"))
    return out.withColumns({"shared": F.col("ids") - F.col("only_here"), "redundancy_pct": percent(F.col("ids") - F.col("only_here"), F.col("ids"))})


def overlap_pairs(df: DataFrame, keyword: str, key: str, n: int, parts: int | None = None) -> DataFrame:
    """Pairs of keywords with the most ids in common. Each id yields the pairs of its keywords; rows
    without an id have none in common. Ids are dealt over ``parts`` partitions by buckets, pairs are
    counted by bucket where they are, and only these counts are dealt again."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bucket = F.pmod(F.xxhash64(key), F.lit(64 * parts)).alias("__bucket")
    dealt = df.where(F.col(key).isNotNull()).select(bucket, key, keyword).repartition(parts, "__bucket")
    by_id = dealt.groupBy("__bucket", key).agg(F.array_sort(F.collect_set(keyword)).alias("k"))
    pairs = by_id.select("__bucket", F.posexplode("k").alias("at", "a"), "k").select("__bucket", "a", F.explode(F.slice("k", F.col("at") + 2, F.size("k"))).alias("b"))
    counts = pairs.groupBy("__bucket", "a", "b").agg(F.count("*").alias("n")).repartition(parts, "a", "b")
    return counts.groupBy("a", "b").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "a", "b").limit(n)


def snapshot_metrics(df: DataFrame, status: str, score: str) -> DataFrame:
    """Rows, mean and upper median of the scores of each status; null scores count as rows only."""
    sizes = df.groupBy(status).agg(F.count("*").alias("n"), half_up(F.avg(score), 2).alias("mean"), F.floor(F.count(score) / 2).alias("__k"))
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    places = bounded(sizes.select(F.col(status).alias("__status"), "__k"))
    middle = kth(df.join(places, same(status, "__status")), [status], F.col(score), F.col("__k")).select(F.col(status).alias("__status"), F.col("kth").alias("upper_median"))
    return sizes.drop("__k").join(bounded(middle), same(status, "__status"), "left").drop("__status")


def first_digits(df: DataFrame, code: str) -> DataFrame:
    """Rows by the first digit of a code."""
    return df.groupBy(F.substring(F.col(code).cast("string"), 1, 1).alias("digit")).agg(F.count("*").alias("n"))


def json_stats(df: DataFrame, col: str, field: str, group: str) -> DataFrame:
    """Statistics of a number inside a JSON column per group; rows without it are left out."""
    v = F.get_json_object(F.col(col), f"$.{field}").cast("double")
    rows = df.select(group, v.alias("v")).where("v IS NOT NULL")
    return rows.groupBy(group).agg(F.count("*").alias("n"), half_up(F.avg("v"), 2).alias("mean"), F.min("v").alias("least"), F.max("v").alias("most"))


def stratified_sample(df: DataFrame, key: str, source: str, stratum: str, n: int, floor: int, shares: Mapping[str, float]) -> DataFrame:
    """About n rows: each source by its share with a floor, split over strata by fixed shares.

    Rows of a stratum are taken in order of the hash of their key, so a sample repeats itself. The
    hash of the last row that is taken is found by counts, and only rows with that very hash are
    ranked.
    """
    part = F.coalesce(*[F.when(F.col(stratum) == s, F.lit(p)) for s, p in shares.items()], F.lit(0.0))
    sizes = checkpointed(df.groupBy(source, stratum).agg(F.count("*").alias("size")))
    total = F.sum("size").over(Window.partitionBy(F.lit(0)))  # a row for each source and stratum
    of_source = F.sum("size").over(Window.partitionBy(source))
    quota = F.greatest(F.lit(floor), F.round(of_source * n / total))
    wanted = sizes.withColumn("__n", F.least("size", F.ceil(quota * part))).select(F.col(source).alias("__source"), F.col(stratum).alias("__stratum"), "__n")
    here = F.col(source).eqNullSafe(F.col("__source")) & F.col(stratum).eqNullSafe(F.col("__stratum"))
    rows = df.withColumn("__hash", F.xxhash64(key)).join(bounded(checkpointed(wanted.where("__n > 0"))), here)
    last = kth(rows, ["__source", "__stratum"], F.col("__hash"), F.col("__n") - 1).withColumnsRenamed({"__source": "__s", "__stratum": "__t"})
    rows = rows.join(bounded(last), F.col("__source").eqNullSafe(F.col("__s")) & F.col("__stratum").eqNullSafe(F.col("__t"))).where("__hash <= kth")
    below = rows.where("__hash < kth")
    edge = rows.where("__hash = kth").join(bounded(below.groupBy("__source", "__stratum").agg(F.count("*").alias("__below")).withColumnsRenamed({"__source": "__a", "__stratum": "__b"})), F.col("__source").eqNullSafe(F.col("__a")) & F.col("__stratum").eqNullSafe(F.col("__b")), "left")
    rank = F.row_number().over(Window.partitionBy("__source", "__stratum").orderBy(key))
    edge = edge.withColumn("__rank", rank).where(F.col("__rank") <= F.col("__n") - F.coalesce("__below", F.lit(0)))
    return below.select(df.columns).union(edge.select(df.columns))


def usage(orgs: DataFrame, users: DataFrame, events: DataFrame, org: str, user: str, ts: str, kind: str, as_of: str, kinds: Sequence[str]) -> DataFrame:
    """Users, users active in the last 30 days, events and events of some kinds per organization.
    Both sides are aggregated before the join, so counts don't fan out."""
    recent = F.to_date(ts) > F.date_sub(F.to_date(F.lit(as_of)), 30)
    members = users.groupBy(org).agg(F.count_distinct(user).alias("users"))
    acts = events.join(users.select(org, user).distinct(), user).groupBy(org).agg(
        F.count_distinct(F.when(recent, F.col(user))).alias("active_users"), F.count("*").alias("events"), *[F.count_if(F.col(kind) == k).alias(k) for k in kinds]
    )
    return orgs.select(org).join(members, org, "left").join(acts, org, "left").na.fill(0)


def session_rates(df: DataFrame, source: str, ts: str, ok: Column, as_of: str, days: int = 7) -> DataFrame:
    """Sessions and successes per source in the last days, with their rate."""
    recent = (F.to_date(ts) > F.date_sub(F.to_date(F.lit(as_of)), days)) & (F.to_date(ts) <= F.to_date(F.lit(as_of)))
    out = df.where(recent).groupBy(source).agg(F.count("*").alias("n"), F.count_if(ok).alias("ok"))
    return out.withColumn("rate_pct", percent(F.col("ok"), F.col("n")))


def alerts_recent(df: DataFrame, level: Column, ts: str, as_of: str, hours: int = 24) -> DataFrame:
    """Alerts by level in the last hours."""
    end = F.to_timestamp(F.lit(as_of))
    recent = (F.col(ts).cast("timestamp") > end - F.expr(f"INTERVAL {hours} HOURS")) & (F.col(ts).cast("timestamp") <= end)
    return df.where(recent).groupBy(level.alias("level")).agg(F.count("*").alias("n"))


def keyword_series(df: DataFrame, keywords: Sequence[str], day: Column, *texts: str) -> DataFrame:
    """Rows per day that mention each keyword in one of the texts. Keywords are a short list."""
    body = F.lower(F.concat_ws("\n", *texts))
    hits = F.filter(F.array(*map(F.lit, keywords)), lambda k: body.contains(k))
    return df.select(day.alias("day"), F.explode(hits).alias("keyword")).groupBy("day", "keyword").agg(F.count("*").alias("n"))


def regional_profile(df: DataFrame, region: Column, mode: str, done: Column, occupation: str, n: int) -> tuple[DataFrame, DataFrame]:
    """Share of classified rows per region and mode, and the top occupations of each region."""
    rows = df.withColumn("region", region)
    rates = rows.groupBy("region", mode).agg(F.count("*").alias("n"), F.count_if(done).alias("done"))
    return rates.withColumn("done_pct", percent(F.col("done"), F.col("n"))), top_per_group(rows, "region", occupation, n)
