"""Posting lifecycle: appearance, delisting, time on the market, change history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.functions.columns import half_up


def detect_delisted(store: DataFrame, scrape: DataFrame, key: str, active: Column) -> DataFrame:
    """Active rows with their status: delisted if the scrape lacks them, else confirmed."""
    found = scrape.select(key).distinct().withColumn("__found", F.lit(True))
    rows = store.where(active).join(found, key, "left")
    return rows.withColumn("status", F.when(F.col("__found"), "confirmed").otherwise("delisted")).drop("__found")


def apply_scrape(store: DataFrame, scrape: DataFrame, key: str, ts: str) -> DataFrame:
    """The store after a scrape, in one pass: rows found again are active, seen now and once more;
    active rows not found are delisted now; new keys are appended."""
    found = scrape.select(key).distinct().withColumn("__found", F.lit(True))
    now, seen, gone = F.lit(ts), F.col("__found").isNotNull(), F.col("__found").isNull() & (F.col("state") == "active")
    rows = store.join(found, key, "full")
    return rows.select(
        key,
        F.when(seen, "active").when(gone, "delisted").otherwise(F.col("state")).alias("state"),
        F.coalesce("first_seen", now).alias("first_seen"),
        F.when(seen, now).otherwise(F.col("last_seen")).alias("last_seen"),
        F.when(gone, now).when(seen, F.lit(None)).otherwise(F.col("delisted_on")).alias("delisted_on"),
        (F.coalesce("times_seen", F.lit(0)) + F.when(seen, 1).otherwise(0)).alias("times_seen"),
    )


def permanence(df: DataFrame, start: str, end: str, as_of: str, low: int = 7, mid: int = 30) -> DataFrame:
    """Whole days on the market, to delisting or ``as_of``, and their band."""
    days = F.datediff(F.coalesce(F.to_date(end), F.to_date(F.lit(as_of))), F.to_date(start)).cast("long")
    band = F.when(days < low, "low").when(days <= mid, "mid").when(days.isNotNull(), "high")
    return df.withColumn("days", days).withColumn("band", band)


def permanence_stats(df: DataFrame, *dims: str) -> DataFrame:
    """Rows, mean, least and most days, over all rows or per value of columns."""
    return df.groupBy(*dims).agg(F.count("*").alias("n"), half_up(F.avg("days"), 4).alias("mean"), F.min("days").alias("least"), F.max("days").alias("most"))


def permanence_histogram(df: DataFrame, edges: Sequence[int] = (7, 15, 30, 60, 90)) -> DataFrame:
    """Rows per bin of days; an edge belongs to the bin below it."""
    d = F.col("days")
    name = F.when(d.isNull(), None)
    for a, b in zip((None, *edges), edges, strict=False):
        name = name.when(d <= b, f"<={b}" if a is None else f"{a + 1}-{b}")
    return df.groupBy(name.otherwise(f">{edges[-1]}").alias("bin")).agg(F.count("*").alias("n"))


def permanence_by(df: DataFrame, dim: str, least: int) -> DataFrame:
    """Permanence of values with enough rows, with rows in each band."""
    out = df.groupBy(dim).agg(
        F.count("*").alias("n"), half_up(F.avg("days"), 4).alias("mean"), *[F.count_if(F.col("band") == b).alias(b) for b in ("low", "mid", "high")]
    )
    return out.where(F.col("n") >= least)


def permanence_extremes(df: DataFrame, key: str, n: int, longest: bool = True) -> DataFrame:
    """The rows that stayed longest or shortest; ties by key, rows without days left out."""
    return df.where("days IS NOT NULL").orderBy(F.desc("days") if longest else F.asc("days"), key).limit(n)


def diff_snapshots(a: DataFrame, b: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Changed fields from one snapshot to the next: insert, update or delete, old and new as text."""
    old = a.select(key, F.struct(*fields).alias("o"), F.lit(True).alias("__a"))
    new = b.select(key, F.struct(*fields).alias("n"), F.lit(True).alias("__b"))
    both = old.join(new, key, "full")
    kind = F.when(F.col("__a").isNull(), "insert").when(F.col("__b").isNull(), "delete").otherwise("update")
    changes = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"o.{f}").cast("string").alias("old"), F.col(f"n.{f}").cast("string").alias("new")) for f in fields])
    rows = both.select(key, kind.alias("change"), F.explode(changes).alias("c"))
    return rows.where(~F.col("c.old").eqNullSafe(F.col("c.new"))).select(key, "change", "c.*")


def skill_counters(links: DataFrame, skill: str, day: str, mandatory: Column, as_of: str, days: int = 30) -> DataFrame:
    """Links, first and last day, and recent demand with its mandatory part per skill."""
    d, now = F.to_date(day), F.to_date(F.lit(as_of))
    recent = (d > F.date_sub(now, days)) & (d <= now)
    return links.groupBy(skill).agg(
        F.count("*").alias("n"),
        F.date_format(F.min(d), "yyyy-MM-dd").alias("first_seen"),
        F.date_format(F.max(d), "yyyy-MM-dd").alias("last_seen"),
        F.count_if(recent).alias("recent"),
        F.count_if(recent & mandatory).alias("recent_mandatory"),
    )
