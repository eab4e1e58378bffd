"""The k-th smallest value of each group, exactly, without sorting a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacantia.operators.terms import bounded
from vacantia.sources.scratch import checkpointed

#: Rows of a group that are sorted in one task, and ranges that a larger group is counted by.
LIMIT, RANGES = 100_000, 64


def kth(df: DataFrame, groups: Sequence[str], value: Column, k: Column, limit: int = LIMIT) -> DataFrame:
    """(groups, ``kth``): of each group the value at place ``k`` from 0, which is the same for all rows
    of a group; groups that have no such place are left out, and so are null values.

    Groups of more than ``limit`` rows are counted by ranges between approximate quantiles, each
    quantile itself being a range, and only the rows of the range that holds the place go on, with
    their place in it. A round leaves a few hundredths of a group at most; counts are made before
    rows are shuffled, so no task sees a group whole.
    """
    g = F.struct(*groups).alias("g")
    rest = df.select(g, value.alias("v"), k.cast("long").alias("k")).where("v IS NOT NULL")
    while True:
        sizes = rest.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.first("k").alias("k"))
        sizes = checkpointed(sizes.where("k >= 0 AND k < n"))
        if (sizes.where("low < high").agg(F.max("n")).first()[0] or 0) <= limit:
            break
        edges = rest.groupBy("g").agg(F.array_distinct(F.percentile_approx("v", [i / RANGES for i in range(1, RANGES)], 1_000)).alias("edges"))
        v = F.col("v")
        place = F.size(F.filter("edges", lambda e: e < v)) + F.size(F.filter("edges", lambda e: e <= v))
        placed = rest.join(bounded(edges), "g").withColumn("range", place)
        counts = placed.groupBy("g", "range").agg(F.count("*").alias("n"), F.first("k").alias("k"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy("g").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        chosen = counts.withColumn("before", before).where("before <= k AND k < before + n").select("g", "range", "before")
        rest = checkpointed(placed.join(bounded(chosen), ["g", "range"]).select("g", "v", (F.col("k") - F.col("before")).alias("k")))
    several = rest.join(bounded(sizes.where("low < high").select("g")), "g", "left_semi")
    found = several.groupBy("g").agg(F.sort_array(F.collect_list("v")).alias("vs"), F.first("k").alias("k")).select("g", F.get("vs", F.col("k").cast("int")).alias("kth"))
    return found.union(sizes.where("low = high").select("g", F.col("low").alias("kth"))).select("g.*", "kth")
