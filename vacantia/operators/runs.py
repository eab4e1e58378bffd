"""Comparison of runs, and metrics of learning over batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacantia.functions.columns import half_up, percent


def compare_metrics(runs: DataFrame, run: str, metric: str, value: str, a, b) -> DataFrame:
    """Each metric in two runs with its change; a metric that one run lacks is null there."""
    out = runs.where(F.col(run).isin(a, b)).groupBy(metric).agg(F.max(F.when(F.col(run) == a, F.col(value))).alias("a"), F.max(F.when(F.col(run) == b, F.col(value))).alias("b"))
    return out.withColumn("delta", F.col("b") - F.col("a")).withColumn("delta_pct", percent(F.col("b") - F.col("a"), F.col("a")))


def compare_ids(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Ids in both runs, only in the first, only in the second."""
    both = a.select(key).distinct().withColumn("a", F.lit(1)).join(b.select(key).distinct().withColumn("b", F.lit(1)), key, "full")
    return both.agg(F.count_if(F.expr("a = 1 AND b = 1")).alias("both"), F.count_if(F.expr("b IS NULL")).alias("only_a"), F.count_if(F.expr("a IS NULL")).alias("only_b"))


def compare_codes(a: DataFrame, b: DataFrame, key: str, code: str) -> DataFrame:
    """Rows of both runs whose code changed; null is a value."""
    rows = a.select(key, F.col(code).alias("code_a")).join(b.select(key, F.col(code).alias("code_b")), key)
    return rows.where(~F.col("code_a").eqNullSafe(F.col("code_b")))


def batch_metrics(batches: DataFrame, rows: str, rules: str, covered: str, limit: float = 5.0) -> DataFrame:
    """Learning rate (new rules in percent of rows), coverage, and whether the batch has converged."""
    out = batches.withColumn("learning_rate", percent(F.col(rules), F.col(rows))).withColumn("coverage_pct", percent(F.col(covered), F.col(rows)))
    return out.withColumn("converged", F.coalesce(F.col("learning_rate") < limit, F.lit(False)))


def convergence(batches: DataFrame, order: str, rate: str, last: int = 5) -> DataFrame:
    """Batches, mean, least rate and its batch, and the change of the rate over the last ones."""
    recent = batches.orderBy(F.desc(order)).limit(last)
    trend = recent.agg((F.max_by(rate, order) - F.min_by(rate, order)).alias("trend"))
    exact = F.col(rate).cast("decimal(18,4)")
    total = batches.agg(F.count("*").alias("n"), (F.sum(exact).cast("double") / F.count(exact)).alias("mean"), F.min(rate).alias("least"), F.min_by(F.col(order), F.struct(rate, order)).alias("best"))
    return total.crossJoin(trend)


def cumulative(batches: DataFrame, order: str, *cols: str) -> DataFrame:
    """Running totals of columns over the batches."""
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return batches.withColumns({f"total_{c}": F.sum(c).over(w) for c in cols})


def runs_daily(runs: DataFrame, ts: str, ok: Column, value: str) -> DataFrame:
    """Runs, successful runs and mean value per day."""
    return runs.groupBy(F.date_format(ts, "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("runs"), F.count_if(ok).alias("ok"), half_up(F.avg(value), 4).alias("mean"))


def run_delta(runs: DataFrame, run: str, previous: str, *metrics: str) -> DataFrame:
    """Change of metrics to the run that each run names as its predecessor; null without one."""
    before = runs.select(F.col(run).alias(previous), *[F.col(m).alias(f"{m}_before") for m in metrics])
    return runs.join(before, previous, "left").select(run, previous, *metrics, *[(F.col(m) - F.col(f"{m}_before")).alias(f"{m}_delta") for m in metrics])


def phase_coverage(a: DataFrame, b: DataFrame, fields: Sequence[str], by: str | None = None) -> DataFrame:
    """Share of filled values per field (and group) in two phases."""

    def filled(df: DataFrame, name: str) -> DataFrame:
        flags = F.array(*[F.struct(F.lit(f).alias("field"), (F.trim(F.coalesce(F.col(f).cast("string"), F.lit(""))) != "").alias("ok")) for f in fields])
        keys = ["field"] if by is None else [by, "field"]
        rows = df.select(*([] if by is None else [by]), F.explode(flags).alias("x")).select(*([] if by is None else [by]), "x.*")
        return rows.groupBy(*keys).agg(percent(F.count_if("ok"), F.count("*")).alias(name))

    keys = ["field"] if by is None else [by, "field"]
    return filled(a, "pct_a").join(filled(b, "pct_b"), keys, "full").withColumn("delta", half_up(F.col("pct_b") - F.col("pct_a"), 2))


def phase_changes(a: DataFrame, b: DataFrame, key: str, score: str) -> DataFrame:
    """Rows of both phases that improved, got worse or stayed."""
    rows = a.select(key, F.col(score).alias("a")).join(b.select(key, F.col(score).alias("b")), key)
    return rows.agg(F.count_if(F.expr("b > a")).alias("improved"), F.count_if(F.expr("b < a")).alias("worse"), F.count_if(F.expr("b = a")).alias("same"))


def compare_experiments(df: DataFrame, experiment: str, component: str, quality: str, seconds: str, a, b, tolerance: float) -> DataFrame:
    """Per component: quality and time of two experiments, speedup, and whether quality held."""
    out = df.where(F.col(experiment).isin(a, b)).groupBy(component).agg(
        *[half_up(F.avg(F.when(F.col(experiment) == x, F.col(m))), 4).alias(f"{m}_{n}") for m in (quality, seconds) for n, x in (("a", a), ("b", b))]
    )
    delta = half_up(F.col(f"{quality}_b") - F.col(f"{quality}_a"), 4)
    return out.withColumns({"delta": delta, "speedup": half_up(F.try_divide(F.col(f"{seconds}_a"), F.col(f"{seconds}_b")), 4), "go": delta >= -tolerance})
