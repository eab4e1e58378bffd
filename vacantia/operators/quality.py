"""Validation, diagnosis, correction and quality measures."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.functions.columns import half_up, percent
from vacantia.functions.rules import Rule, hits
from vacantia.operators.matching import ranked


def validate(df: DataFrame, key: str, rules: Sequence[Rule], keep: Sequence[str] = ()) -> DataFrame:
    """One row per row and rule that it meets, in one pass over the rows."""
    return df.select(key, *keep, F.explode(hits(rules)).alias("h")).select(key, *keep, "h.*")


def validation_summary(df: DataFrame, errors: DataFrame, key: str) -> DataFrame:
    """Rows, failing and clean rows, errors."""
    bad = errors.agg(F.count_distinct(key).alias("failing"), F.count("*").alias("errors"))
    return df.agg(F.count_distinct(key).alias("n")).crossJoin(bad).withColumn("clean", F.col("n") - F.col("failing"))


def errors_by(errors: DataFrame, *dims: str) -> DataFrame:
    """Errors per type, severity or both."""
    return errors.groupBy(*dims).agg(F.count("*").alias("n"))


def diagnose(errors: DataFrame, patterns: Sequence[tuple[str, Column | None, str]], fallback: str = "review by hand") -> DataFrame:
    """Diagnosis of the first pattern (rule, condition on the error's row, diagnosis) that fits."""
    found = [F.when((F.col("rule") == r) & (F.lit(True) if c is None else F.coalesce(c, F.lit(False))), F.lit(d)) for r, c, d in patterns]
    return errors.withColumn("diagnosis", F.coalesce(*found, F.lit(fallback)))


def route(errors: DataFrame, actions: Mapping[str, str], default: str = "escalate") -> DataFrame:
    """Errors with the action that their diagnosis calls for."""
    pairs = [x for d, a in actions.items() for x in (F.lit(d), F.lit(a))]
    return errors.withColumn("action", F.coalesce(F.element_at(F.create_map(*pairs), F.col("diagnosis")), F.lit(default)))


def apply_fixes(df: DataFrame, errors: DataFrame, key: str, fixes: Mapping[str, tuple[str, Column]]) -> DataFrame:
    """Rows after the automatic fixes of their errors: a diagnosis sets a field to a value, which may
    use other fields. The rows' diagnoses come as one set each, so errors don't multiply rows."""
    wanted = errors.where("action = 'auto'").groupBy(key).agg(F.collect_set("diagnosis").alias("__d"))
    out = df.join(wanted, key, "left")
    new = {}
    for diagnosis, (field, value) in fixes.items():
        before = new.get(field, F.col(field))
        new[field] = F.when(F.array_contains("__d", diagnosis), value).otherwise(before)
    changed = reduce(Column.__or__, [~v.eqNullSafe(F.col(f)) for f, v in new.items()], F.lit(False))
    return out.withColumn("__changed", changed).withColumns(new).drop("__d").withColumnRenamed("__changed", "fixed")


def error_groups(errors: DataFrame, key: str, sample: str, dims: Sequence[str] = ("diagnosis", "kind"), n: int = 5) -> DataFrame:
    """Errors and rows per group of ``dims``, with the first of their distinct sample values in order.
    Values are made distinct and ranked before they are gathered, so a group brings ``n`` at most."""
    values = errors.select(*dims, F.col(sample).cast("string").alias("__value")).where("__value IS NOT NULL").distinct()
    first = ranked(values, list(dims), [F.asc("__value")], n).groupBy(*dims).agg(F.array_join(F.array_sort(F.collect_list("__value")), "|").alias("samples"))
    counts = errors.groupBy(*dims).agg(F.count("*").alias("n"), F.count_distinct(key).alias("rows"))
    return counts.join(first, list(dims), "left").withColumn("samples", F.coalesce("samples", F.lit("")))


def error_group_ids(errors: DataFrame, key: str, dims: Sequence[str] = ("diagnosis", "kind")) -> DataFrame:
    """The rows of each group of errors, one a line, so no group has to fit one list."""
    return errors.select(*dims, key).distinct()


SEVERITIES = ("critical", "error", "warning", "info")


def open_errors(errors: DataFrame, state: str = "state") -> DataFrame:
    """Open errors per severity with its place in the order of severities."""
    place = F.coalesce(*[F.when(F.col("severity") == s, F.lit(i)) for i, s in enumerate(SEVERITIES)], F.lit(len(SEVERITIES))).cast("long")
    return errors.where(F.col(state) == "open").groupBy(place.alias("place"), "severity").agg(F.count("*").alias("n"))


def error_states(errors: DataFrame, state: str = "state", states: Sequence[str] = ("fixed", "escalated", "open")) -> DataFrame:
    """Errors of each kind by their state."""
    return errors.groupBy("kind").agg(F.count("*").alias("n"), *[F.count_if(F.col(state) == s).alias(s) for s in states])


def completeness(df: DataFrame, *dims: str) -> DataFrame:
    """Filled values of every other column in percent, in one pass; blank text is not filled."""
    cols = [c for c in df.columns if c not in dims]
    filled = [F.count_if(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != "").alias(f"__{i}") for i, c in enumerate(cols)]
    counts = df.groupBy(*dims).agg(F.count("*").alias("n"), *filled)
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"__{i}").alias("filled")) for i, c in enumerate(cols)])).alias("x")
    return counts.select(*dims, "n", pairs).select(*dims, "x.column", "x.filled", percent(F.col("x.filled"), F.col("n")).alias("pct"))


def source_quality(df: DataFrame, source: str, fields: Mapping[str, Column]) -> DataFrame:
    """Rows per source, share of rows that meet each condition, and the mean of these shares."""
    out = df.groupBy(source).agg(F.count("*").alias("n"), *[percent(F.count_if(c), F.count("*")).alias(f) for f, c in fields.items()])
    return out.withColumn("score", half_up(reduce(Column.__add__, [F.col(f) for f in fields]) / len(fields), 2))


def run_checks(checks: Sequence[tuple[str, DataFrame, Column, float]]) -> DataFrame:
    """Checks (name, frame, condition, least percent): share of rows that meet it, level, pass."""
    out = None
    for name, df, condition, least in checks:
        share = df.agg(F.count("*").alias("n"), percent(F.count_if(F.coalesce(condition, F.lit(False))), F.count("*")).alias("pct"))
        row = share.select(F.lit(name).alias("check"), "n", "pct", F.lit(float(least)).alias("least"))
        out = row if out is None else out.union(row)
    ok = F.coalesce(F.col("pct") >= F.col("least"), F.lit(False))
    return out.withColumn("passed", ok).withColumn("level", F.when(ok, "ok").when(F.col("pct") >= F.col("least") - 10, "warning").otherwise("critical"))


def integrity(df: DataFrame, key: str, text: str, day: str, first: str, last: str) -> DataFrame:
    """Rows in breach of integrity: repeated and null keys, bad characters, days out of bounds."""
    d = F.to_date(day)
    flat = df.agg(
        F.count_if(F.col(key).isNull()).alias("null_keys"),
        F.count_if(F.col(text).rlike("[\x00-\x08\x0e-\x1f�]")).alias("bad_characters"),
        F.count_if(d > F.to_date(F.lit(last))).alias("future"),
        F.count_if(d < F.to_date(F.lit(first))).alias("too_old"),
    )
    repeats = df.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").agg(F.count("*").alias("repeated_keys"))
    return flat.crossJoin(repeats)


def child_coverage(parents: DataFrame, children: DataFrame, key: str, child_key: str) -> DataFrame:
    """Parents with a child, and children without a parent."""
    c = children.select(F.col(child_key).alias(key))
    covered = parents.join(c.distinct(), key, "left_semi").agg(F.count("*").alias("covered"))
    orphans = c.join(parents.select(key), key, "left_anti").agg(F.count("*").alias("orphans"))
    return parents.agg(F.count("*").alias("n")).crossJoin(covered).crossJoin(orphans).withColumn("covered_pct", percent(F.col("covered"), F.col("n")))


def schema_check(df: DataFrame, required: Sequence[str], strict: bool = True) -> DataFrame:
    """Required columns: whether they are there, and how many nulls they hold. In strict mode a
    column with a null fails too."""
    there = [c for c in required if c in df.columns]
    counts = df.agg(F.count("*").alias("__n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in there])
    rows = [F.struct(F.lit(c).alias("column"), F.lit(c in there).alias("present"), (F.col(c) if c in there else F.lit(None)).cast("long").alias("nulls")) for c in required]
    out = counts.select(F.explode(F.array(*rows)).alias("x")).select("x.*")
    return out.withColumn("ok", F.col("present") & ((F.col("nulls") == 0) if strict else F.lit(True)))


def richness(flags: Sequence[Column]) -> Column:
    """Number of conditions that hold."""
    return reduce(Column.__add__, [F.coalesce(c, F.lit(False)).cast("long") for c in flags])


def length_band(c: Column, edges: Sequence[int] = (500, 1000, 2000, 5000)) -> Column:
    """Band of a length; an edge belongs to the band below it."""
    out = F.when(c.isNull(), None)
    for a, b in zip((None, *edges), edges, strict=False):
        out = out.when(c <= b, f"<={b}" if a is None else f"{a + 1}-{b}")
    return out.otherwise(f">{edges[-1]}")


def richness_by(df: DataFrame, score: Column, *dims: Column | str) -> DataFrame:
    """Mean richness per band, day or any other value."""
    return df.withColumn("__s", score).groupBy(*dims).agg(F.count("*").alias("n"), half_up(F.avg("__s"), 4).alias("mean_score"))


def gold_precision(df: DataFrame, gold: DataFrame, key: str, got: str, wanted: str) -> DataFrame:
    """Correct, wrong and pending rows of a gold set, and precision in percent of those decided."""
    rows = gold.select(key, F.col(wanted).alias("__w")).join(df.select(key, F.col(got).alias("__g")), key, "left")
    out = rows.agg(F.count("*").alias("n"), F.count_if(F.expr("__g = __w")).alias("correct"), F.count_if(F.expr("__g <> __w")).alias("wrong"), F.count_if(F.expr("__g IS NULL")).alias("pending"))
    return out.withColumn("precision_pct", percent(F.col("correct"), F.col("correct") + F.col("wrong")))


def stage_failures(first: DataFrame, stages: Sequence[tuple[str, DataFrame, Column]], key: str) -> DataFrame:
    """Rows with the first stage that lacks them or where they fail its condition, and the reason."""
    out, found = first.select(key), []
    for i, (name, df, ok) in enumerate(stages):
        out = out.join(df.groupBy(key).agg(F.bool_or(F.coalesce(ok, F.lit(False))).alias(f"__{i}")), key, "left")
        reason = F.when(F.col(f"__{i}").isNull(), "missing").when(~F.col(f"__{i}"), "rejected")
        found.append(F.when(reason.isNotNull(), F.struct(F.lit(name).alias("stage"), reason.alias("reason"))))
    return out.select(key, F.coalesce(*found).alias("f")).where("f IS NOT NULL").select(key, "f.*")
