"""Sources, incremental load and export."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacantia.functions.columns import percent
from vacantia.sources.scratch import checkpointed
from vacantia.sources.versioned import VersionedTable, bucket


def read_source(spark: SparkSession, fmt: str, path: str, schema: T.StructType | str, corrupt: str = "_corrupt") -> DataFrame:
    """Raw files of one source with a fixed schema. Text formats keep lines that don't fit it in
    the column ``corrupt``; nothing is inferred, so files are read once."""
    if fmt == "parquet":
        return spark.read.schema(schema).parquet(path)
    full = T.StructType.fromDDL(schema) if isinstance(schema, str) else T.StructType(schema.fields)
    full = full.add(corrupt, T.StringType())
    reader = spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", corrupt)
    if fmt == "csv":
        return reader.option("header", True).csv(path)
    return reader.json(path)


def consolidate(frames: Sequence[DataFrame], day: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """Sources with differing columns as one frame; missing columns are null. Rows outside the
    days, and rows without a day if there are bounds, go."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    if since:
        out = out.where(F.to_date(day) >= F.to_date(F.lit(since)))
    if until:
        out = out.where(F.to_date(day) <= F.to_date(F.lit(until)))
    return out


def upsert(target: DataFrame, batch: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Newest row per key of both; the batch wins ties. Columns that only one has are null."""
    rows = target.withColumn("__new", F.lit(0)).unionByName(batch.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc_nulls_last(order), F.desc("__new")))
    return rows.withColumn("__rank", rank).where("__rank = 1").drop("__rank", "__new")


def _rewritten(target: VersionedTable, batch: DataFrame, keys: Sequence[str], merge: Callable[[DataFrame, DataFrame], DataFrame], buckets: int, number: int | None) -> bool:
    """Puts a batch into the buckets of a stored target that it touches, and no others: ``merge`` of
    their rows and the batch. Whether it went in."""
    seen = target.current()
    if number is not None and seen.applied is not None and number <= seen.applied:
        return False
    batch = checkpointed(batch)
    touched = [r["b"] for r in batch.select(bucket(keys, buckets).alias("b")).distinct().collect()]  # ``buckets`` at most
    before = target.read(touched, seen)
    schema, parts = target.write(merge(batch.limit(0) if before is None else before, batch), bucket(keys, buckets))
    target.commit(seen, schema, {**seen.parts, **parts}, number if number is not None else seen.applied)
    return True


def upsert_into(target: VersionedTable, batch: DataFrame, keys: Sequence[str], order: str, buckets: int = 64, number: int | None = None) -> bool:
    """``upsert`` of a batch into a stored target, of which only the buckets that the batch touches
    are read and written anew. Readers see all of it or none. A batch whose number has been applied
    changes nothing, so one that runs again gives the same target. Whether it went in."""
    return _rewritten(target, upsert(batch.limit(0), batch, keys, order), keys, lambda old, new: upsert(old, new, keys, order), buckets, number)


def replace_into(target: VersionedTable, batch: DataFrame, keys: Sequence[str], buckets: int = 64, number: int | None = None) -> bool:
    """As ``upsert_into``, but all rows of a key in the batch take the place of all rows that the
    target has of it. Null keys are a key."""

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        there = new.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
        same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
        return old.join(there, same, "left_anti").unionByName(new, allowMissingColumns=True)

    return _rewritten(target, batch, keys, merge, buckets, number)


def append_into(log: VersionedTable, rows: DataFrame, by: str, spread: int = 8, number: int | None = None) -> bool:
    """Appends rows to a stored log whose folders are partitioned by a column; a large value of it is
    written in several files. Readers see all of it or none, and a batch whose number has been
    applied changes nothing. Whether it went in."""
    seen = log.current()
    if number is not None and seen.applied is not None and number <= seen.applied:
        return False
    schema, parts = log.write(rows, F.coalesce(F.col(by).cast("string"), F.lit("")), spread)
    together = {p: [*seen.parts.get(p, []), *parts.get(p, [])] for p in {*seen.parts, *parts}}
    log.commit(seen, schema if parts or seen.schema is None else seen.schema, together, number if number is not None else seen.applied)
    return True


def content_hash(*cols: str) -> Column:
    """SHA-256 of columns as text; null and empty differ."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in cols]), 256)


def append_versions(log: DataFrame, batch: DataFrame, keys: Sequence[str], content: Sequence[str]) -> DataFrame:
    """Rows of a batch whose content the log doesn't hold for their key, with their hash."""
    fresh = batch.withColumn("content_hash", content_hash(*content)).dropDuplicates([*keys, "content_hash"])
    return fresh.join(log.select(*keys, "content_hash"), [*keys, "content_hash"], "left_anti")


def filter_new(batch: DataFrame, seen: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows with an unseen key, and the seen keys with those of the batch."""
    return batch.join(seen.select(key), key, "left_anti"), seen.select(key).union(batch.select(key)).distinct()


def stale_ids(seen: DataFrame, last_seen: str, days: int, as_of: str) -> DataFrame:
    """Keys last seen more than so many days before a day."""
    return seen.where(F.to_date(last_seen) < F.date_sub(F.to_date(F.lit(as_of)), days))


def latest_version(history: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The row of each key with the latest order value."""
    rest = [c for c in history.columns if c not in keys]
    return history.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r")).select(*keys, "r.*")


def active_version(history: DataFrame, versions: DataFrame, version: str, active: str) -> DataFrame:
    """Rows that belong to an active version."""
    return history.join(versions.where(F.col(active)).select(version), version, "left_semi")


def export_snapshot(postings: DataFrame, matches: DataFrame, skills: DataFrame, dimension: DataFrame, key: str, skill: str, valid: Column) -> Mapping[str, DataFrame]:
    """Validated postings with their match, the skills of these postings, and the skills' rows."""
    chosen = postings.join(matches.where(valid), key)
    children = skills.join(chosen.select(key), key, "left_semi")
    return {"postings": chosen, "skills": children, "dimension": dimension.join(children.select(skill), skill, "left_semi")}


def write_snapshot(frames: Mapping[str, DataFrame], path: str, snapshot: str, fmt: str = "parquet") -> None:
    """Each frame under its name, partitioned by the snapshot; a snapshot written again replaces itself."""
    for name, df in frames.items():
        out = df.withColumn("snapshot", F.lit(snapshot)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot")
        (out.option("compression", "gzip") if fmt == "json" else out).format(fmt).save(f"{path}/{name}")


def json_fields(df: DataFrame, col: str, schema: str) -> DataFrame:
    """Typed fields of a JSON column; text that is no JSON gives nulls."""
    return df.withColumn("__j", F.from_json(F.col(col), schema)).select(*df.columns, "__j.*")


def validate_batch(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """``df`` with the names of the rules it breaks and whether it is valid; null breaks a rule."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return df.withColumn("broken", broken).withColumn("valid", F.size("broken") == 0)


def split_batch(df: DataFrame, rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and rows for quarantine with the rules they break."""
    checked = validate_batch(df, rules)
    return checked.where("valid").drop("valid", "broken"), checked.where("NOT valid").drop("valid")


def validity(df: DataFrame, rules: Mapping[str, Column], batch: str) -> DataFrame:
    """Valid rows and their share per batch."""
    out = validate_batch(df, rules).groupBy(batch).agg(F.count("*").alias("n"), F.count_if("valid").alias("n_valid"))
    return out.withColumn("valid_pct", percent(F.col("n_valid"), F.col("n")))
