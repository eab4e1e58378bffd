"""Stored targets: touched buckets only, whole versions, failed writes, batches that run again."""

import os

import pytest
from pyspark.sql import functions as F

from vacantia.operators.ingest import append_into, replace_into, upsert_into
from vacantia.sources.time_ranges import START, TimeRangeSource, time_range_stream, write_ranges
from vacantia.sources.versioned import Version, VersionedTable
from vacantia.streaming import streams


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet"))


def test_upsert_into_touches_what_it_has_to(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    assert t.read() is None
    first = spark.range(5000).select(F.col("id").alias("k"), F.lit(1).alias("at"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
    assert upsert_into(t, first, ["k"], "at", buckets=16, number=0)
    all_of_it = size(tmp_path / "t")
    small = spark.createDataFrame([(3, 2, "new", 7), (9999, 0, "other", None), (None, 5, "null key", 1), (3, 1, "older", 8)], "k long, at int, v string, more int")
    assert upsert_into(t, small, ["k"], "at", buckets=16, number=1)
    assert size(tmp_path / "t") - all_of_it < all_of_it / 4
    assert t.read().count() == 5002
    assert rows(t.read().where("at <> 1"), "k", "v", "more") == [(3, "new", 7), (9999, "other", None), (None, "null key", 1)]
    assert not upsert_into(t, first.withColumn("at", F.lit(9)), ["k"], "at", buckets=16, number=1)  # runs again
    assert t.current().number == 2 and t.read().where("at = 9").count() == 0
    assert t.vacuum(keep=1) == 0 and t.read().count() == 5002  # the first folder still holds other buckets
    assert upsert_into(t, first.withColumn("at", F.lit(10)), ["k"], "at", buckets=16)
    assert t.vacuum(keep=1) >= 1 and t.read().where("at = 10").count() == 5000
    assert upsert_into(t, small.limit(0), ["k"], "at", buckets=16) and t.read().count() == 5002


def test_replace_into(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    assert replace_into(t, spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "k int, v string"), ["k"], number=0)
    assert replace_into(t, spark.createDataFrame([(1, "x"), (None, "y"), (None, "z"), (3, "n")], "k int, v string"), ["k"], number=1)
    want = [(1, "x"), (2, "c"), (3, "n"), (None, "y"), (None, "z")]
    assert rows(t.read(), "k", "v") == want
    assert not replace_into(t, spark.createDataFrame([(2, "again")], "k int, v string"), ["k"], number=1) and rows(t.read(), "k", "v") == want


def test_a_failed_or_beaten_write_changes_nothing(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    upsert_into(t, spark.createDataFrame([(1, 1)], "k int, at int"), ["k"], "at")
    boom = F.udf(lambda x: 1 / 0, "int")
    with pytest.raises(Exception, match="ZeroDivision"):
        upsert_into(t, spark.createDataFrame([(2, 1)], "k int, at int").withColumn("at", boom("at")), ["k"], "at")
    assert rows(t.read(), "k", "at") == [(1, 1)] and t.current().number == 1
    seen = t.current()
    upsert_into(t, spark.createDataFrame([(2, 2)], "k int, at int"), ["k"], "at")
    with pytest.raises(Exception, match="(?i)exist"):
        t.commit(seen, seen.schema, {}, None)
    assert rows(t.read(), "k") == [(1,), (2,)] and rows(t.read(version=seen), "k") == [(1,)]
    assert t.current() != Version()


def test_append_into(spark, tmp_path):
    log = VersionedTable(spark, str(tmp_path / "log"))
    append_into(log, spark.createDataFrame([("a", 1), ("b/c", 2), (None, 3)], "src string, v int"), "src")
    append_into(log, spark.createDataFrame([("a", 4)], "src string, v int"), "src")
    append_into(log, spark.createDataFrame([], "src string, v int"), "src")
    assert rows(log.read(), "src", "v") == [("a", 1), ("a", 4), ("b/c", 2), (None, 3)]
    assert rows(log.read(["a"]), "v") == [(1,), (4,)] and rows(log.read(["b/c"]), "v") == [(2,)] and rows(log.read([""]), "v") == [(3,)]
    assert log.read(["nobody"]).count() == 0


def test_ranges_come_in_order_and_in_parallel(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # such a small table would be one file a range
    df = spark.range(4000).select("id", F.timestamp_seconds(F.col("id") * 60).alias("ts")).union(spark.createDataFrame([(-1, None)], "id long, ts timestamp"))
    write_ranges(df, "ts", str(tmp_path / "in"), 86_400)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    seen, tasks = [], []

    def take(batch, _):
        r = batch.agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count("*").alias("n")).first()
        seen.append((r["a"], r["b"], r["n"]))
        tasks.append(batch.rdd.getNumPartitions())

    def run(name):
        stream = time_range_stream(spark, str(tmp_path / "in"), df.schema, str(tmp_path / name))
        streams.drain(stream.writeStream.foreachBatch(take).option("checkpointLocation", str(tmp_path / name)).start())

    run("c")
    assert seen == [(-1, -1, 1), (0, 1439, 1440), (1440, 2879, 1440), (2880, 3999, 1120)] and max(tasks) > 1
    write_ranges(df.where("id > 3990").withColumn("ts", F.timestamp_seconds(F.col("id") * 600)), "ts", str(tmp_path / "in"), 86_400)
    seen.clear()
    run("c")  # from the checkpoint: only the new range
    assert seen == [(3991, 3999, 9)]


def test_many_ranges_go_into_few_batches_unless_they_are_large(spark, tmp_path):
    path = f"file:{tmp_path}/in"
    df = spark.range(200).select("id", F.timestamp_seconds(F.col("id") * 60).alias("ts"))
    write_ranges(df, "ts", path, 60)

    def batches(**limits):
        options = {"path": path, "schema": df.schema.json(), "progress": f"file:{tmp_path}/{'-'.join(limits.values())}-range", **limits}
        reader, ends, files = TimeRangeSource(options).streamReader(df.schema), [{"range": START}], []
        while (end := reader.latestOffset()) != ends[-1]:
            files += [f.value for f in reader.partitions(ends[-1], end)]
            ends.append(end)
        assert len(files) == len(set(files)) >= 200  # each file once
        return [e["range"] for e in ends[1:]]

    assert batches() == [*range(12, 199, 13), 199]
    assert batches(ranges="50") == [49, 99, 149, 199]
    assert batches(size="1") == list(range(200))  # a range has more bytes
    assert batches(ranges="4", size="1") == list(range(3, 200, 4))
