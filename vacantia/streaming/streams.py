"""Structured Streaming: feeds of postings, health metrics, crawl sessions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vacantia.operators.ingest import upsert_into
from vacantia.sources.versioned import VersionedTable


def file_stream(spark: SparkSession, path: str, schema, files: int = 4) -> DataFrame:
    """A stream of the Parquet files of a folder, a few files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def first_of_id(stream: DataFrame, key: str, ts: str, delay: str) -> DataFrame:
    """Rows without repeats of an id within the watermark, so state stays bounded."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def stream_upsert(stream: DataFrame, target: VersionedTable, keys: Sequence[str], order: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Keyed upsert of each batch into a stored target, of which a batch rewrites only the buckets
    that it touches. A batch that runs again gives the same target."""

    def put(batch: DataFrame, number: int) -> None:
        upsert_into(target, batch, keys, order, buckets, number)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).start()


def stream_health(stream: DataFrame, ts: str, source: str, failed: Column, width: str, delay: str, warning: float = 0.2, critical: float = 0.5) -> DataFrame:
    """Rows and failures per source and tumbling window, with the level of an alert."""
    out = stream.withWatermark(ts, delay).groupBy(F.window(ts, width).alias("w"), source).agg(F.count("*").alias("n"), F.count_if(failed).alias("failed"))
    rate = F.col("failed") / F.col("n")
    level = F.when(rate >= critical, "critical").when(rate >= warning, "warning").otherwise("ok")
    return out.select(F.col("w.start").alias("start"), source, "n", "failed", level.alias("level"))


def stream_sessions(stream: DataFrame, ts: str, source: str, gap: str, delay: str) -> DataFrame:
    """Sessions per source by a gap of inactivity; rows later than the watermark are dropped."""
    out = stream.withWatermark(ts, delay).groupBy(F.session_window(ts, gap).alias("w"), source).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), source, "n")


def drain(query: StreamingQuery) -> None:
    """Lets a query take all that its source has now, batch by batch, and ends it."""
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over what is there now and writes its result as Parquet."""
    drain(stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).start())
