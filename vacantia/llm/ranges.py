"""Dealing a table into batches by ranges of its ids."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacantia.sources.scratch import checkpointed

#: Batches of a table at least (while each has ``LEAST_BYTES``) and at most; one id a batch is broadcast.
LEAST_BATCHES, LEAST_BYTES, MOST_BATCHES = 48, 256 << 10, 1_000_000
#: Bytes from which batches grow with the square root of the table, and how many times at most.
GROWS_FROM, GROWS_TO = 4 << 30, 8
#: Rows of a stretch of ids whose bytes are added up in one task; stretches at least and at most.
STRETCH_ROWS, LEAST_STRETCHES, MOST_STRETCHES = 1_000_000, 500, 20_000
#: Bytes of a partition, which holds many batches one after another; partitions at most.
PARTITION_BYTES, MOST_PARTITIONS = 32 << 20, 20_000


class Ranges:
    """Batches of about equal bytes of text; all rows of one id are in one batch.

    The bytes before each id are added up exactly, in stretches of ids that are summed apart, so a
    batch has its bytes at most but for the rows of its last id. Only the first id of each batch
    reaches the driver, as in any range partitioning. Batches grow with the square root of a large
    table, so what all batches send to all others grows less than the table's square; past
    ``MOST_BATCHES`` they grow in proportion. A partition holds many batches, which are worked on
    one after another. Rows without an id belong to no batch.
    """

    def __init__(self, df: DataFrame, id_col: str, text: str, batch_bytes: int):
        self.id_col, self.spark = id_col, df.sparkSession
        # the texts are read once for their sizes
        sizes = checkpointed(df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes")).where("id IS NOT NULL"))
        total = sizes.agg(F.sum("bytes").alias("bytes"), F.count("*").alias("rows")).first()
        self.bytes = total["bytes"] or 0
        target = max(1, min(self.grown(batch_bytes), max(LEAST_BYTES, self.bytes // LEAST_BATCHES)), -(-self.bytes // MOST_BATCHES))
        stretches = min(MOST_STRETCHES, max(LEAST_STRETCHES, total["rows"] // STRETCH_ROWS))
        shares = [i / stretches for i in range(1, stretches)]
        edges = sizes.agg(F.percentile_approx("id", shares, 40 * stretches).alias("e")).first()["e"]
        coarse = np.array(sorted(set(edges or [])), dtype=np.int64)
        sizes = sizes.withColumn("stretch", _place(self.spark, F.col("id"), coarse))
        sums = dict(sizes.groupBy("stretch").agg(F.sum("bytes")).collect())
        order, before = sorted(sums), 0
        offsets = np.zeros(len(coarse) + 1, dtype=np.int64)
        for k in order:
            offsets[k], before = before, before + sums[k]
        smaller = Window.partitionBy("stretch").orderBy("id").rangeBetween(Window.unboundedPreceding, -1)
        placed = sizes.withColumn("before", F.coalesce(F.sum("bytes").over(smaller), F.lit(0)) + F.get(F.array(*map(F.lit, offsets.tolist())), F.col("stretch")))
        heads = placed.groupBy(F.floor(F.col("before") / target).alias("batch")).agg(F.min("id").alias("head"))
        #: Smallest id of each batch.
        self.heads = np.array(sorted(r["head"] for r in heads.collect()), dtype=np.int64)
        self.n = max(1, len(self.heads))
        self.most = MOST_PARTITIONS
        #: Partitions, and batches in one.
        parts = min(self.n, max(LEAST_BATCHES, min(self.most, -(-self.bytes // PARTITION_BYTES))))
        self.per = -(-self.n // parts)
        self.parts = -(-self.n // self.per)

    def grown(self, size: int) -> int:
        """A size for a small table, as it is for this one."""
        return int(size * min(GROWS_TO, max(1.0, (self.bytes / GROWS_FROM) ** 0.5)))

    def dealt(self, df: DataFrame) -> DataFrame:
        """Rows dealt out by batches, of which ``__batch`` and ``__part`` are the numbers."""
        return self.dealt_again(df.withColumn("__batch", self.batch()), "__batch")

    def dealt_again(self, df: DataFrame, batch: str) -> DataFrame:
        """Rows that have the number of their batch, dealt to where the batch is."""
        df = df.withColumn("__batch", F.col(batch)).withColumn("__part", F.floor(F.col(batch) / self.per).cast("int"))
        return df.repartitionById(self.parts, F.col("__part"))

    def grouped(self, df: DataFrame):
        """Dealt rows by part and batch, without another exchange."""
        return df.groupBy("__part", "__batch")

    def by_bucket(self, blocks: DataFrame, buckets: int):
        """Rows with a ``bucket`` by slot and bucket, dealt out by slots of one or more buckets."""
        slots = min(buckets, self.most)
        return blocks.withColumn("__slot", F.col("bucket") % slots).repartitionById(slots, F.col("__slot")).groupBy("__slot", "bucket")

    def batch(self) -> Column:
        """Number of a row's batch; null without an id."""
        return _place(self.spark, F.col(self.id_col), self.heads) - 1

    def batches_and_guest(self) -> Column:
        """Batches a row is needed in: its own, and as a guest the one before if it is its batch's
        first (the last batch for the first of all)."""
        heads = self.spark.sparkContext.broadcast(self.heads)

        @F.arrow_udf(T.ArrayType(T.IntegerType()))
        def batches_of(ids: pa.Array) -> pa.Array:
            values = ids.to_numpy(zero_copy_only=False)
            own = np.searchsorted(heads.value, values, side="right") - 1
            first = heads.value[own] == values
            return pa.array([[a, (a - 1) % len(heads.value)] if x else [a] for a, x in zip(own.tolist(), first.tolist(), strict=True)], pa.list_(pa.int32()))

        return batches_of(F.col(self.id_col))


def _place(spark, ids: Column, edges: np.ndarray) -> Column:
    """How many edges an id has reached."""
    shared = spark.sparkContext.broadcast(edges)

    @F.arrow_udf(T.IntegerType())
    def place(ids: pa.Array) -> pa.Array:
        found = np.searchsorted(shared.value, ids.fill_null(0).to_numpy(zero_copy_only=False), side="right").astype(np.int32)
        return pa.array(found, mask=ids.is_null().to_numpy(zero_copy_only=False))

    return place(ids)
