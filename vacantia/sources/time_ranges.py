"""A stream source of a table's rows in order of ranges of their time.

``write_ranges`` deals a table out into folders by ranges of time, in one parallel job. The source
then offers some ranges at a time, the files of each range to as many tasks, so a batch is read in
parallel and no row comes after a batch of a later range. Each batch has a cost of its own, so many
ranges go into few batches, and only more bytes make more batches. Offsets are ranges. The last
range of the batch that was planned last is noted in a small file beside the query's checkpoint, so
a query that starts again goes on from there.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

RANGE = "__range"


def write_ranges(df: DataFrame, ts: str, path: str, seconds: int) -> None:
    """Parquet in a folder for each range of so many seconds; rows without a time come first."""
    number = F.coalesce(F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(seconds * 1_000_000)), F.lit(-(2**62)))
    rows = df.withColumn(RANGE, number)
    rows.repartitionByRange(RANGE, ts, F.xxhash64(*df.columns)).write.mode("append").partitionBy(RANGE).parquet(path)


#: Before all ranges.
START = -(2**63)

#: Batches for the ranges that are known, and bytes of files a batch, unless one range has more.
BATCHES, BATCH_BYTES = 16, 128 * 2**20


class TimeRangeReader(DataSourceStreamReader):
    def __init__(self, path: str, schema: T.StructType, ranges: int, progress: str, batches: int, size: int):
        self.path, self.schema, self.ranges, self.progress = path, schema, ranges, progress
        self.batches, self.size = batches, size
        self.offered: int | None = None

    def _known(self) -> dict[int, list[pafs.FileInfo]]:
        """The files of each range, in order of the ranges."""
        fs, at = pafs.FileSystem.from_uri(self.path)
        found: dict[int, list[pafs.FileInfo]] = {}
        for f in fs.get_file_info(pafs.FileSelector(at, allow_not_found=True, recursive=True)):
            folder, _, name = f.path.removeprefix(at.rstrip("/") + "/").partition("/")
            if folder.startswith(f"{RANGE}=") and name.endswith(".parquet"):
                found.setdefault(int(folder.split("=")[1]), []).append(f)
        return dict(sorted(found.items()))

    def _planned(self) -> int:
        fs, at = pafs.FileSystem.from_uri(self.progress)
        if fs.get_file_info(at).type == pafs.FileType.NotFound:
            return START
        with fs.open_input_file(at) as file:
            return int(file.read())

    def initialOffset(self) -> dict:
        return {"range": START}

    def latestOffset(self) -> dict:
        if self.offered is None:
            self.offered = self._planned()
        known = self._known()
        most, held = max(self.ranges, math.ceil(len(known) / self.batches)), 0
        for i, r in enumerate([r for r in known if r > self.offered][:most]):
            held += sum(f.size for f in known[r])
            if i >= self.ranges and held > self.size:
                break
            self.offered = r
        return {"range": self.offered}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        fs, at = pafs.FileSystem.from_uri(self.progress)
        fs.create_dir(at.rsplit("/", 1)[0])
        with fs.open_output_stream(at) as file:
            file.write(str(end["range"]).encode())
        return [InputPartition(f.path) for r, files in self._known().items() if start["range"] < r <= end["range"] for f in files]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(self.path)
        kind = to_arrow_schema(self.schema)
        with fs.open_input_file(partition.value) as file:
            for batch in pq.ParquetFile(file).iter_batches(columns=kind.names):
                yield from pa.Table.from_batches([batch]).select(kind.names).cast(kind).to_batches()

    def commit(self, end: dict) -> None:
        """Nothing is kept for ranges that are done."""


class TimeRangeSource(DataSource):
    """Options: ``path``, ``schema`` (JSON of the rows), ``progress``, the file of the last planned
    range, ``ranges``, how many a batch takes at least, ``batches``, into how many the known ranges
    go if they are more, and ``size``, the bytes of files beyond which a batch takes no more than
    ``ranges``."""

    @classmethod
    def name(cls) -> str:
        return "time_ranges"

    def schema(self) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.options["schema"]))

    def streamReader(self, schema: T.StructType) -> TimeRangeReader:
        numbers = {k: int(self.options.get(k, v)) for k, v in {"ranges": 1, "batches": BATCHES, "size": BATCH_BYTES}.items()}
        return TimeRangeReader(self.options["path"], schema, progress=self.options["progress"], **numbers)


def time_range_stream(spark: SparkSession, path: str, schema: T.StructType, checkpoint: str, ranges: int = 1) -> DataFrame:
    """The rows that ``write_ranges`` dealt out, so many ranges a batch or more, for a query with a
    checkpoint in a folder."""
    spark.dataSource.register(TimeRangeSource)
    options = {"path": path, "schema": schema.json(), "ranges": str(ranges), "progress": f"{checkpoint}-range"}
    return spark.readStream.format("time_ranges").options(**options).load()
