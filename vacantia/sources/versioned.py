"""A table of Parquet folders with versions: readers see a version whole or not at all.

A version is a small file that names the folders of each part of the table: a bucket of the keys for
an upsert, a value of the partition column for an append. New data is written to a folder of its
own, and the version that names it appears by one rename, which fails if another writer was first.
What a failed write leaves behind is named by no version.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The column that names a row's part, and the folder of rows whose part is empty.
PART, NO_NAME = "__part", "__HIVE_DEFAULT_PARTITION__"


@dataclass(frozen=True)
class Version:
    """``parts``: folders by part. ``applied``: number of the last batch that went in."""

    number: int = 0
    schema: str | None = None
    parts: dict[str, list[str]] = field(default_factory=dict)
    applied: int | None = None


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._jvm = spark._jvm
        self._versions = self._path(f"{path}/_versions")
        self._fs = self._versions.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _number(self) -> int:
        if not self._fs.exists(self._versions):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(self._versions)]
        return max((int(n) for n in names if n.isdigit()), default=0)

    def current(self) -> Version:
        number = self._number()
        return self._at(number) if number else Version()

    def commit(self, seen: Version, schema: str, parts: dict[str, list[str]], applied: int | None) -> Version:
        """The version after ``seen``; an error if another writer has made it."""
        new = Version(seen.number + 1, schema, parts, applied)
        draft = self._path(f"{self.path}/_versions/draft-{uuid.uuid4().hex}")
        self._fs.mkdirs(self._versions)
        out = self._fs.create(draft, False)
        try:
            out.write(bytearray(json.dumps({"schema": schema, "parts": parts, "applied": applied}).encode()))
        finally:
            out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        never_over = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context.rename(draft, self._path(f"{self.path}/_versions/{new.number}"), never_over)
        return new

    def read(self, parts: Iterable[str] | None = None, version: Version | None = None) -> DataFrame | None:
        """The rows of a version, or of some parts of it; None before the first."""
        version = version or self.current()
        if version.schema is None:
            return None
        schema = T.StructType.fromJson(json.loads(version.schema))
        names = version.parts if parts is None else [p for p in parts if p in version.parts]
        folders = [f for p in names for f in version.parts[p]]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*folders)

    def write(self, rows: DataFrame, part: Column, spread: int = 1) -> tuple[str, dict[str, list[str]]]:
        """Writes rows to a folder by part, each part in up to ``spread`` files; the schema and the
        folder of each part."""
        folder = f"{self.path}/data-{uuid.uuid4().hex}"
        placed = rows.withColumn(PART, part)
        salt = [F.pmod(F.xxhash64(*rows.columns), F.lit(spread))] if spread > 1 else []
        placed.repartition(PART, *salt).write.partitionBy(PART).parquet(folder)
        top, found = self._path(folder), {}
        for s in self._fs.listStatus(top):
            name = s.getPath().getName()
            if name.startswith(f"{PART}="):
                unescape = self._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
                part = unescape(name[len(PART) + 1 :])
                found["" if part == NO_NAME else part] = [f"{folder}/{name}"]
        return rows.schema.json(), found

    def vacuum(self, keep: int = 2) -> int:
        """Removes versions before the last ``keep`` and the folders that only they name; not to be
        run beside a writer. Returns the number of removed folders."""
        numbers = sorted(int(n) for s in self._fs.listStatus(self._versions) if (n := s.getPath().getName()).isdigit())
        held = {f.rsplit("/", 2)[-2] for n in numbers[-keep:] for fs in self._at(n).parts.values() for f in fs}
        gone = 0
        for s in self._fs.listStatus(self._path(self.path)):
            name = s.getPath().getName()
            if name.startswith("data-") and name not in held:
                gone += self._fs.delete(s.getPath(), True)
        for n in numbers[:-keep]:
            self._fs.delete(self._path(f"{self.path}/_versions/{n}"), False)
        return gone

    def _at(self, number: int) -> Version:
        stream = self._fs.open(self._path(f"{self.path}/_versions/{number}"))
        try:
            said = json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()
        return Version(number, said["schema"], said["parts"], said["applied"])


def bucket(keys: Sequence[str], buckets: int) -> Column:
    """The bucket of a row's keys, as text."""
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("string")
