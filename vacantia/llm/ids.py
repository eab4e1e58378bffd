"""Joining texts with sets of ids: broadcast while few, by a shuffle of the texts beyond."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.sources.scratch import checkpointed

#: Ids that are broadcast at most; some sixteen bytes each.
BROADCAST_IDS = 500_000


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def counted(ids: DataFrame) -> DataFrame:
    """``ids`` computed once, with a broadcast hint if their number is small."""
    ids = checkpointed(ids)
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def without(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows whose id is not among ``ids``; rows without an id stay."""
    return docs.join(counted(ids.select(id_col).where(F.col(id_col).isNotNull()).distinct()), id_col, "left_anti").select(docs.columns)
