"""Connected components of an edge table."""

from __future__ import annotations

import itertools
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.sources.scratch import checkpointed, scratch_dir, stored


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that each node of an edge reaches.

    Each round takes the smallest label among neighbours, hands it to the node that was the label so
    far, and then takes the label of that label, so whole trees are hooked to each other and the
    number of rounds grows with the logarithm of the diameter. Labels only fall, so the rounds end
    when their sum stays. Nodes of no edge are left out; null ends are dropped; repeated edges and
    loops change nothing. Two folders take turns for the labels.
    """
    folder = f"{scratch_dir(edges.sparkSession)}/labels-{uuid.uuid4().hex}"
    plain = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    ways = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")
    both = checkpointed(plain.select(ways).select("e.*").distinct())  # a union would compute the edges twice
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("component")), f"{folder}/0")
    total = _total(labels)
    for turn in itertools.count(1):
        if total is None:
            break
        ends = labels.select(F.col("node").alias("b"), F.col("component").alias("c"))
        near = both.join(ends, "b").groupBy(F.col("a").alias("node")).agg(F.min("c").alias("c"))
        nearer = labels.join(near, "node").select("node", "component", F.least("component", "c").alias("c"))
        told = nearer.select(F.explode(F.array("node", "component")).alias("label"), "c").groupBy("label").agg(F.min("c").alias("then"))
        jumped = nearer.select("node", F.col("c").alias("label")).join(told, "label").select("node", F.least("label", "then").alias("component"))
        labels = stored(jumped, f"{folder}/{turn % 2}")
        before, total = total, _total(labels)
        if total == before:
            break
    return labels


def _total(labels: DataFrame):
    return labels.agg(F.sum(F.col("component").cast("decimal(38,0)"))).first()[0]
