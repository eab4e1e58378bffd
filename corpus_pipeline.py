"""A corpus pipeline of the subpackage's operators: documents in, token ids out.

Each stage works on all that its predecessor kept and returns the columns of ``documents``, but the
last, which returns ids and digests. ``run`` chains them through Parquet in the shared folder, so a
lost executor costs a stage's tasks and not the stages before.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.llm import bpe, decontaminate, near_copies, suffix_index, toxicity
from vacantia.sources.scratch import scratch_dir
from vacantia.sources.tables import table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain of classifiers does not call toxic."""
    labels = toxicity.label_table(table(spark, sf_dir, "labels"))
    chain = toxicity.train(docs, labels, toxicity.CATEGORIES)
    return toxicity.score(docs, chain).where(~F.col("is_toxic")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of near copies: texts whose sets of five-word
    shingles are 0.8 alike or more, linked to whole classes. Of several texts of one id each is in its
    own class, and rows without an id stay if their class has no other."""
    return near_copies.without_copies(docs).select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without bytes that repeat a document with a smaller id. Characters of which a byte
    went go as a whole; no document is dropped, also if nothing of its text is left."""
    rows = suffix_index.remove_repeats(docs, characters=True).withColumn("text", F.when(F.col("text").isNotNull(), F.col("kept")))
    return rows.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast("long")).select(*COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document: token ids, their number and digest, and the digest of the decoded text."""
    vocabulary = bpe.read_vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    trip = bpe.round_trip_column(spark, F.col("text"), vocabulary, ids=True)
    rows = docs.select("doc_id", "lang", "source", trip.alias("trip"))
    return rows.select("doc_id", "lang", "source", "trip.ids", "trip.n_tokens", "trip.ids_sha256", "trip.decoded_sha256")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("decontaminate", drop_leaks),
    ("bpe", encode),
]

#: The stages are tested against brute force: SQL expresses neither the fitted chain nor the ids.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a data directory."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{scratch_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
