"""Queries of the subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from vacantia.llm import bpe, chat_tree, decontaminate, fingerprint, html_extract, licenses, phrases, repair, resample, simhash, suffix_index, toxicity, warc_zip

Query = Callable[[SparkSession, str], DataFrame]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One table of a data directory, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = bpe.read_vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    return bpe.round_trip(read(spark, sf_dir, "documents"), vocabulary)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.against_neighbours(read(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_index.report(read(spark, sf_dir, "documents"))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.report(read(spark, sf_dir, "pages"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(read(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_zip.report(read(spark, sf_dir, "pages"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_tree.report(read(spark, sf_dir, "conversations"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(read(spark, sf_dir, "documents"))


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.report(read(spark, sf_dir, "conversations"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.report(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    found = (op1_bpe, op2_decontaminate, op3_fingerprints, op4_suffix_dedup, op5_html, op6_licenses, op7_warc, op8_toxicity, op9_chat, op10_simhash, op11_resample, op12_repair, op13_phrases)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_decontaminate": decontaminate.report_sql(), "op6_licenses": licenses.report_sql(), "op7_warc": warc_zip.report_sql(), "op9_chat": chat_tree.report_sql(), "op12_repair": repair.report_sql(), "op13_phrases": phrases.report_sql()}
