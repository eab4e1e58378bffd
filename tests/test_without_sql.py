"""Queries that SQL can't express, or not in one dialect, against plain Python over whole tables."""

import html
import math
import re
import struct
from collections import Counter, defaultdict

import xxhash
from helpers import SF_DIR

from vacantia.plans import normalize_queries, registry


def rows(spark, name):
    return registry.queries()[name](spark, SF_DIR).collect()


def half_up(x):
    return math.floor(x + 0.5)


def test_stratified_sample(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "source", "n_chars").collect()
    size, strata = Counter(r["source"] for r in docs), defaultdict(list)
    for r in docs:
        strata[r["source"], "long" if r["n_chars"] > 3000 else "mid" if r["n_chars"] > 500 else "short"].append(r["doc_id"])
    wanted = set()
    for (source, stratum), ids in strata.items():
        quota = max(2, half_up(size[source] * 200 / len(docs)))
        n = math.ceil(quota * {"long": 0.4, "mid": 0.4, "short": 0.2}[stratum])
        signed = lambda i: struct.unpack("<q", struct.pack("<Q", xxhash.xxh64_intdigest(struct.pack("<q", i), 42)))[0]
        wanted |= {(i, source, stratum) for i in sorted(ids, key=lambda i: (signed(i), i))[:n]}
    assert {(r["doc_id"], r["source"], r["stratum"]) for r in rows(spark, "a28_stratified_sample")} == wanted


def test_strip_html(spark):
    wanted = {}
    for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").collect():
        text = re.sub(r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", " ", r["html"] or "")
        text = re.sub(r"(?i)<br\s*/?>|</(?:p|div|li|h[1-6]|tr)\s*>", "\n", text)
        lines = re.sub(r"(?s)<[^>]*>", " ", text).split("\n")
        lines = [re.sub("[ \t\r]+", " ", html.unescape(x).replace("\xa0", " ")).strip(" ") for x in lines]
        wanted[r["page_id"]] = "\n".join(x for x in lines if x)
    assert {r["page_id"]: r["text"] for r in rows(spark, "n01_strip_html")} == wanted


def test_clean_title(spark):
    for r in rows(spark, "n07_clean_title"):
        before, title = None, r["raw"]
        while before != title:
            before = title
            for p in normalize_queries.TITLES:
                title = re.sub(p, " ", title)
            title = re.sub(r"[ \t\r\n]+", " ", title).strip(" ")
        assert r["title"] == title
