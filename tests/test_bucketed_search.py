"""The bucketed vector search: recall against all vectors, and what it looks at."""

import numpy as np
import pytest

from vacantia.operators import matching
from vacantia.plans import matching_queries


def pairs(df):
    return {(r["query_id"], r["item_id"]) for r in df.collect()}


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_over_the_stated_queries(spark, sf):
    d = f"/root/testdata/{sf}"
    exact = pairs(matching_queries.QUERIES["m01_topk_cosine"][0](spark, d))
    found = pairs(matching_queries.QUERIES["m01_topk_bucketed"][0](spark, d))
    assert len(exact & found) / len(exact) >= 0.9 and len(found) == len(exact)


def test_clusters_take_few_buckets(spark):
    """Vectors with true neighbours are found in a small part of the buckets."""
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((40, 32))
    rows = [(i, (centres[i % 40] + 0.25 * rng.standard_normal(32)).tolist()) for i in range(4_000)]
    rows += [(5_000 + i, rows[7][1]) for i in range(300)] + [(9_000, None), (9_001, [0.0] * 32), (9_002, [])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    q = df.where("id % 20 = 0")
    kw = {"query_id": "id", "item_id": "id", "vector": "v"}
    exact = pairs(matching.topk_cosine(q, df.where("id <> 9002"), 10, **kw))
    near = pairs(matching.topk_bucketed(q, df.where("id <> 9002"), 10, **kw, bits=10, radius=2))  # 56 of 1,024 buckets
    assert len(exact & near) / len(exact) >= 0.9
    assert pairs(matching.topk_bucketed(q, df.where("id <> 9002"), 10, **kw, bits=4, radius=4)) == exact
    assert matching.topk_bucketed(q.limit(0), df, 10, **kw).count() == 0
    assert matching.topk_bucketed(q, df.limit(0), 10, **kw).count() == 0


def test_blocks_and_copies_change_no_result(spark, monkeypatch):
    """Equal vectors have equal scores in any block, so ties go by id."""
    rng = np.random.default_rng(3)
    some = rng.standard_normal((40, 24))
    df = spark.createDataFrame([(i, some[i % 40].tolist()) for i in range(600)] + [(900, [0.0] * 24), (901, None)], "id long, v array<double>")
    q = df.where("id % 20 = 0")
    kw = {"query_id": "id", "item_id": "id", "vector": "v"}
    unit = some / np.linalg.norm(some, axis=1, keepdims=True)
    want = set()
    for i in range(0, 600, 20):
        near = np.round(unit @ unit[i % 40], 9)
        want |= {(i, j) for j in sorted(range(600), key=lambda j: (-near[j % 40], j))[:10]}
    for block in (4_000, 37):
        monkeypatch.setattr(matching, "QUERY_BLOCK", block)
        monkeypatch.setattr(matching, "ITEM_BLOCK", block)
        assert pairs(matching.topk_cosine(q, df, 10, **kw)) == want
        assert pairs(matching.topk_bucketed(q, df, 10, **kw, bits=3, radius=3)) == want
