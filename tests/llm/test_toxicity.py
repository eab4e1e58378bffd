import math

import numpy as np

from vacantia.llm import toxicity as tox


def brute_chain(chain, text):
    """Probabilities by the models' definition, from all features of a text."""
    features = {f for s in (text or "").lower().split() for f in tox._features(s)}
    p = []
    for m in chain.models:
        x = m.bias + sum(w for f, w in m.weights.items() if f in features) + sum(a * b for a, b in zip(m.earlier, p, strict=True))
        p.append(1 / (1 + math.exp(-min(30, max(-30, x)))))
    return p


def test_whole_table_against_the_definition(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    chain = tox.train(docs, tox.label_table(spark.read.parquet("/root/testdata/sf0.01/labels.parquet")), tox.CATEGORIES)
    for r in tox.score(docs, chain).collect():
        assert np.allclose(brute_chain(chain, r["text"]), [r["p_low_quality"], r["p_toxic"]])
        assert r["is_toxic"] == (r["p_toxic"] >= chain.thresholds[1])


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = tox.label_table(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"))
    chain = tox.train(docs, labels.where("doc_id % 3 > 0"), tox.CATEGORIES, max_train=2_500)
    held = tox.score(docs, chain).join(labels.where("doc_id % 3 = 0").withColumnRenamed("toxic", "y"), "doc_id")
    rows = held.select("y", "is_toxic").collect()
    hits = sum(r["y"] and r["is_toxic"] for r in rows)
    # about one toxic label in eight is on a text without any toxic word
    assert hits >= 0.8 * sum(r["y"] for r in rows)
    assert hits >= 0.95 * sum(r["is_toxic"] for r in rows)
    assert len(chain.models[0].earlier) == 0 and len(chain.models[1].earlier) == 1


def test_later_model_uses_earlier_probability():
    rng = np.random.default_rng(0)
    a = rng.random(600) < 0.5
    features = [np.array([1, 2 if x else 3]) for x in a]
    labels = np.column_stack([a, a])
    chain = tox.fit_chain(features, labels, np.arange(600) % 3, ("a", "b"))
    assert chain.models[1].earlier[0] > 0


def test_edges_of_input(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "bad bad word " * 50_000, "x"), (3, "fine", "x")], "doc_id long, text string, p_toxic string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = tox.report(docs, none).collect()
    assert len(got) == 4 and not any(r["toxic"] for r in got)
    one = spark.createDataFrame([(1, 1, 0), (2, None, 1), (2, 1, 0), (3, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    assert not any(r["toxic"] for r in tox.report(docs, one).collect())
    assert tox.report(docs.limit(0), one).count() == 0
