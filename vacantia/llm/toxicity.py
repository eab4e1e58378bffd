"""Toxicity by a chain of linear classifiers.

Categories are predicted in order. Each has a sparse logistic model over the words of a text and
their beginnings; a later model also gets the probabilities of the earlier categories. In training
these are out-of-fold predictions, so a model never sees a probability that was fitted to the row's
own label. Models are fitted on a bounded sample of labelled rows (``max_train``, those with the
smallest hash of their id) and applied to every document over its whole text.

Defined results: null and empty texts have no words and get the probabilities of the biases; without
labelled rows of both classes a category's probability is its share in the sample (0 without a
sample) and nothing is flagged; labels that are null are left out; repeated labels of an id count by
their largest value; repeated documents are scored each, and in training the one with the smallest
features counts; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacantia.llm.ids import unused
from vacantia.llm.memory import forget, release, small_batches

#: Labelled rows used for fitting, folds, and bits of a hashed feature.
MAX_TRAIN, FOLDS, BITS = 6_000, 3, 20
#: Lengths of the word beginnings that are features besides the whole word.
HEADS = (2, 3, 4)
STEPS, RATE, PENALTY, LEAST_ROWS = 150, 0.3, 2e-4, 4
#: A feature is kept if its shares in the two classes are so many standard errors apart.
APART = 4.0
CACHE_WORDS = 200_000
#: Texts that are worked on at once.
ROWS = 500
_WORD, _MARKS = re.compile(r"\w+"), re.compile(r"[^\w\s]{2,}")


def _features(stretch: str) -> list[int]:
    """Hashed features of the words and runs of marks in a stretch without white space, lower case."""
    out = []
    for word in _WORD.findall(stretch):
        names = {word} | {word[:n] + "*" for n in HEADS if len(word) >= n}
        out += [xxhash.xxh32_intdigest(x) & ((1 << BITS) - 1) for x in names]
    return out + [xxhash.xxh32_intdigest(x) & ((1 << BITS) - 1) for x in _MARKS.findall(stretch)]


@dataclass
class Linear:
    """A logistic model: bias, sparse weights of features, weights of earlier probabilities."""

    bias: float
    weights: dict[int, float]
    earlier: list[float]


@dataclass
class Chain:
    categories: tuple[str, ...]
    models: list[Linear]
    thresholds: list[float]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def _fit(rows: np.ndarray, cols: np.ndarray, width: int, extra: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """L1-penalized logistic regression by proximal adaptive gradient steps, over the features
    that tell the classes apart."""
    n = max(1, len(y))
    share = float(y.mean()) if len(y) else 0.0
    if not 0 < share < 1:
        return (-30.0 if share == 0 else 30.0), np.zeros(width), np.zeros(extra.shape[1])
    with_it, positive = np.bincount(cols, minlength=width), np.bincount(cols, y[rows], width)
    p, n1 = with_it / n, y.sum()
    error = np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n1 + 1 / (n - n1)))
    use = (np.abs(positive / n1 - (with_it - positive) / (n - n1)) >= APART * error)[cols]
    rows, cols = rows[use], cols[use]
    bias, w, v = float(np.log(share / (1 - share))), np.zeros(width), np.zeros(extra.shape[1])
    gw, gv, gb = np.full(width, 1e-8), np.full(len(v), 1e-8), 1e-8
    for _ in range(STEPS):
        p = _sigmoid(bias + np.bincount(rows, w[cols], n) + extra @ v)
        r = (p - y) / n
        dw, dv, db = np.bincount(cols, r[rows], width), extra.T @ r, float(r.sum())
        gw, gv, gb = gw + dw * dw, gv + dv * dv, gb + db * db
        step = RATE / np.sqrt(gw)
        w = w - step * dw
        w = np.sign(w) * np.maximum(np.abs(w) - step * PENALTY, 0.0)
        v = v - RATE / np.sqrt(gv) * dv
        bias -= RATE / np.sqrt(gb) * db
    return bias, w, v


def fit_chain(features: list[np.ndarray], labels: np.ndarray, folds: np.ndarray, categories: Sequence[str]) -> Chain:
    """The chain from rows' hashed features, labels (rows by categories) and fold numbers."""
    ids, counts = np.unique(np.concatenate(features), return_counts=True) if len(features) else (np.empty(0, int), np.empty(0, int))
    ids = ids[counts >= LEAST_ROWS]
    kept = [at[ids[at] == f].astype(np.int32) for f in features for at in [np.minimum(np.searchsorted(ids, f), len(ids) - 1)]] if len(ids) else [np.empty(0, np.int32) for _ in features]
    row = np.repeat(np.arange(len(kept), dtype=np.int32), [len(f) for f in kept])
    col = np.concatenate(kept) if kept else np.empty(0, dtype=np.int32)
    n, width = len(features), len(ids)
    earlier, models, thresholds = np.zeros((n, 0)), [], []
    for k in range(len(categories)):
        y = labels[:, k].astype(float)
        out = np.zeros(n)
        for fold in range(FOLDS):
            mine = folds == fold
            index = np.cumsum(~mine) - 1
            use = ~mine[row]
            bias, w, v = _fit(index[row[use]], col[use], width, earlier[~mine], y[~mine])
            out[mine] = _sigmoid(bias + np.bincount(row, w[col], n)[:n] + earlier @ v)[mine] if n else 0
        bias, w, v = _fit(row, col, width, earlier, y)
        used = np.flatnonzero(w)
        models.append(Linear(bias, dict(zip(ids[used].tolist(), w[used].tolist(), strict=True)), v.tolist()))
        thresholds.append(_threshold(out, y))
        earlier = np.column_stack([earlier, out])
    return Chain(tuple(categories), models, thresholds)


def _threshold(p: np.ndarray, y: np.ndarray) -> float:
    """Where F1 of out-of-fold predictions is largest; above 1 if only one class is there."""
    if not 0 < y.sum() < len(y):
        return 2.0
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    best = int(np.argmax(f1))
    below = p[order[best + 1]] if best + 1 < len(y) else 0.0
    return float((p[order[best]] + below) / 2)


def features_column(text: Column) -> Column:
    """Distinct hashed features of a text column, as 32-bit numbers in a binary."""

    @F.arrow_udf(T.BinaryType())
    def text_features(texts: pa.Array) -> pa.Array:
        found = [sorted({f for s in set((t or "").lower().split()) for f in _features(s)}) for t in texts.to_pylist()]
        release()
        return pa.array([np.array(f, dtype=np.int32).tobytes() for f in found], pa.binary())

    return text_features(text)


def train(docs: DataFrame, labels: DataFrame, categories: Sequence[str], id_col: str = "doc_id", text: str = "text", max_train: int = MAX_TRAIN) -> Chain:
    """A chain fitted on at most ``max_train`` labelled documents."""
    small_batches(docs.sparkSession)
    names = [f"y{i}" for i in range(len(categories))]
    known = labels.select(F.col(id_col).alias("id"), *[F.col(c).cast("int").alias(n) for c, n in zip(categories, names, strict=True)]).dropna()
    known = known.groupBy("id").agg(*[F.max(n).alias(n) for n in names])
    sample = known.orderBy(F.xxhash64("id"), "id").limit(max_train)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    known = texts.join(F.broadcast(sample), "id").select("id", *names, features_column(F.col("text")).alias("f"))
    rows = sorted(known.groupBy("id", *names).agg(F.min("f").alias("f")).collect(), key=lambda r: r["id"])
    found = [np.frombuffer(r["f"], dtype=np.int32) for r in rows]
    y = np.array([[r[n] for n in names] for r in rows], dtype=float).reshape(len(rows), len(names))
    folds = np.array([xxhash.xxh64_intdigest(str(r["id"])) % FOLDS for r in rows], dtype=np.int64)
    chain = fit_chain(found, y, folds, categories)
    del rows, found
    release()
    return chain


def score(df: DataFrame, chain: Chain, text: str = "text") -> DataFrame:
    """``df`` with ``p_<category>`` and ``is_<category>`` of each category, replaced if present."""
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(chain)

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def chained(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        forget()
        chain = shared.value
        wanted = set().union(*(m.weights for m in chain.models))
        cache: dict[str, tuple[int, ...]] = {}

        def probabilities(t: str | None) -> list[float]:
            found: set[int] = set()
            for stretch in set((t or "").lower().split()):
                got = cache.get(stretch)
                if got is None:
                    if len(cache) >= CACHE_WORDS:
                        cache.clear()
                    got = cache[stretch] = tuple(f for f in _features(stretch) if f in wanted)
                if got:
                    found.update(got)
            order, p = sorted(found), []
            for m in chain.models:
                x = m.bias + sum(m.weights.get(f, 0.0) for f in order) + sum(a * b for a, b in zip(m.earlier, p, strict=True))
                p.append(float(_sigmoid(np.float64(x))))
            return p

        for texts in batches:
            found = [probabilities(t) for at in range(0, len(texts), ROWS) for t in texts.slice(at, ROWS).to_pylist()]
            yield pa.array(found, pa.list_(pa.float64()))
        cache.clear()
        release()

    p = unused(df, "__p")
    df = df.withColumn(p, chained(F.col(text)))
    for i, (c, limit) in enumerate(zip(chain.categories, chain.thresholds, strict=True)):
        df = df.withColumn(f"p_{c}", F.col(p)[i]).withColumn(f"is_{c}", F.col(p)[i] >= limit)
    return df.drop(p)


CATEGORIES = ("low_quality", "toxic")


def label_table(labels: DataFrame) -> DataFrame:
    """The label table with a column for each category of the chain."""
    return labels.select("doc_id", (F.lit(1) - F.col("quality")).alias("low_quality"), "toxic")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: probabilities of the chain and whether it is toxic."""
    chain = train(docs, label_table(labels), CATEGORIES)
    rows = score(docs.select("doc_id", "text"), chain)
    return rows.select("doc_id", "p_low_quality", "p_toxic", F.col("is_toxic").alias("toxic"))
