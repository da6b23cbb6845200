"""Mixing to target weights with soft domain membership.

A classifier learned from a table of labels gives every document a posterior over the
domains (``DOMAINS``: clean, poor and toxic, from the quality and toxicity labels). The
rates r >= 0 of the documents minimise the squared difference between the expected domain
totals, the sum of rate x tokens x posterior, and the targets, starting at rate 1. Each step is a
projected gradient step in the metric of the tokens, scaled by the small matrix of domain
second moments; a step is one vector of domain weights, so the rate of a document follows
from its own posterior and the steps, and only sums by domain reach the driver.

The classifier is a softmax over hashed words, word beginnings and word ends. It is fitted
on at most about ``MOST_LABELLED`` labelled rows, chosen by a hash of the id; posteriors,
totals and rates cover every row. ``copies`` is the rate rounded up or down by a hash of id
and text, so that its expectation is the rate.

Null and empty texts have no tokens and the posterior of a text without words. Without
labels there is no classifier: all domains are equally likely. A domain without any mass
cannot reach its target; the others are fitted as well as they can be. Rows with null labels
are not learned from. Extra columns pass through; columns named as a result column are
replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulse.llm.common import LOWER, SPACE, SpanHashes, extended, slices, stored, utf8, without, words

DOMAINS = ("clean", "poor", "toxic")
#: Shares of all tokens; the total stays that of the documents.
TARGETS = {"clean": 0.86, "poor": 0.1, "toxic": 0.04}
MOST_LABELLED = 5000
HASHED = 1 << 20
STEPS = 40
CLOSE = 1e-4
EPOCHS = 8


def _features(column) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of all words (3 per word) and the number of words of each row."""
    data, starts = utf8(column)
    data = LOWER[data]
    begin, end, row = words(data, starts, ~SPACE)
    h = SpanHashes(data)
    spans = np.stack(
        [
            h.spans(begin, end),
            h.spans(begin, np.minimum(end, begin + 5)) ^ np.uint64(0x5555),
            h.spans(np.maximum(begin, end - 2), end) ^ np.uint64(0xAAAA),
        ],
        axis=1,
    )
    return (spans & np.uint64(HASHED - 1)).astype(np.int32), np.bincount(row, minlength=len(starts) - 1)


class DomainModel:
    """Softmax weights over hashed features; ``weights`` is None without labels."""

    def __init__(self, weights: np.ndarray | None = None, bias: np.ndarray | None = None):
        self.weights, self.bias = weights, bias

    def posteriors(self, features: np.ndarray, size: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full((len(size), len(DOMAINS)), 1 / len(DOMAINS))
        logits = np.tile(self.bias.astype(np.float64), (len(size), 1))
        some = size > 0
        if some.any():
            start = np.concatenate([[0], np.cumsum(size[some])[:-1]])
            word = self.weights[features].sum(1)
            logits[some] += np.add.reduceat(word, start, axis=0) / np.sqrt(size[some])[:, None]
        logits -= logits.max(1, keepdims=True)
        p = np.exp(logits)
        return p / p.sum(1, keepdims=True)


def _sample_features(batches):
    for whole in batches:
        for batch in slices(whole, "text"):
            features, size = _features(batch.column("text"))
            cut = np.concatenate([[0], np.cumsum(size)])
            packed = [features[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("y"), pa.array(packed, pa.binary())], names=["y", "features"]
            )


def _fit(texts: list[bytes], y: np.ndarray) -> DomainModel:
    """AdaGrad over the features of the bounded sample, in small blocks of documents."""
    size = np.array([len(t) // 12 for t in texts])
    share = np.bincount(y, minlength=len(DOMAINS)) + 0.5
    model = DomainModel(np.zeros((HASHED, len(DOMAINS)), np.float32), np.log(share / share.sum()))
    seen = np.full(HASHED, 1e-3, np.float32)
    order = np.random.default_rng(0).permutation(len(y))
    for _ in range(EPOCHS):
        for lo in range(0, len(order), 64):
            own = order[lo : lo + 64]
            rows = np.concatenate([np.frombuffer(texts[d], np.int32).reshape(-1, 3) for d in own])
            p = model.posteriors(rows, size[own])
            p[np.arange(len(own)), y[own]] -= 1
            g = np.repeat(p / np.sqrt(np.maximum(size[own], 1))[:, None], 3 * size[own], axis=0)
            which, inverse = np.unique(rows.ravel(), return_inverse=True)
            total = np.stack([np.bincount(inverse, g[:, k], len(which)) for k in range(len(DOMAINS))], 1)
            seen[which] += (total**2).mean(1)
            model.weights[which] -= (0.3 * total / np.sqrt(seen[which])[:, None]).astype(np.float32)
            model.bias -= 0.02 * p.sum(0)
    return model


def learn_domains(
    docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", most=MOST_LABELLED
) -> DomainModel:
    """Fits the classifier on labelled rows: an id counts once, with its worst label and least text."""
    good, toxic = F.col("quality").cast("int"), F.col("toxic").cast("int")
    marks = labels.select(
        F.col(id_col).alias("id"), F.when(toxic == 1, 2).when(good == 0, 1).when(good == 1, 0).alias("y")
    ).filter(F.col("id").isNotNull() & F.col("y").isNotNull())
    marks = marks.groupBy("id").agg(F.max("y").alias("y"))
    n = marks.count()
    if not n:
        return DomainModel()
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / F.lit(1 << 20)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sample = marks.filter(place < min(1.0, most / n)).join(texts, "id")
    sample = sample.groupBy("id").agg(F.min("text").alias("text"), F.first("y").alias("y")).orderBy("id").select("text", "y")
    rows = sample.mapInArrow(_sample_features, "y int, features binary").toArrow()
    if not rows.num_rows:
        return DomainModel()
    return _fit(rows.column("features").to_pylist(), np.asarray(rows.column("y")).astype(np.int64))


def rates(posteriors: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    """Rates after the steps, from rate 1."""
    r = np.ones(len(posteriors))
    for step in steps:
        r = np.maximum(0.0, r + posteriors @ step)
    return r


def _posterior_columns():
    return [T.StructField("n_tokens", T.LongType()), T.StructField("posterior", T.ArrayType(T.DoubleType()))]


def with_posteriors(docs: DataFrame, model: DomainModel, text_col="text", keep: bool = True) -> DataFrame:
    """The rows (or, without ``keep``, nothing else) with ``n_tokens`` and ``posterior``."""
    docs = without(docs, "n_tokens", "posterior")
    columns = docs.columns if keep else []
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches):
        for whole in batches:
            for batch in slices(whole, text_col):
                features, size = _features(batch.column(text_col))
                p = shared.value.posteriors(features, size)
                values = pa.ListArray.from_arrays(
                    pa.array(np.arange(len(p) + 1, dtype=np.int32) * len(DOMAINS)), pa.array(p.ravel())
                )
                yield extended(batch, columns, {"n_tokens": pa.array(size.astype(np.int64)), "posterior": values})

    fields = docs.schema.fields if keep else []
    return docs.mapInArrow(predict, T.StructType(fields + _posterior_columns()))


def fit_steps(light: DataFrame, targets: dict[str, float], total: float | None = None, most=STEPS):
    """Steps of domain weights, and the totals by domain before and after them.

    ``light`` has ``n_tokens`` and ``posterior``; every step is one pass over it that sums by
    domain in the tasks.
    """
    k = len(DOMAINS)

    def sums(steps):
        def add(batches):
            expected, moments = np.zeros(k), np.zeros((k, k))
            for batch in batches:
                p = np.asarray(batch.column("posterior").flatten()).reshape(-1, k)
                t = np.asarray(batch.column("n_tokens")).astype(float)
                expected += (rates(p, steps) * t) @ p
                moments += (p * t[:, None]).T @ p
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(k + k * k), pa.int32()), pa.array(np.concatenate([expected, moments.ravel()]))],
                names=["i", "x"],
            )

        rows = light.mapInArrow(add, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
        out = np.zeros(k + k * k)
        for r in rows:
            out[r.i] = r.x
        return out[:k], out[k:].reshape(k, k)

    steps: list[np.ndarray] = []
    expected, moments = sums(steps)
    first = expected
    whole = expected.sum() if total is None else total
    share = np.array([targets.get(d, 0.0) for d in DOMAINS])
    aim = whole * share / share.sum()
    scale = moments + np.eye(k) * 1e-9 * max(1.0, moments.trace())
    while len(steps) < most and np.abs(aim - expected).max() > CLOSE * max(1.0, whole):
        steps.append(np.linalg.solve(scale, aim - expected))
        expected, _ = sums(steps)
    return steps, first, expected


def mix(
    docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, total=None, id_col="doc_id", text_col="text"
) -> DataFrame:
    """The rows with ``n_tokens, posterior, rate, copies``."""
    docs = without(docs, "rate", "copies")
    model = learn_domains(docs, labels, id_col, text_col)
    light = stored(with_posteriors(docs.select(text_col), model, text_col, keep=False), "posteriors")
    steps, _, _ = fit_steps(light, targets, total)
    found = with_posteriors(docs, model, text_col)

    def rated(p):
        """The steps as an expression over the posterior."""
        rate = F.lit(1.0)
        for step in steps:
            move = sum((F.get(p, F.lit(k)) * float(x) for k, x in enumerate(step)), F.lit(0.0))
            rate = F.greatest(F.lit(0.0), rate + move)
        return rate

    place = F.pmod(F.xxhash64(id_col, text_col, F.lit("copies")), F.lit(1 << 30)) / F.lit(1 << 30)
    return found.withColumn("rate", rated(F.col("posterior"))).withColumn(
        "copies", F.floor(F.col("rate") + place).cast("long")
    )


def op5_source_mixing(spark, sf_dir: str) -> DataFrame:
    """Domain posteriors, rate and copies of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    mixed = mix(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    named = [F.get("posterior", F.lit(k)).alias(f"p_{d}") for k, d in enumerate(DOMAINS)]
    return mixed.select("doc_id", "n_tokens", *named, "rate", "copies")
