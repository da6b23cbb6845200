"""Toxicity by a weighted lexicon.

Texts are folded first: homoglyphs to Latin letters, digits and signs inside words to the
letters they stand for, marks and invisible characters removed. Terms are beginnings of
words or whole words; an Aho-Corasick automaton finds them all in one pass. A word counts
with its heaviest term, unless an exception phrase covers it. The sum and the sum by length
in words give the score through a logistic function.

The terms, their weights, the exceptions and the logistic function are learned from at most
about ``MOST_LABELLED`` labelled rows, chosen by a hash of the text, copies once. At most
``MOST_TERMS`` terms, those with the greatest count times weight, and as many exceptions, the most
frequent, are kept (equal ones: least text first); that bounds the model, not the texts. Scoring covers every row and its whole text. Null and empty texts have no words and get the score
of a text without a match. Rows with a null label or id are not learned from. Without rows
of both labels every score is the share of label 1 (0 if there is none). Extra columns pass
through; columns named as a result column are replaced.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulse.llm.common import extended, fold, slices, without

MOST_LABELLED = 24_000
MOST_TERMS = 4000
LENGTHS = range(4, 9)
LEAST_SHARE = 0.006  # of the rows with label 1, that hold a term
LEAST_WEIGHT = 3.0
LEAST_EXCEPTION = 3
LEAST_CLEAN = 0.9

# Characters that look like Latin letters, and digits and signs used as such.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j",
    "ѕ": "s", "ԁ": "d", "ӏ": "l", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "г": "r",
    "α": "a", "ε": "e", "ι": "i", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "ν": "v", "κ": "k",
    "χ": "x", "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ß": "ss",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "l"}

_TABLE = {ord(k): v for k, v in {**HOMOGLYPHS, **DIGITS}.items()}
_TABLE |= {c: None for c in [*range(0x300, 0x370), 0xAD, *range(0x200B, 0x2010), 0x2060, 0xFEFF]}
_SIGN_INSIDE = re.compile(r"(?<=[^\W\d_])([@$!|])(?=[^\W\d_])")
_NOT_WORD = re.compile(r"[\W_]+")


def folded(text: str | None) -> str:
    """The text as words between single spaces, with a space at both ends."""
    if not text:
        return " "
    text = text.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
    text = text.translate(_TABLE)
    if any(s in text for s in SIGNS):
        text = _SIGN_INSIDE.sub(lambda m: SIGNS[m[1]], text)
    text = _NOT_WORD.sub(" ", text).strip()
    return f" {text} " if text else " "


class Lexicon:
    """Terms with weights, exception phrases, and the coefficients of the score."""

    def __init__(self, terms: dict[str, float], exceptions: list[str] = (), coefficients=(0.0, 0.0, 0.0)):
        self.terms, self.exceptions, self.coefficients = dict(terms), list(exceptions), tuple(coefficients)
        self._automaton = None

    def __getstate__(self):
        return self.terms, self.exceptions, self.coefficients

    def __setstate__(self, state):
        self.terms, self.exceptions, self.coefficients = state
        self._automaton = None

    def hits(self, text: str) -> dict[int, float]:
        """Places of the words that count, with the heaviest weight of each."""
        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for term, weight in self.terms.items():
                self._automaton.add_word(term, (len(term), weight))
            for phrase in self.exceptions:
                self._automaton.add_word(f" {phrase} ", (len(phrase) + 2, 0.0))
            if len(self._automaton):
                self._automaton.make_automaton()
        found: dict[int, float] = {}
        if not len(self._automaton):
            return found
        spared = []
        for end, (length, weight) in self._automaton.iter(text):
            start = end - length + 1
            if weight:
                found[start] = max(weight, found.get(start, 0.0))
            else:
                spared.append((start, end))
        for lo, hi in spared:  # both words of the phrase
            for start in [s for s in found if lo <= s < hi]:
                del found[start]
        return found

    def features(self, text: str) -> tuple[float, float]:
        """Weight of the hits, and weight per hundred words, both as log(1 + x)."""
        weight = sum(self.hits(text).values())
        return float(np.log1p(weight)), float(np.log1p(100 * weight / max(1, text.count(" ") - 1)))

    def score(self, text: str) -> float:
        a, b, c = self.coefficients
        x, y = self.features(text)
        return float(1 / (1 + np.exp(-np.clip(a + b * x + c * y, -40, 40))))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Ridge logistic regression by Newton's method on the bounded sample."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-3, 1e-2, 1e-2])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge
        w = w + np.linalg.solve(h, x.T @ (y - p) - ridge @ w)
    return tuple(float(v) for v in w)


def learn_lexicon(
    docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="toxic",
    most=MOST_LABELLED,
) -> Lexicon:
    """Terms, exceptions and score from labelled rows of the four training folds."""
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    marks = marks.filter(F.col("y").isin(0, 1) & (fold("id", 5) != 0)).groupBy("id").agg(F.max("y").alias("y"))
    n = marks.count()
    if not n:
        return Lexicon({}, (), (-40.0, 0.0, 0.0))
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / F.lit(1 << 20)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sample = (
        texts.join(marks.filter(place < min(1.0, most / n)), "id")
        .groupBy(F.xxhash64("text").alias("copy"), "y")
        .agg(F.min("text").alias("text"))
        .select("y", "text")
    )

    def term_counts(batches):
        pos, neg = Counter(), Counter()
        for batch in batches:
            for y, text in zip(batch.column("y").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = set()
                for w in set(folded(text).split()):
                    own.update(f" {w[:k]}" for k in LENGTHS if len(w) >= k)
                    own.add(f" {w} ")
                (pos if y else neg).update(own)
            # a term that no row with label 1 holds is not needed
        keys = list(set(pos) | {k for k in neg if neg[k] > 1})
        for lo in range(0, len(keys), 50_000):
            part = keys[lo : lo + 50_000]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(part, pa.string()),
                    pa.array([pos[k] for k in part], pa.int64()),
                    pa.array([neg[k] for k in part], pa.int64()),
                ],
                names=["term", "pos", "neg"],
            )

    totals = {r.y: r["count"] for r in sample.groupBy("y").count().collect()}
    p, q = totals.get(1, 0), totals.get(0, 0)
    if not p or not q:
        return Lexicon({}, (), (40.0 if p else -40.0, 0.0, 0.0))
    weight = F.log((F.col("pos") + 0.5) / (p + 1)) - F.log((F.col("neg") + 0.5) / (q + 1))
    found = (
        sample.mapInArrow(term_counts, "term string, pos long, neg long")
        .groupBy("term")
        .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        .withColumn("weight", weight)
        .filter((F.col("pos") >= max(3, LEAST_SHARE * p)) & (F.col("weight") >= LEAST_WEIGHT))
        .orderBy(F.desc(F.col("pos") * F.col("weight")), "term")
        .limit(MOST_TERMS)
        .collect()
    )
    lexicon = Lexicon({r.term: r.weight for r in found})
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def phrase_counts(batches):
        seen = Counter()
        for batch in batches:
            for y, text in zip(batch.column("y").to_pylist(), batch.column("text").to_pylist(), strict=True):
                text = folded(text)
                own = set()
                for start in shared.value.hits(text):
                    before = text[:start].rpartition(" ")[2]
                    word, after = (*text[start + 1 :].split(" ", 2), "", "")[:2]
                    own |= {f"{before} {word}"} if before else set()
                    own |= {f"{word} {after}"} if after else set()
                seen.update((phrase, y) for phrase in own)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k[0] for k in seen], pa.string()),
                pa.array([seen[k] * k[1] for k in seen], pa.int64()),
                pa.array([seen[k] * (1 - k[1]) for k in seen], pa.int64()),
            ],
            names=["phrase", "pos", "neg"],
        )

    clean = (
        sample.mapInArrow(phrase_counts, "phrase string, pos long, neg long")
        .groupBy("phrase")
        .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        .filter((F.col("neg") >= LEAST_EXCEPTION) & (F.col("neg") >= LEAST_CLEAN * (F.col("pos") + F.col("neg"))))
        .orderBy(F.desc("neg"), "phrase")
        .limit(MOST_TERMS)
        .collect()
    )
    lexicon = Lexicon(lexicon.terms, [r.phrase for r in clean])
    with_exceptions = docs.sparkSession.sparkContext.broadcast(lexicon)

    def features(batches):
        for batch in batches:
            x = [with_exceptions.value.features(folded(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("y"),
                    pa.array([a for a, _ in x], pa.float64()),
                    pa.array([b for _, b in x], pa.float64()),
                ],
                names=["y", "a", "b"],
            )

    points = sample.mapInArrow(features, "y int, a double, b double").toPandas()
    fit = _logistic(points[["a", "b"]].to_numpy(), points["y"].to_numpy(float))
    return Lexicon(lexicon.terms, lexicon.exceptions, fit)


def score_toxicity(docs: DataFrame, lexicon: Lexicon, text_col: str = "text") -> DataFrame:
    """The rows with ``score``, ``predicted`` and ``n_hits``, the words that counted."""
    docs = without(docs, "score", "predicted", "n_hits")
    columns = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def score(batches):
        own = shared.value
        for whole in batches:
            for batch in slices(whole, text_col):
                texts = [folded(t) for t in batch.column(text_col).to_pylist()]
                scores = [own.score(t) for t in texts]
                yield extended(
                    batch,
                    columns,
                    {
                        "score": pa.array(scores, pa.float64()),
                        "predicted": pa.array([int(s >= 0.5) for s in scores], pa.int32()),
                        "n_hits": pa.array([len(own.hits(t)) for t in texts], pa.int64()),
                    },
                )

    schema = T.StructType(
        docs.schema.fields
        + [
            T.StructField("score", T.DoubleType()),
            T.StructField("predicted", T.IntegerType()),
            T.StructField("n_hits", T.LongType()),
        ]
    )
    return docs.mapInArrow(score, schema)


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from four of five id folds; a null id is not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score_toxicity(docs, learn_lexicon(docs, labels))
    return scored.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted", "n_hits")
