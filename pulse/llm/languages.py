"""Language identification by multilingual mixture inference.

A document is a bag of byte n-grams drawn from a mixture of languages. The gram
distribution of each language is learned from labelled rows; expectation-maximisation finds
the proportions of a document, and the set of languages is the prefix of the languages in
order of proportion with the highest penalised likelihood.

The model is a table of ``BUCKETS`` gram buckets by language and is small whatever the
corpus. It is fitted on at most about ``PER_LANGUAGE`` rows of each language, chosen by a
hash of the id; prediction covers every row and its whole text.

Null texts and texts without a letter are ``und`` with score 0, as is everything where
there are no labelled rows. Rows with a null id are never learned from and not held out. Repeated
rows are each predicted; equal proportions go to the language first in order of text. Extra columns pass
through; columns named as a result column are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulse.llm.common import extended, fold, slices, utf8, without

GRAM = 3
BUCKETS = 1 << 14
PER_LANGUAGE = 3000
MOST_LANGUAGES = 1000
STEPS = 12
#: Grams overlap, so a letter is counted GRAM times; likelihoods are weighed accordingly.
PENALTY = 2.0
UNDETERMINED = "und"
#: Digits, fractions, circled and Roman numerals are no letters.
_NOT_LETTERS = regex.compile(r"\P{L}+")


def gram_buckets(column) -> tuple[list[np.ndarray], np.ndarray]:
    """Gram buckets of each text, letters lower-cased and everything else one space."""
    cleaned = [
        f" {_NOT_LETTERS.sub(' ', x.lower()).strip()} " if x else "" for x in column.to_pylist()
    ]
    data, starts = utf8(pa.array(cleaned, pa.string()))
    d = data.astype(np.uint32)
    h = np.zeros(max(0, len(d) - GRAM + 1), np.uint32)
    for k in range(GRAM):
        h = h * np.uint32(0x01000193) + d[k : k + len(h)]
    h = ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(32 - 14)).astype(np.int64)
    has_letters = np.array([len(c) > 2 for c in cleaned], bool)
    return [h[lo : max(lo, hi - GRAM + 1)] for lo, hi in zip(starts[:-1], starts[1:], strict=True)], has_letters


class MixtureModel:
    """Languages and log gram probabilities (buckets x languages)."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        share = counts.T.astype(np.float64) + 0.05
        self.log = np.log(share / share.sum(0)).astype(np.float32) if len(languages) else share
        self.share = np.exp(self.log)

    def proportions(self, a: np.ndarray, c: np.ndarray, steps: int = STEPS):
        """Mixture weights by expectation-maximisation, and the log-likelihood."""
        n, weights = c.sum(), np.full(a.shape[1], 1 / a.shape[1], np.float32)
        for _ in range(steps):
            weights *= a.T @ (c / (a @ weights)) / n
        return weights, float(c @ np.log(a @ weights))

    def infer(self, grams: np.ndarray) -> tuple[list[tuple[str, float]], float]:
        """Selected languages with their shares in descending order, and a score."""
        counts = np.bincount(grams, minlength=BUCKETS)
        seen = np.flatnonzero(counts)
        c = counts[seen].astype(np.float32)
        alone = c @ self.log[seen]
        best = int(alone.argmax())
        relative = np.exp((alone - alone[best]) / GRAM)
        sure = float(relative[best] / relative.sum())
        a = self.share[seen]
        weights, _ = self.proportions(a, c)
        order = [best] + [int(k) for k in np.argsort(-weights) if k != best]
        chosen, shares = [best], np.ones(1, np.float32)
        value = float(alone[best]) / GRAM
        price = PENALTY * np.log(max(2.0, float(c.sum())))
        for k in range(2, len(order) + 1):
            w, fit = self.proportions(a[:, order[:k]], c)
            if fit / GRAM - price * (k - 1) <= value:
                break
            value, chosen, shares = fit / GRAM - price * (k - 1), order[:k], w
        ranked = sorted(zip(shares.tolist(), chosen, strict=True), key=lambda x: (-x[0], x[1]))
        mix = [(self.languages[k], s) for s, k in ranked]
        top = mix[0][1]
        return mix, min(1.0, top * (sure if len(mix) == 1 else 1.0))


def learn_languages(
    docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", per_language=PER_LANGUAGE
) -> MixtureModel:
    """Fits the gram tables on labelled rows of the three training folds."""
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")
    ).filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold("id", 4) != 2))
    sizes = rows.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} values of {lang_col}")
    if not sizes:
        return MixtureModel([], np.zeros((0, BUCKETS)))
    part = F.create_map(*[F.lit(x) for r in sizes for x in (r.lang, per_language / r["count"])])
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / F.lit(1 << 20)
    sample = rows.filter(place < part[F.col("lang")]).select("lang", "text")

    def counts(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            grams, _ = gram_buckets(batch.column("text"))
            for lang, g in zip(langs, grams, strict=True):
                own = total.setdefault(lang, np.zeros(BUCKETS, np.int64))
                own += np.bincount(g, minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.string()), pa.array([x.tobytes() for x in total.values()], pa.binary())],
            names=["lang", "counts"],
        )

    def add(table):
        whole = sum(np.frombuffer(x, np.int64) for x in table.column("counts").to_pylist())
        return pa.table({"lang": table.column("lang").slice(0, 1), "counts": pa.array([whole.tobytes()], pa.binary())})

    kind = "lang string, counts binary"
    found = sample.mapInArrow(counts, kind).groupBy("lang").applyInArrow(add, kind)
    tables = {r.lang: np.frombuffer(r.counts, np.int64) for r in found.collect()}
    names = sorted(tables)
    return MixtureModel(names, np.array([tables[n] for n in names]).reshape(len(names), BUCKETS))


def identify_languages(docs: DataFrame, model: MixtureModel, text_col: str = "text") -> DataFrame:
    """The rows with ``lang_pred``, ``score`` and ``lang_mix`` (languages and shares)."""
    docs = without(docs, "lang_pred", "score", "lang_mix")
    columns = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches):
        model = shared.value
        for whole in batches:
            for batch in slices(whole, text_col):
                pred, score, mix = [], [], []
                grams, lettered = gram_buckets(batch.column(text_col))
                for g, ok in zip(grams, lettered, strict=True):
                    if not ok or not len(g) or not model.languages:
                        found, sure = [(UNDETERMINED, 0.0)], 0.0
                    else:
                        found, sure = model.infer(g)
                    pred.append(found[0][0])
                    score.append(sure)
                    mix.append([{"lang": n, "share": s} for n, s in found])
                yield extended(
                    batch,
                    columns,
                    {
                        "lang_pred": pa.array(pred, pa.string()),
                        "score": pa.array(score, pa.float64()),
                        "lang_mix": pa.array(mix, _MIX),
                    },
                )

    schema = T.StructType(
        docs.schema.fields
        + [
            T.StructField("lang_pred", T.StringType()),
            T.StructField("score", T.DoubleType()),
            T.StructField(
                "lang_mix",
                T.ArrayType(
                    T.StructType(
                        [T.StructField("lang", T.StringType()), T.StructField("share", T.DoubleType())]
                    )
                ),
            ),
        ]
    )
    return docs.mapInArrow(predict, schema)


_MIX = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    """Language of every document, learned from three of four id folds."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn_languages(docs)
    found = identify_languages(docs.select("doc_id", "text"), model)
    return found.select(
        "doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "lang_mix"
    )
