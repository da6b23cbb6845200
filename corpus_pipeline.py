"""A training corpus from raw documents: five stages, each a function of a DataFrame.

Every stage works on what the one before it kept; the driver of the pipeline writes each
result as Parquet and reads it again. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulse.llm.common import stored
from pulse.llm.contamination import phrase_matches
from pulse.llm.languages import UNDETERMINED, identify_languages, learn_languages
from pulse.llm.mixing import mix
from pulse.llm.neardup import with_classes
from pulse.llm.repeats import repeated_bytes


def _like(docs: DataFrame, found: DataFrame) -> DataFrame:
    return found.select([F.col(f"`{c}`") for c in docs.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts whose language cannot be determined (null, empty, without a letter).

    Each row is judged by its text alone, so repeated rows and null ids are kept or dropped alike.
    """
    found = identify_languages(docs, learn_languages(docs))
    return _like(docs, found.filter(F.col("lang_pred") != UNDETERMINED))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each class of near duplicates.

    Rows with a null id belong to no class and stay. Of rows with equal id and text the least
    one by its columns stays, also of those with a null id; rows with equal ids and texts
    of different classes are different documents.
    """
    found = with_classes(docs)
    kept = _like(docs, found.filter(F.col("class_id").isNull() | (F.col("class_id") == F.col("doc_id"))))
    repeated = docs.groupBy("doc_id").count().filter("count > 1")
    if not repeated.limit(1).count():
        return kept
    rows = kept.groupBy("doc_id", F.sha2("text", 256).alias("__text")).agg(F.min(F.struct(*[f"`{c}`" for c in docs.columns])).alias("row"))
    return rows.select("row.*")


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that repeat an earlier document; texts with nothing but white space left go.

    Null and empty texts have nothing to cut and stay. Rows with equal ids do not cut each other.
    """
    found = repeated_bytes(docs)
    kept = F.when(F.col("text").isNull(), F.lit(None)).otherwise(F.col("kept_text"))
    found = found.withColumn("text", kept).withColumn("n_chars", F.length("text").cast("long"))
    return _like(docs, found.filter((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\s]")))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item.

    Each row is judged by its text; null and empty texts hold none and stay, as do null ids without one.
    """
    found = phrase_matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _like(docs, found.filter(~F.col("contaminated")))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rates that move the domains to their target weights; documents with no copy go.

    Every row has its own rate; rows with equal texts have equal rates, null ids included.
    """
    found = mix(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.filter(F.col("copies") > 0).select(*[f"`{c}`" for c in docs.columns], "n_tokens", "rate", "copies")


STAGES = [
    ("language ID", language_id),
    ("MinHash near-dedup", near_dedup),
    ("suffix-array dedup", suffix_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", source_mixing),
]

#: The stages learn models and compare hashes, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "stage")
    return docs
