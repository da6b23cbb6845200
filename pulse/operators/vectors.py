"""Document vectors and the searches over them."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulse import fixed
from pulse.config import DEFAULTS, PulseConfig
from pulse.functions.text import fill, snippet
from pulse.models.contracts import EmbeddingModel
from pulse.operators.inference import ERROR, embed, spread_for_inference
from pulse.operators.knn import topk_cosine
from pulse.operators.ranking import first_n_per_group
from pulse.operators.topics import DAY_COUNTRY

FOUND = ["event_date", "country", "topic_doc", "distance", "id"]


def embedding_replies(
    topics: DataFrame, model: EmbeddingModel, cfg: PulseConfig = DEFAULTS
) -> DataFrame:
    """The rows of ``embed_topics`` with ``error``: why a document has no vector."""
    documents = topics.select(
        *DAY_COUNTRY, F.substring("topic_doc", 1, cfg.embed_chars).alias("topic_doc")
    )
    spread = spread_for_inference(documents, DAY_COUNTRY, cfg.embed_rows_per_task)
    return embed(spread, model, "topic_doc").select(
        *DAY_COUNTRY,
        "topic_doc",
        "embedding",
        F.concat("country", F.lit("-"), F.col("event_date").cast("string")).alias("id"),
        ERROR,
    )


def embed_topics(
    topics: DataFrame, model: EmbeddingModel, cfg: PulseConfig = DEFAULTS
) -> DataFrame:
    """One vector per country-day from the first ``embed_chars`` characters.

    A document on which the model fails has a NULL vector, which no search finds.
    """
    return embedding_replies(topics, model, cfg).drop(ERROR)


def similar_to_text(
    embeddings: DataFrame,
    query_text: str,
    model: EmbeddingModel,
    k: int = DEFAULTS.vector_top_k,
) -> DataFrame:
    """The k documents nearest to a free text, which the same model embeds."""
    query = embeddings.sparkSession.range(1).select(
        F.col("id").alias("anchor_id"), model.embed(F.lit(query_text)).alias("embedding")
    )
    found = topk_cosine(embeddings, query, k, payload=[*DAY_COUNTRY, "topic_doc"])
    return found.select(FOUND)


def similar_to_day(
    embeddings: DataFrame,
    country_code: str,
    day: dt.date | str,
    k: int = DEFAULTS.vector_top_k,
    mode: str = "post",
) -> DataFrame:
    """Documents nearest to a (country, day), other days only.

    The country only picks the anchor; every country is searched. ``post`` takes
    k over all rows and then drops the same day, so fewer than k may be left.
    ``pre`` drops first.
    """
    day = dt.date.fromisoformat(day) if isinstance(day, str) else day
    anchor = (
        embeddings.where((F.col("country") == country_code) & (F.col("event_date") == day))
        .orderBy("id")
        .limit(1)
        .select(F.lit(0).alias("anchor_id"), "embedding")
    )
    other_day = F.col("event_date") != day
    base = embeddings.where(other_day) if _is_pre(mode) else embeddings
    found = topk_cosine(base, anchor, k, payload=[*DAY_COUNTRY, "topic_doc"])
    return found.where(other_day).select(FOUND)


def find_analogs(
    embeddings: DataFrame,
    today: DataFrame,
    cfg: PulseConfig = DEFAULTS,
    mode: str = "post",
    keep_past_country: bool = False,
) -> DataFrame:
    """For each (day, country) of ``today`` its nearest earlier days.

    One batched search for all anchors. ``post`` ranks ``vector_top_k`` over all
    rows before it keeps earlier days, so same-day rows use up places; ``pre``
    ranks earlier days only. The neighbour may be of any country; the output
    country is the anchor's.
    """
    anchors = today.join(
        embeddings.select(*DAY_COUNTRY, "id", "embedding"), DAY_COUNTRY
    ).select(F.col("id").alias("anchor_id"), *DAY_COUNTRY, "embedding")
    pre = _is_pre(mode)
    found = topk_cosine(
        embeddings,
        anchors,
        cfg.analog_topk if pre else cfg.vector_top_k,
        base_day="event_date" if pre else None,
        anchor_day="event_date" if pre else None,
        payload=[*DAY_COUNTRY, "topic_doc"],
    )
    past = found.select(
        "anchor_id",
        "id",
        "distance",
        F.col("event_date").alias("past_date"),
        F.col("country").alias("past_country"),
        snippet(F.col("topic_doc"), cfg.analog_snip_chars).alias("snippet"),
    )
    pairs = past.join(anchors.select("anchor_id", *DAY_COUNTRY), "anchor_id")
    earlier = pairs.where(F.col("past_date") < F.col("event_date"))
    nearest = first_n_per_group(
        earlier, ["anchor_id"], [F.col("distance"), F.col("id")], cfg.analog_topk
    )
    extra = ["past_country"] if keep_past_country else []
    return nearest.select(*DAY_COUNTRY, "past_date", "snippet", "distance", *extra)


def nest_analogs(flat: DataFrame, analog_topk: int = DEFAULTS.analog_topk) -> DataFrame:
    """One row per (day, country): nearest analogs as an array and as text."""
    flat = flat.select(
        F.to_date("event_date").alias("event_date"),
        "country",
        F.to_date("past_date").alias("past_date"),
        "snippet",
        F.col("distance").cast("double").alias("distance"),
    )
    order = ["distance", "past_date", "snippet"]
    nearest = first_n_per_group(flat, DAY_COUNTRY, [F.col(c) for c in order], analog_topk)
    nested = nearest.groupBy(*DAY_COUNTRY).agg(
        F.array_sort(F.collect_list(F.struct("rank", "past_date", "snippet", "distance"))).alias(
            "ranked"
        )
    )
    fields = ["past_date", "snippet", "distance"]
    lines = F.transform(
        "ranked",
        lambda a: fill(fixed.ANALOG_LINE, past_date=a["past_date"], snippet=a["snippet"]),
    )
    return nested.select(
        *DAY_COUNTRY,
        F.transform("ranked", lambda a: F.struct(*(a[f].alias(f) for f in fields))).alias(
            "analogs"
        ),
        F.array_join(lines, fixed.ANALOG_SEPARATOR).alias("analogs_txt"),
    )


def _is_pre(mode: str) -> bool:
    if mode not in ("post", "pre"):
        raise ValueError(f"mode is 'post' or 'pre', not {mode!r}")
    return mode == "pre"
