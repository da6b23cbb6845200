"""The two searches as SQL table functions.

``register_searches`` makes temporary functions whose bodies are SQL, so that a call is planned
as a relation: columns are pruned, filters above it are seen, and the k nearest are kept per
partition before they meet (``TakeOrderedAndProject``). One anchor is compared with every vector,
where the functions of ``operators.vectors`` search for many anchors at once. Rows are the same.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from pulse.config import DEFAULTS

_ROWS = "event_date DATE, country STRING, topic_doc STRING, distance DOUBLE, id STRING"
_COLUMNS = "event_date, country, topic_doc, distance, id"


def _dot(x: str, y: str) -> str:
    products = f"zip_with({x}, {y}, (p, q) -> CAST(p AS DOUBLE) * CAST(q AS DOUBLE))"
    return f"aggregate({products}, 0D, (total, p) -> total + p)"


def _distance(x: str, y: str) -> str:
    """Cosine distance to 9 places; NULL for vectors without one or of unlike length."""
    norms = f"sqrt({_dot(x, x)} * {_dot(y, y)})"
    value = f"nanvl(1D - try_divide({_dot(x, y)}, {norms}), NULL)"
    return f"CASE WHEN size({x}) = size({y}) THEN round({value}, 9) END"


def register_searches(
    spark: SparkSession,
    embeddings: str = "news_embeddings",
    embed: str = "embed_text",
    k: int = DEFAULTS.vector_top_k,
    mode: str = "post",
) -> None:
    """``similar_to_text(query_text)`` and ``similar_to_day(country_code, day)`` in this session.

    ``embeddings`` is a table or view with the columns of the news embeddings, ``embed`` a SQL
    function from a text to its vector (of the model that made the table): a registered
    pandas UDF, or ``HashedTerms().sql_function(spark, name)``. A null or unknown argument gives no row.
    ``mode`` is that of ``operators.vectors.similar_to_day``.
    """
    if mode not in ("post", "pre"):
        raise ValueError(f"mode is 'post' or 'pre', not {mode!r}")

    def nearest(anchor: str, where: str) -> str:
        return f"""
          SELECT e.event_date, e.country, e.topic_doc, e.id, {_distance("a.v", "e.embedding")} AS distance
          FROM {embeddings} e CROSS JOIN ({anchor}) a
          WHERE {_distance("a.v", "e.embedding")} IS NOT NULL AND {where}
          ORDER BY distance, id LIMIT {int(k)}"""

    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION similar_to_text(query_text STRING)
        RETURNS TABLE ({_ROWS})
        RETURN SELECT {_COLUMNS} FROM ({nearest(f"SELECT {embed}(query_text) AS v", "TRUE")})""")
    anchor = f"""
        SELECT min_by(embedding, id) AS v FROM {embeddings}
        WHERE country = country_code AND event_date = day"""
    other = "event_date <> day"
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION similar_to_day(country_code STRING, day DATE)
        RETURNS TABLE ({_ROWS})
        RETURN SELECT {_COLUMNS} FROM ({nearest(anchor, other if mode == "pre" else "TRUE")}) WHERE {other}""")
