"""Session builder: UTC, AQE with skew handling, Arrow."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(
    app: str = "pulse", master: str | None = None, conf: dict[str, str] | None = None
) -> SparkSession:
    """A session with the settings the operators are written for.

    ``master`` stays unset on a cluster, so spark-submit decides. Shuffle
    partition counts are left to AQE coalescing unless ``conf`` overrides them.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **(conf or {}),
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
