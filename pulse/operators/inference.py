"""Rows on their way to a model and back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulse.functions.responses import response_text
from pulse.models.contracts import EmbeddingModel, GenerationOptions, TextModel

ERROR = "error"


def spread_for_inference(
    rows: DataFrame, keys: Sequence[str], rows_per_task: int, at_most: int | None = None
) -> DataFrame:
    """Barrier before a model: exactly the rows above it, ``rows_per_task`` to a task.

    Without it a limit would be applied per partition below a Python model and
    again above it, so the model would see rows that are then thrown away, and
    the model would run with as many tasks as the rows happen to have files.
    ``at_most`` is the number of rows where it is known; else they are counted,
    which on a stored table reads its footers only.
    """
    n = rows.count() if at_most is None else at_most
    return rows.repartition(max(1, -(-n // rows_per_task)), *keys)


def ask(
    rows: DataFrame,
    model: TextModel,
    task: str,
    prompt: Column,
    facts: dict[str, Column],
    options: GenerationOptions,
    out: str,
) -> DataFrame:
    """Add the model's reply to ``prompt`` as column ``out``.

    Failures of a model that reports them are added as ``error``, behind those of
    earlier questions; the column is there for every model.
    """
    replied = rows.withColumn("_reply", model.generate(task, prompt, facts, options))
    text = response_text(F.col("_reply.text"), F.col("_reply.raw"))
    reports = ERROR in replied.schema["_reply"].dataType.names
    failure = F.concat(F.lit(f"{task}: "), F.col("_reply.error")) if reports else F.lit(None).cast("string")
    before = [F.col(ERROR)] if ERROR in rows.columns else []
    return replied.withColumns({out: text, ERROR: F.coalesce(*before, failure)}).drop("_reply")


def embed(rows: DataFrame, model: EmbeddingModel, text: str, out: str = "embedding") -> DataFrame:
    """Add the vector of ``text`` as ``out`` and, of a model that reports it, why there is none."""
    attempted = getattr(model, "attempted", None)
    if attempted is None:
        return rows.withColumns({out: model.embed(F.col(text)), ERROR: F.lit(None).cast("string")})
    made = rows.withColumn("_made", attempted(F.col(text)))
    return made.withColumns({out: F.col("_made.reply"), ERROR: F.col("_made.error")}).drop("_made")
