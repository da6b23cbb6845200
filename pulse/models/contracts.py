"""What the operators ask of a model.

A model is a column expression over a frame: the operators choose rows and
columns, the model adds one column, and the row flow is never joined back to
itself. Local models stay inside the JVM; ``pulse.models.batch`` wraps any
Python inference function as an Arrow-batched one.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column


@dataclass(frozen=True)
class GenerationOptions:
    temperature: float
    max_output_tokens: int


class EmbeddingModel(Protocol):
    def embed(self, text: Column) -> Column:
        """text -> array<float> of unit length; NULL text -> NULL.

        Documents and queries must go through the same model. A model that can fail on
        a text also has ``attempted``: text -> struct<reply: array<float>, error: string>.
        """
        ...


class TextModel(Protocol):
    def generate(
        self, task: str, prompt: Column, facts: Mapping[str, Column], options: GenerationOptions
    ) -> Column:
        """prompt -> struct<text: string, raw: string>, both nullable.

        ``text`` is a flat reply, ``raw`` a JSON response to look into when there
        is none. A model that can fail on a prompt adds ``error: string``, set where it
        did. ``task`` is ``briefing``, ``sentiment`` or ``summary``. ``facts``
        are the columns the prompt was made of, for models that do not read prose.
        """
        ...
