"""Any Python inference function as a model, run on Arrow batches.

``load`` runs once per Python worker task and returns the function that is
called with a list of texts. The UDF is marked non-deterministic: the optimiser
then neither duplicates a call nor moves a filter below it, so each row is
inferred once.

A call holds texts of about the same length: the texts of an Arrow batch are put
in order of length and cut where a call would exceed ``batch_size`` texts or
``batch_chars`` characters, counted as a padded batch (texts times the longest).
A text that is longer than that is a call of its own; no text is cut.

A call that raises is repeated, up to ``attempts`` times with a growing pause. If
it still fails it is halved, so that one bad text does not take its neighbours
along; a text that fails alone has a null reply and the failure as its error. A
wrong number of replies is a fault of the model function and ends the job.
"""

from __future__ import annotations

import sys
import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulse.functions.binding import bind
from pulse.models import contracts
from pulse.models.contracts import GenerationOptions

# executors need what the model needs, not this package: its task code travels by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(contracts)

Infer = Callable[[list[str]], Sequence]


class WrongReplies(ValueError):
    """The model returned another number of replies than asked."""


@dataclass(frozen=True)
class Calls:
    """How texts are put into calls, and what happens when one fails."""

    batch_size: int = 16
    batch_chars: int = 1 << 20
    attempts: int = 3
    pause_seconds: float = 0.5

    def cut(self, lengths: np.ndarray) -> Iterator[np.ndarray]:
        """Places of the texts of each call, shortest texts first."""
        order = np.argsort(lengths, kind="stable")
        start = 0
        for end in range(1, len(order) + 1):
            full = end - start == self.batch_size
            if end == len(order) or full or (end + 1 - start) * lengths[order[end]] > self.batch_chars:
                yield order[start:end]
                start = end

    def replies(self, infer: Infer, texts: list[str]) -> Iterator[tuple[object, str | None]]:
        """(reply, error) of each text in order."""
        for attempt in range(self.attempts):
            try:
                replies = infer(texts)
                if len(replies) != len(texts):
                    raise WrongReplies("the model returned another number of replies than asked")
                yield from ((reply, None) for reply in replies)
                return
            except WrongReplies:
                raise
            except Exception as failure:  # noqa: BLE001  (whatever a model client raises)
                error = f"{type(failure).__name__}: {failure}"
                if attempt + 1 < self.attempts:
                    time.sleep(self.pause_seconds * 2**attempt)
        if len(texts) == 1:
            yield None, error
            return
        half = len(texts) // 2
        yield from self.replies(infer, texts[:half])
        yield from self.replies(infer, texts[half:])


def _batched(load: Callable[[], Infer], reply_type: T.DataType, calls: Calls):
    """text -> struct<reply, error>; a null text is not asked and has neither."""

    def run(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        infer = load()
        for texts in series:
            out = {name: pd.Series([None] * len(texts), dtype=object) for name in ("reply", "error")}
            asked = np.flatnonzero(texts.notna())
            lengths = texts.iloc[asked].str.len().to_numpy(np.int64)
            for places in calls.cut(lengths):
                at = asked[places]
                for i, (reply, error) in zip(at, calls.replies(infer, texts.iloc[at].tolist()), strict=True):
                    out["reply"].iat[i], out["error"].iat[i] = reply, error
            yield pd.DataFrame(out)

    # set, not written: the hints must be objects for the UDF type to be read
    run.__annotations__ = {"series": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    fields = [T.StructField("reply", reply_type), T.StructField("error", T.StringType())]
    return F.pandas_udf(run, T.StructType(fields)).asNondeterministic()


@dataclass(frozen=True)
class BatchEmbedding:
    """An embedding model; vectors are brought to unit length."""

    load: Callable[[], Infer]
    batch_size: int = 64
    calls: Calls = Calls()

    def attempted(self, text: Column) -> Column:
        """text -> struct<reply: array<float>, error: string>."""

        def unit() -> Infer:
            infer = self.load()

            def normalised(texts: list[str]) -> list:
                rows = np.asarray(infer(texts), dtype=np.float64)
                if len(rows) != len(texts):
                    raise WrongReplies("the model returned another number of replies than asked")
                length = np.linalg.norm(rows, axis=1, keepdims=True)
                return list((rows / np.where(length == 0, 1.0, length)).astype(np.float32))

            return normalised

        calls = replace(self.calls, batch_size=self.batch_size)
        return _batched(unit, T.ArrayType(T.FloatType()), calls)(text)

    def embed(self, text: Column) -> Column:
        return self.attempted(text).getField("reply")


@dataclass(frozen=True)
class BatchText:
    """``load(task, options)`` returns the inference function.

    ``json_replies`` says that replies are raw JSON responses, not flat text.
    """

    load: Callable[[str, GenerationOptions], Infer]
    batch_size: int = 16
    json_replies: bool = False
    calls: Calls = Calls()

    def generate(
        self, task: str, prompt: Column, facts: Mapping[str, Column], options: GenerationOptions
    ) -> Column:
        calls = replace(self.calls, batch_size=self.batch_size)
        asked = _batched(lambda: self.load(task, options), T.StringType(), calls)(prompt)
        nothing = F.lit(None).cast("string")

        def split(reply: Column) -> Column:
            text, raw = (nothing, reply["reply"]) if self.json_replies else (reply["reply"], nothing)
            return F.struct(text.alias("text"), raw.alias("raw"), reply["error"].alias("error"))

        return bind(asked, split)
