"""Naming an intermediate value inside one column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once.

    A Python variable that holds a column is pasted into every place it is used
    in; inside a lambda that means once per element. A lambda's own variable is
    evaluated once.
    """
    return F.transform(F.array(value), body)[0]
