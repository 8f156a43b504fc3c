"""Evaluating a column once inside an expression that uses it several times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, also when the body uses it inside lambdas."""
    return F.get(F.transform(F.array(value), body), 0)
