"""A value worked out once and used several times within one Column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``; the value's own expression stands in the plan once, however often the
    body uses it."""
    return F.transform(F.array(value), body)[0]
