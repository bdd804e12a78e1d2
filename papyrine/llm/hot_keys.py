"""Joins on a key of which one value may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.workspace import written

#: A key is hot when it holds more than one in so many rows; there are fewer hot keys than that.
HOT = 1_000


def hot_keys(counts: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """(key) of the hot ones of ``counts``, which has ``n`` rows of ``total`` for each key: under ``HOT`` rows."""
    return written(counts.filter(F.col(n) * HOT > total).select(key), "hot-keys")


def split_join(left: DataFrame, right: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """``left`` joined with ``right``, which has one row a key. Rows with a hot key stay where they are
    and meet a broadcast of under ``HOT`` rows of ``right``; the others are shuffled."""
    few = F.broadcast(right.join(F.broadcast(hot), key, "left_semi"))
    rest = left.join(F.broadcast(hot), key, "left_anti").join(right, key)
    return rest.unionByName(left.join(few, key))
