"""Tilt of a page's content: the least rectangle around its points.

The smallest rectangle around points has a side along an edge of their convex hull, so the hull's
edges are tried in turn and the rectangle's width and height along each come from the hull. All
products are of whole numbers, so equal inputs give equal areas everywhere.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

#: A page is turned upright when its tilt is at least and at most so many degrees (fixed values).
LEAST_TILT, MOST_TILT = 12.0, 30.0
RECTANGLE = StructType([StructField("n_hull", IntegerType()), StructField("area", DoubleType()), StructField("tilt", DoubleType())])


def hull(points: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Corners of the convex hull, counter-clockwise from the leftmost; points on its edges are none."""
    every = sorted(set(points))
    if len(every) < 3:
        return every

    def chain(along: list[tuple[int, int]]) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        for x, y in along:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (y - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (x - out[-2][0]):
                out.pop()
            out.append((x, y))
        return out[:-1]

    return chain(every) + chain(every[::-1])


def least_rectangle(points: list[tuple[int, int]]) -> tuple[int, float, float] | None:
    """(corners of the hull, area of the least rectangle, degrees by which its long side is turned
    counter-clockwise from the nearest axis, as y grows downwards); None without two different points."""
    corners = hull(points)
    if len(corners) < 2:
        return None
    best = None
    for (ax, ay), (bx, by) in zip(corners, corners[1:] + corners[:1]):
        dx, dy = bx - ax, by - ay
        along, across = [x * dx + y * dy for x, y in corners], [x * dy - y * dx for x, y in corners]
        wide, high, scale = max(along) - min(along), max(across) - min(across), dx * dx + dy * dy
        tried = (wide * high / scale, math.degrees(math.atan2(dy, dx) if wide >= high else math.atan2(dx, -dy)))
        best = min(best or tried, tried)
    angle = best[1] % 90.0
    return len(corners), best[0], 90.0 - angle if angle > 45.0 else -angle


@F.pandas_udf(RECTANGLE)
def _rectangles(xs: pd.Series, ys: pd.Series) -> pd.DataFrame:
    found = [None if x is None or y is None else least_rectangle([(int(a), int(b)) for a, b in zip(x, y)]) for x, y in zip(xs, ys)]
    return pd.DataFrame([f or (None, None, None) for f in found], columns=["n_hull", "area", "tilt"]).astype({"n_hull": "Int32"})


def rectangle(xs: Column, ys: Column) -> Column:
    """Struct (n_hull, area, tilt) of the least rectangle around points of whole coordinates."""
    return _rectangles(xs, ys)


def turns(tilt: Column) -> Column:
    """Whether a page of this tilt is turned upright."""
    return F.coalesce(F.abs(tilt).between(LEAST_TILT, MOST_TILT), F.lit(False))
