"""Running numbers without one task that sees all rows.

Rows are ranged by their order and written with their place: the partition in the upper bits,
the position in it in the lower ones. One count a partition gives each partition's first number,
so the second pass only adds. What the driver gets is one count a partition.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrine.workspace import written

#: ``monotonically_increasing_id`` holds the partition above these bits, the position below.
POSITION_BITS = 33
PLACE, PART = "_place", "_part"


def _part() -> Column:
    return F.shiftright(PLACE, POSITION_BITS).cast("int")


def _position() -> Column:
    return F.col(PLACE).bitwiseAND(F.lit((1 << POSITION_BITS) - 1))


def placed(rows: DataFrame, *order: str | Column, path: str | None = None) -> DataFrame:
    """``rows`` ranged and sorted by ``order`` (as they are without one), written with ``_place`` at ``path``
    or else as an intermediate table. Places rise in ``order``.

    Rows equal in all of ``order`` share a range, so end it with a key where ties can be many."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order) if order else rows
    return written(ranged.withColumn(PLACE, F.monotonically_increasing_id()), "placed", path)


def numbered(rows: DataFrame, *order: str | Column, name: str = "number", start: int = 1) -> DataFrame:
    """``rows`` with the column ``name``: start, start + 1, ... in ``order``. An empty table stays empty;
    without an order the numbers follow the partitions. A column of that name is replaced."""
    at = placed(rows.drop(name), *order)
    sizes = sorted(at.groupBy(_part().alias(PART)).agg(F.count("*").alias("n")).collect())
    firsts = accumulate((n for _, n in sizes), initial=start)
    offsets = rows.sparkSession.createDataFrame([(part, first) for (part, _), first in zip(sizes, firsts)], f"{PART} int, _first long")
    return at.withColumn(PART, _part()).join(F.broadcast(offsets), PART).withColumn(name, F.col("_first") + _position()).drop(PLACE, PART, "_first")


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> list[Column]:
    return [left[k].eqNullSafe(right[k]) for k in keys]


def _of_spanning_keys(at: DataFrame, keys: list[str], **aggregates: Column) -> DataFrame:
    """(_part, keys, aggregates) of the keys that span more than one range: fewer than there are ranges,
    and as many rows as they have ranges."""
    every = written(at.groupBy(PART, *keys).agg(*[c.alias(n) for n, c in aggregates.items()]), "range-totals")
    spanning = every.groupBy(*keys).agg(F.count("*").alias("_ranges")).filter("_ranges > 1")
    on = [F.col(f"e.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys] or [F.lit(True)]
    return every.alias("e").join(spanning.alias("s"), on, "left_semi")


def numbered_by(rows: DataFrame, keys: list[str], *order: str | Column, name: str = "number") -> DataFrame:
    """``rows`` with 1, 2, ... within each value of ``keys`` (null is a value) in ``order``.

    A key with many rows spans several ranges: rows are numbered within their range, and the few
    keys that span more than one get what the ranges before hold."""
    at = placed(rows.drop(name), *keys, *order).withColumn(PART, _part())
    earlier = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_n").over(earlier), F.lit(0))
    carried = written(_of_spanning_keys(at, keys, _n=F.count("*")).select(PART, *keys, before.alias("_before")), "carried")
    within = at.withColumn("_own", F.row_number().over(Window.partitionBy(PART, *keys).orderBy(PLACE)))
    joined = within.join(F.broadcast(carried), [within[PART] == carried[PART], *_same(within, carried, keys)], "left")
    return joined.select(*[within[c] for c in within.columns if c not in (PLACE, PART, "_own", name)], (within["_own"] + F.coalesce("_before", F.lit(0))).alias(name))


def as_of(left: DataFrame, right: DataFrame, left_moment: str, right_moment: str, keys: list[str] | None = None, name: str = "last") -> DataFrame:
    """``left`` with the struct ``name``: the last row of ``right`` of the same ``keys`` (null is a value) at
    or before the row's moment, or null.

    Both tables are ranged together by key and moment; a row looks back within its range, and the
    last right row of the ranges before is carried into each range. No pairs are made, and neither a
    key nor a moment needs to fit in a task, but for left rows of the very same key and moment. Of right
    rows that tie, either may be taken. A null moment is before all others."""
    keys = keys or []
    ks = [f"_k{i}" for i in range(len(keys))]
    none = lambda df: F.lit(None).cast(df.schema)
    head = lambda moment, side: [*[F.col(k).alias(a) for k, a in zip(keys, ks)], F.col(moment).alias("_t"), F.lit(side).alias("_side")]
    from_left = left.select(*head(left_moment, 1), F.struct("*").alias("_l"), none(right).alias("_r"))
    from_right = right.select(*head(right_moment, 0), none(left).alias("_l"), F.struct("*").alias("_r"))
    at = placed(from_right.unionAll(from_left), *ks, "_t", "_side").withColumn(PART, _part())
    tails = _of_spanning_keys(at, ks, _tail=F.max_by("_r", F.when(F.col("_side") == 0, F.col(PLACE))))
    earlier = Window.partitionBy(*ks).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    carried = written(tails.select(PART, *ks, F.last("_tail", ignorenulls=True).over(earlier).alias("_carried")), "carried")
    seen = F.last("_r", ignorenulls=True).over(Window.partitionBy(PART, *ks).orderBy(PLACE).rowsBetween(Window.unboundedPreceding, 0))
    within = at.withColumn("_seen", seen).filter("_side = 1")
    joined = within.join(F.broadcast(carried), [within[PART] == carried[PART], *_same(within, carried, ks)], "left")
    return joined.select("_l.*", F.coalesce("_seen", "_carried").alias(name))


def since_first(rows: DataFrame, keys: list[str], moment: str, name: str) -> DataFrame:
    """``rows`` with the milliseconds since the first ``moment`` of their key (0 for the first)."""
    firsts = rows.groupBy(*keys).agg(F.min(moment).alias("_first"))
    joined = rows.alias("r").join(firsts.alias("f"), [F.col(f"r.{k}").eqNullSafe(F.col(f"f.{k}")) for k in keys])
    ms = lambda c: F.unix_millis(F.col(c).cast("timestamp"))
    return joined.select("r.*", (ms(f"r.{moment}") - ms("f._first")).alias(name))
