"""Daily runs: the instants at which they were due, and what each run answered.

A run is due every day when the clock of a zone reads a time. Where clocks go forward over that time
it is due as much later as they went; where they go back, it is due once, at the first reading. A
process that was away misses instants; its next run answers for all of them at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papyrine.operators.numbering import as_of, numbered_by


def due_times(spark: SparkSession, first: str, last: str, zone: str, at: str = "03:00") -> DataFrame:
    """(n, due): the instants due on the local days ``first`` to ``last``, numbered by day."""
    day = F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date")))
    days = spark.range(1).select(day.alias("day"))
    local = F.to_timestamp_ntz(F.concat_ws(" ", F.col("day").cast("string"), F.lit(f"{at}:00")))
    due = F.convert_timezone(F.lit(zone), F.lit("UTC"), local)
    return days.select(F.unix_date("day").cast("long").alias("n"), due.alias("due"))


def answered(runs: DataFrame, dues: DataFrame, moment: str = "at", keys: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """``runs`` with ``due_n`` and ``due``, the last instant due at or before each (null before the first),
    ``delay_ms``, ``first`` (no earlier run of the key answered that instant) and ``coalesced``: for a
    first run the instants missed since the run before it, which it answers too. Runs at the same
    moment come in the ``order`` of those columns. ``dues`` are the same for all keys; what meets in a
    task is one row a day of a key."""
    keys = keys or []
    found = as_of(runs, dues, moment, "due").select(*runs.columns, F.col("last.n").alias("due_n"), F.col("last.due").alias("due"))
    ranked = numbered_by(found, [*keys, "due_n"], moment, *(order or []), name="_place")
    first = (F.col("_place") == 1) & F.col("due_n").isNotNull()
    # one row a key and day
    since = F.col("due_n") - F.lag("due_n").over(Window.partitionBy(*keys).orderBy("due_n")) - 1
    firsts = ranked.filter(first).withColumn("coalesced", F.coalesce(since, F.lit(0)))
    others = ranked.filter(~first).withColumn("coalesced", F.lit(None).cast("long"))
    delay = F.unix_millis(F.col(moment).cast("timestamp")) - F.unix_millis(F.col("due").cast("timestamp"))
    return firsts.unionByName(others).select(*runs.columns, "due_n", "due", delay.alias("delay_ms"), F.col("coalesced").isNotNull().alias("first"), "coalesced")
