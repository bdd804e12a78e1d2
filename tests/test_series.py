"""Running numbers, as-of joins and daily instants at any partitioning."""

import random
from bisect import bisect_right
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from papyrine.operators import numbering, schedule


def shuffled(seed, n=400):
    rng = random.Random(seed)
    return [(rng.choice(["a", "a", "a", "a", "b", None]), rng.randrange(50), i) for i in range(n)]


@pytest.mark.parametrize("parts", [1, 5, 17])
def test_numbers_are_those_of_row_number(spark, parts):
    rows = spark.createDataFrame(shuffled(parts), "k string, t int, i int").repartition(parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = numbering.numbered_by(numbering.numbered(rows, "t", "i", name="g"), ["k"], "t", "i", name="own").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for place, r in enumerate(sorted(found, key=lambda r: (r.t, r.i)), 1):
        assert r.g == place
    for key in ("a", "b", None):
        own = sorted((r for r in found if r.k == key), key=lambda r: (r.t, r.i))
        assert [r.own for r in own] == list(range(1, len(own) + 1))


def test_numbers_need_no_single_task(spark):
    rows = spark.range(1000).withColumn("k", F.col("id") % 3)
    for plan in (numbering.numbered(rows, "id"), numbering.numbered_by(rows, ["k"], "id")):
        assert "SinglePartition" not in plan._jdf.queryExecution().executedPlan().toString()


def test_numbers_of_empty_tables_and_taken_names(spark):
    rows = spark.createDataFrame([], "k string, number int")
    assert numbering.numbered(rows, "k").count() == 0 and numbering.numbered_by(rows, ["k"], "k").count() == 0
    same = numbering.numbered(spark.createDataFrame([("x", 9)], "k string, number int"), "k").collect()
    assert [(r.k, r.number) for r in same] == [("x", 1)]


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_as_of_takes_the_last_row_before(spark, keys):
    rng = random.Random(7)
    left = [(rng.choice(["a", "a", "b", None]), rng.randrange(200), i) for i in range(300)] + [("never", 5, 999), ("a", None, 1000)]
    right = [(k, t, f"{k}{t}") for k in ("a", "b", None, "c") for t in sorted(rng.sample(range(200), 20))]
    if not keys:  # without a key the moments must differ
        right = [r for r in right if r[0] == "a"]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = numbering.as_of(spark.createDataFrame(left, "k string, at int, i int").repartition(7), spark.createDataFrame(right, "k string, t int, v string"), "at", "t", keys).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(found) == len(left)
    for r in found:
        own = sorted((t, v) for k, t, v in right if not keys or k == r.k)
        at = bisect_right([t for t, _ in own], r["at"]) if r["at"] is not None else 0
        assert (r.last and r.last.v) == (own[at - 1][1] if at else None)


def utc(rows):
    return [r.due.strftime("%d %H:%M") for r in sorted(rows, key=lambda r: r.n)]


def test_due_times_across_clock_changes(spark):
    # clocks go from 02:00 to 03:00 on 29 March 2024 and from 02:00 back to 01:00 on 27 October
    assert utc(schedule.due_times(spark, "2024-03-28", "2024-03-30", "Asia/Jerusalem", "02:30").collect()) == ["28 00:30", "29 00:30", "29 23:30"]
    assert utc(schedule.due_times(spark, "2024-10-26", "2024-10-28", "Asia/Jerusalem", "01:30").collect()) == ["25 22:30", "26 22:30", "27 23:30"]
    assert utc(schedule.due_times(spark, "2024-10-26", "2024-10-28", "Asia/Jerusalem", "03:00").collect()) == ["26 00:00", "27 01:00", "28 01:00"]


def test_runs_answer_for_missed_instants(spark):
    at = lambda d, h, m=0: datetime(2024, 3, d, h, m)
    runs = spark.createDataFrame([(1, at(1, 0, 59)), (2, at(1, 1, 0)), (3, at(1, 9)), (4, at(5, 2)), (5, at(5, 2)), (6, at(6, 0, 30))], "i int, at timestamp_ntz")
    found = {r.i: r for r in schedule.answered(runs, schedule.due_times(spark, "2024-03-01", "2024-03-10", "Asia/Jerusalem"), order=["i"]).collect()}
    assert found[1].due is None and not found[1].first and found[1].coalesced is None
    assert (found[2].first, found[2].coalesced, found[2].delay_ms) == (True, 0, 0)
    assert (found[3].first, found[3].coalesced, found[3].delay_ms) == (False, None, 8 * 3_600_000)
    assert (found[4].first, found[4].coalesced) == (True, 3) and not found[5].first
    assert not found[6].first and found[6].due_n == found[5].due_n
