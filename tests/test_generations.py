"""Run corpora, snapshots of several versions, and the least rectangle around points."""

import math
import random

import pytest
from pyspark.sql import functions as F

from papyrine.functions import tilt
from papyrine.sources.generations import History, Migration
from papyrine.sources.run_corpus import RunCorpus

HISTORY = History(
    {"id": "int", "name": "string"},
    [Migration({"role": ("string", "user"), "score": ("float", 0.5)}), Migration({"born": ("date", None)}, {"id": "bigint", "score": "double"})],
)


@pytest.fixture(scope="module")
def paths(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("generations")
    out = [f"file://{root}/{v}" for v in range(3)]
    HISTORY.write(spark.createDataFrame([(1, "a"), (2, None)], "id int, name string"), out[0], 0)
    HISTORY.write(spark.createDataFrame([(3, "c", "admin", 0.25)], "id int, name string, role string, score float"), out[1], 1)
    HISTORY.write(spark.createDataFrame([(1 << 40, "d", None, 0.75, None)], "id long, name string, role string, score double, born date"), out[2])
    return out


def test_new_readers_see_defaults(spark, paths):
    found = HISTORY.read(spark, paths)
    assert dict(found.dtypes) == {"generation": "int", "id": "bigint", "name": "string", "role": "string", "score": "double", "born": "date"}
    rows = sorted(tuple(r) for r in found.collect())
    assert rows == [(0, 1, "a", "user", 0.5, None), (0, 2, None, "user", 0.5, None), (1, 3, "c", "admin", 0.25, None), (2, 1 << 40, "d", None, 0.75, None)]


def test_old_readers_leave_new_columns_out_and_refuse_narrow_types(spark, paths):
    assert HISTORY.read(spark, paths[:2], 0).columns == ["generation", "id", "name"]
    assert sorted(r.role for r in HISTORY.read(spark, paths[:2], 1).collect()) == ["admin", "user", "user"]
    with pytest.raises(ValueError, match="id: int does not hold every bigint"):
        HISTORY.read(spark, paths, 1)


def test_migrations_are_checked():
    with pytest.raises(ValueError, match="does not hold"):
        History({"id": "bigint"}, [Migration(widened={"id": "int"})]).columns(1)
    with pytest.raises(ValueError, match="twice"):
        History({"id": "int"}, [Migration({"id": ("int", 0)})]).columns(1)


def test_a_repeated_run_reads_back_once(spark, tmp_path):
    corpus = RunCorpus(spark, f"file://{tmp_path}/runs")
    assert corpus.read() is None
    results = spark.createDataFrame([("f1", "verified"), ("f2", None), ("f2", None)], "file string, verdict string")
    assert corpus.write("a", results)["documents"] == 2
    results.write.json(f"{tmp_path}/runs/run=a/attempt=killed")  # a write that was killed before its manifest
    results.write.json(f"{tmp_path}/runs/run=never/attempt=killed")
    corpus.write("a", results)
    corpus.write("b", spark.createDataFrame([("f1", 7)], "file string, latency_ms int"))
    found = sorted(tuple(r) for r in corpus.read().select("run", "file", "latency_ms").collect())
    assert found == [("a", "f1", None), ("a", "f2", None), ("b", "f1", 7)]
    assert corpus.sweep() == 3 and corpus.read().count() == 3 and corpus.sweep() == 0


def brute_area(points):
    """Every direction between two points."""
    best = math.inf
    for ax, ay in points:
        for bx, by in points:
            dx, dy = bx - ax, by - ay
            if dx or dy:
                along, across = [x * dx + y * dy for x, y in points], [x * dy - y * dx for x, y in points]
                best = min(best, (max(along) - min(along)) * (max(across) - min(across)) / (dx * dx + dy * dy))
    return best


def test_least_rectangle_equals_brute_force():
    rng = random.Random(5)
    for n in range(2, 40):
        points = [(rng.randrange(30), rng.randrange(30)) for _ in range(n)]
        if len(set(points)) > 1:
            assert tilt.least_rectangle(points)[1] == brute_area(points)
    assert tilt.least_rectangle([(1, 1), (1, 1)]) is None and tilt.least_rectangle([]) is None
    assert tilt.hull([(0, 0), (2, 0), (1, 0), (2, 2), (0, 2), (1, 1)]) == [(0, 0), (2, 0), (2, 2), (0, 2)]


@pytest.mark.parametrize("degrees", [0, 5, 14, 29, 44, -14, -29, 61])
def test_tilt_of_a_turned_card(spark, degrees):
    t = math.radians(degrees)
    # y grows downwards, so a card turned counter-clockwise has its right end higher
    corners = [(round(5000 + x * math.cos(t) + y * math.sin(t)), round(5000 - x * math.sin(t) + y * math.cos(t))) for x, y in ((0, 0), (2000, 0), (2000, 1200), (0, 1200))]
    xs, ys = zip(*corners)
    row = spark.createDataFrame([(list(xs), list(ys)), (None, None)], "xs array<int>, ys array<int>").select(tilt.rectangle(F.col("xs"), F.col("ys")).alias("r")).select("r.*", tilt.turns(F.col("r.tilt")).alias("turns")).collect()
    want = degrees - 90 if degrees > 45 else degrees
    assert abs(row[0].tilt - want) < 0.1 and row[0].turns == (12 <= abs(want) <= 30) and row[1].tilt is None and not row[1].turns
