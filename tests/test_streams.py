"""Chunked lines as a stream, and keyed state: restarts, disorder, timeouts and pruning."""

import json
import random
import time
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from papyrine.sources import ndjson_chunks
from papyrine.streaming import keyed, limits, stages
from tests.test_streaming import EVENTS, expected, plain, script

LINES = ['{"a": 1}', "", "  ", '{"b": "é漢🙂"}', "x" * 500, " padded ", '{"last": true}']


@pytest.fixture(scope="module", autouse=True)
def source(spark):
    ndjson_chunks.register(spark)


def put(folder, content, cuts, closed=True):
    folder.mkdir(parents=True)
    ends = [*sorted(cuts), len(content)]
    for n, (a, b) in enumerate(zip([0, *ends], ends)):
        (folder / ndjson_chunks._name(n)).write_bytes(content[a:b])
    if closed:
        (folder / "end").touch()


def test_any_chunking_gives_the_same_lines(spark, tmp_path):
    content, rng = "\n".join(LINES).encode(), random.Random(4)
    want = [x.strip() for x in LINES if x.strip()]
    for n in range(12):
        put(tmp_path / f"s{n}", content + b"\n" * (n % 2), [rng.randrange(len(content)) for _ in range(n * 3)])
    rows = spark.read.format("ndjson_chunks").option("streamsPerTask", 5).load(f"file://{tmp_path}").collect()
    for n in range(12):
        own = sorted((r.chunk, r.line, r.value) for r in rows if r.stream == f"s{n}")
        assert [v for _, _, v in own] == want and len({(c, i) for c, i, _ in own}) == len(own)
    put(tmp_path / "single", content, range(1, len(content)))  # a byte a chunk
    found = spark.read.format("ndjson_chunks").load(f"file://{tmp_path}").filter("stream = 'single'").orderBy("chunk", "line").collect()
    assert [r.value for r in found] == want


def test_an_open_stream_keeps_its_rest(spark, tmp_path):
    put(tmp_path / "open", b'{"a": 1}\n{"b"', [3], closed=False)
    put(tmp_path / "gap", b"one\ntwo\nthree\n", [4, 8])
    (tmp_path / "gap" / ndjson_chunks._name(1)).unlink()
    rows = spark.read.format("ndjson_chunks").load(f"file://{tmp_path}").collect()
    assert sorted((r.stream, r.value) for r in rows) == [("gap", "one"), ("open", '{"a": 1}')]


def test_stream_goes_on_after_a_restart_and_cleans_up(spark, tmp_path):
    put(tmp_path / "in/a", b"one\ntwo\nthr", [5], closed=False)

    def run():
        read = spark.readStream.format("ndjson_chunks").option("clean", "true").load(f"file://{tmp_path}/in")
        read.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination(120)
        return Counter((r.stream, r.value) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    assert run() == Counter([("a", "one"), ("a", "two")])
    (tmp_path / "in/a" / ndjson_chunks._name(2)).write_bytes(b"ee\nfour")
    (tmp_path / "in/a/end").touch()
    put(tmp_path / "in/b", b"five\n", [2])
    assert run() == Counter([("a", "one"), ("a", "two"), ("a", "three"), ("a", "four"), ("b", "five")])
    put(tmp_path / "in/c", b"six", [])
    assert run()[("c", "six")] == 1 and not (tmp_path / "in/a").exists()


def test_written_chunks_read_back(spark, tmp_path):
    rows = spark.createDataFrame([(f"s{n % 3}", n, f'{{"n": {n}, "t": "é{"x" * n}"}}') for n in range(60)], "stream string, n int, value string")
    sorted_rows = rows.repartition("stream").sortWithinPartitions("stream", "n").select("stream", "value")
    sorted_rows.write.format("ndjson_chunks").option("chunkBytes", 17).mode("append").save(f"file://{tmp_path}/w")
    found = spark.read.format("ndjson_chunks").load(f"file://{tmp_path}/w")
    assert sorted((r.stream, r.value) for r in found.collect()) == sorted((r.stream, r.value) for r in rows.collect())
    assert len(list((tmp_path / "w/s0").iterdir())) > 20


def started(spark, told, tmp_path, **trigger):
    with keyed.use_rocksdb(spark, drain="availableNow" in trigger):
        return told.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").trigger(**trigger).start(f"{tmp_path}/out")


def rows_of(spark, tmp_path, schema):
    return spark.read.schema(schema).parquet(f"{tmp_path}/out").collect()


def numbered(rows):
    return [(r[0], r[1] + 1, *r[2:]) for r in rows]


def test_stage_state_survives_a_restart_in_any_order(spark, tmp_path):
    rows = numbered(script())
    random.Random(3).shuffle(rows)
    for part in (rows[:5], rows[5:9], rows[9:] + rows[:3]):  # early, late and repeated events
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        events = spark.readStream.schema(EVENTS).json(f"{tmp_path}/in")
        started(spark, keyed.progress_stream(events, 3_600_000), tmp_path, availableNow=True).awaitTermination(120)
    found = rows_of(spark, tmp_path, stages.SUMMARY)
    assert len(found) == 2 and {r.request_id: plain(r) for r in found} == expected()


def test_chunks_feed_the_stage_fold(spark, tmp_path):
    fields = [part.split()[0] for part in EVENTS.split(", ")]
    for request in ("a", "b"):
        lines = [json.dumps(dict(zip(fields[1:], r[1:]))) for r in numbered(script()) if r[0] == request]
        content = "\n".join(lines).encode()
        put(tmp_path / f"all/{request}", content, range(40, len(content), 53))
    for part in (slice(0, 9), slice(None)):  # some chunks, and the rest after a restart
        for request in ("a", "b"):
            (tmp_path / f"in/{request}").mkdir(parents=True, exist_ok=True)
            for chunk in sorted((tmp_path / f"all/{request}").iterdir())[part]:
                chunk.rename(tmp_path / f"in/{request}/{chunk.name}")
        read = spark.readStream.format("ndjson_chunks").load(f"file://{tmp_path}/in")
        events = read.select(F.col("stream").alias("request_id"), F.from_json("value", EVENTS.replace("request_id string, ", "")).alias("e")).select("request_id", "e.*")
        started(spark, keyed.progress_stream(events, 3_600_000), tmp_path, availableNow=True).awaitTermination(60)
    assert {r.request_id: plain(r) for r in rows_of(spark, tmp_path, stages.SUMMARY)} == expected()


def test_a_silent_request_times_out_and_is_forgotten(spark, tmp_path):
    rows = [r for r in numbered(script()) if r[0] == "a" and r[1] in (1, 2, 3, 5)]  # the fourth is lost
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.json(f"{tmp_path}/in")
    events = spark.readStream.schema(EVENTS).json(f"{tmp_path}/in")
    run = started(spark, keyed.progress_stream(events, 2_000), tmp_path, processingTime="1 second")
    until = time.time() + 90
    while time.time() < until and not ((tmp_path / "out").exists() and rows_of(spark, tmp_path, stages.SUMMARY)):
        time.sleep(1)
    run.stop()
    (told,) = rows_of(spark, tmp_path, stages.SUMMARY)
    assert (told.stage, told.error, told.error_stage, told.classified) == ("error", "TIMEOUT", "reading", 1)


def test_buckets_of_idle_keys_are_pruned(spark, tmp_path):
    schema = "key string, at_ms long, request long"

    def run(rows, keep_ms):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        read = spark.readStream.schema(schema).json(f"{tmp_path}/in")
        started(spark, keyed.token_bucket_stream(read, 2, keep_ms), tmp_path, availableNow=True).awaitTermination(120)
        return {r.request: (r.allowed, r.retry_after_s) for r in rows_of(spark, tmp_path, limits.BUCKET)}

    first = run([("k", 0, 1), ("k", 0, 2), ("k", 0, 3), ("other", 5, 4)], 3_000)
    assert first == {1: (True, None), 2: (True, None), 3: (False, 30), 4: (True, None)}
    time.sleep(4)
    assert run([("k", 0, 5)], 3_000)[5] == (True, None)  # no time has passed on the requests' clock: the bucket is a new one


def test_streamed_reservations_equal_the_batch_fold(spark, tmp_path):
    events = [(1, 0, "reserve", 1), (1, 1, "reserve", 2), (1, 2, "reserve", 3), (1, 3, "failure", 1), (1, 4, "reserve", 4), (1, 5, "success", 2), (1, 6, "reserve", 5), (2, 7, "reserve", 6)]
    schema = "user_id long, at_ms long, kind string, document long"
    for part in (events[:3], events[3:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        read = spark.readStream.schema(schema).json(f"{tmp_path}/in")
        started(spark, keyed.reservation_stream(read, 2, 3_600_000), tmp_path, availableNow=True).awaitTermination(120)
    batch = limits.trial_reservations(spark.createDataFrame(events, schema), 2, 3_600_000)
    found = {r.document: r.allowed for r in rows_of(spark, tmp_path, keyed.TrialReservations.OUT)}
    assert found == {r.document: r.allowed for r in batch.collect()}


def test_store_calls_do_not_grow_with_events():
    """A request's events in one trigger ask the state store as often whether they are 5 or 500, and
    nothing after its end is made into a row."""

    class Store:
        calls = 0

        def __getattr__(self, name):
            def call(*_):
                Store.calls += 1
                return False if name in ("exists", "containsKey") else None if name == "get" else iter(())

            return call

    class Handle:
        def __getattr__(self, name):
            return lambda *_: Store() if name.startswith("get") else iter(())

    def calls(n, ends):
        kinds = ["classified"] * n + (["error"] if ends else []) + ["classified"] * n * ends
        events = pd.DataFrame({"request_id": "r", "seq": range(1, len(kinds) + 1), "type": kinds, "t": 0, "i": None, "text": None, "document_type": None, "items": None, "error": None})
        stages_of = keyed.RequestStages(1000)
        stages_of.init(Handle())
        Store.calls = 0
        clock = type("Clock", (), {"getCurrentProcessingTimeInMs": lambda self: 0})()
        told = list(stages_of.handleInputRows(("r",), iter([events]), clock))
        assert [f.classified.tolist() for f in told] == ([[n]] if ends else [])
        return Store.calls

    assert calls(5, True) == calls(500, True) and calls(5, False) == calls(500, False)
