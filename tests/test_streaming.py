"""Folds over events: in batch, as a stream, and at any number of partitions."""

import json

from pyspark.sql import functions as F

from papyrine.streaming import limits, stages

EVENTS = "request_id string, seq int, type string, t long, i int, kind string, text string, document_type string, items string, error string"


def event(request, seq, type_, t, **more):
    return (request, seq, type_, t, *(more.get(c) for c in ("i", "kind", "text", "document_type", "items", "error")))


def script():
    regions = json.dumps([{"i": 0}, {"i": 1, "skipped": True}, {"i": 2}])
    triage = json.dumps({"read": [0, 2], "skipped": []})
    a = [
        ("page", 10, {}), ("regions", 40, {"items": regions}), ("classified", 50, {"i": 0, "kind": "sefach"}), ("classified", 70, {"i": 2}), ("triage", 75, {"items": triage}), ("later", 76, {}),
        ("reading", 80, {"i": 0}), ("read", 100, {"i": 0, "document_type": "cheque"}), ("note", 101, {"text": "Region 3 x could not be read"}), ("note", 102, {"text": "Region 3 x could not be read"}), ("done", 130, {}), ("error", 140, {"error": "late"}),
    ]
    b = [("page", 5, {}), ("regions", 9, {"items": "[]"}), ("reading", 11, {}), ("error", 30, {"error": "UPSTREAM"})]
    return [event(r, n, k, t, **m) for r, s in (("a", a), ("b", b)) for n, (k, t, m) in enumerate(s)]


def expected():
    return {
        "a": ("done", 2, 2, 2, 2, 30, 30, 25, 30, 2, '{"0": "read", "1": "skipped", "2": "failed"}', None, None),
        "b": ("error", 1, 0, 0, 0, 4, None, None, None, 0, "{}", "UPSTREAM", "reading"),
    }


def plain(row):
    return tuple(None if v != v else v for v in row[1:])


def test_stage_fold_at_any_partitioning(spark):
    for n in (1, 7):
        events = spark.createDataFrame(script(), EVENTS).repartition(n)
        assert {r.request_id: plain(r) for r in stages.progress(events).collect()} == expected()


def test_stage_stream(spark, tmp_path):
    rows = script()
    for n, part in enumerate((rows[:8], rows[8:])):
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    events = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
    run = stages.progress_stream(events, 3_600_000).writeStream.format("memory").queryName("stage_out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert {r.request_id: plain(r) for r in spark.table("stage_out").collect()} == expected()


def test_token_bucket(spark):
    requests = [("k", 0, n) for n in range(11)] + [("k", 5_999, 11), ("k", 6_000, 12), ("other", 0, 13)]
    found = {r.request: (r.allowed, r.retry_after_s) for r in limits.token_bucket(spark.createDataFrame(requests, "key string, at_ms long, request long"), 10).collect()}
    assert all(found[n][0] for n in range(10)) and found[13][0]
    assert found[10] == (False, 6) and found[11] == (False, 1) and found[12][0]


def test_trial_reservations(spark):
    events = [(1, 0, "reserve", 1), (1, 1, "reserve", 2), (1, 2, "reserve", 3), (1, 3, "failure", 1), (1, 4, "reserve", 4), (1, 5, "success", 2), (1, 100, "reserve", 5), (1, 101, "reserve", 6)]
    found = limits.trial_reservations(spark.createDataFrame(events, "user_id long, at_ms long, kind string, document long"), cap=2, window_ms=50)
    assert {r.document: r.allowed for r in found.collect()} == {1: True, 2: True, 3: False, 4: True, 5: True, 6: False}


def test_requests_of_the_event_table(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    requests = events.select(F.col("user_id").cast("string").alias("key"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"), F.col("event_id").alias("request"))
    assert limits.token_bucket(requests, 10).count() == events.count()
