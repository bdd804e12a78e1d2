"""Queries over numbered, timed and streamed events, and over literal values, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from papyrine.operators import literals, numbering, schedule
from papyrine.plans.queries import query
from papyrine.sources import ndjson_chunks
from papyrine.streaming import keyed
from papyrine.workspace import fresh_path


def events_of(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet")


@query(
    """SELECT event_id, user_id, row_number() OVER (ORDER BY ts, event_id) AS seq, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS user_seq,
  epoch_us(ts) // 1000 - min(epoch_us(ts) // 1000) OVER (PARTITION BY user_id) AS t FROM events"""
)
def stage_numbers(spark, sf_dir):
    """Running numbers over all events and those of each user, and the clock since a user's first."""
    every = numbering.numbered(events_of(spark, sf_dir).select("event_id", "user_id", "ts"), "ts", "event_id", name="seq")
    each = numbering.numbered_by(every, ["user_id"], "ts", "event_id", name="user_seq")
    return numbering.since_first(each, ["user_id"], "ts", "t").drop("ts")


ZONE, FIRST_DAY, LAST_DAY = "Asia/Jerusalem", "2023-12-31", "2024-02-01"


@query(
    f"""WITH dues AS (SELECT CAST(date_diff('day', DATE '1970-01-01', d) AS BIGINT) AS n, d + INTERVAL 1 HOUR AS due FROM generate_series(TIMESTAMP '{FIRST_DAY}', TIMESTAMP '{LAST_DAY}', INTERVAL 1 DAY) t(d)),
j AS (SELECT r.*, n, due FROM (SELECT event_id, user_id, ts FROM events WHERE event_type = 'signup') r ASOF LEFT JOIN dues ON r.ts >= due),
p AS (SELECT *, row_number() OVER (PARTITION BY user_id, n ORDER BY ts, event_id) = 1 AND n IS NOT NULL AS is_first FROM j),
f AS (SELECT user_id, n, coalesce(n - lag(n) OVER (PARTITION BY user_id ORDER BY n) - 1, 0) AS missed FROM p WHERE is_first)
SELECT event_id, p.n AS due_n, epoch_us(ts) // 1000 - epoch_us(due) // 1000 AS delay_ms, is_first AS first, CASE WHEN is_first THEN missed END AS coalesced FROM p LEFT JOIN f ON p.user_id = f.user_id AND p.n = f.n"""
)
def runs_answered(spark, sf_dir):
    """Each user's runs against the daily instants: 03:00 in a zone two hours ahead in January."""
    runs = events_of(spark, sf_dir).filter("event_type = 'signup'").select("event_id", "user_id", "ts")
    found = schedule.answered(runs, schedule.due_times(spark, FIRST_DAY, LAST_DAY, ZONE), "ts", ["user_id"], ["event_id"])
    return found.select("event_id", "due_n", "delay_ms", "first", "coalesced")


#: What SQL's trim cuts off: the separators of Unicode, but no tabs and line ends.
SEPARATORS = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


@query(
    """SELECT DISTINCT doc_id, needle FROM documents JOIN (
  SELECT DISTINCT lower(trim(substr(text, CAST(1 + item_id % 7 AS INT), CAST(3 + item_id % 41 AS INT)))) AS needle FROM benchmark
  UNION SELECT DISTINCT lower(trim(substr(text, 3, CAST(2 + conv_id % 9 AS INT)))) FROM conversations WHERE turn = 0 AND conv_id % 5 = 0) ON needle <> '' AND contains(lower(text), needle)"""
)
def literal_hits(spark, sf_dir):
    """Pieces of benchmark items and of first turns, wherever a document holds one."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").selectExpr("substr(text, cast(1 + item_id % 7 as int), cast(3 + item_id % 41 as int)) as value")
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").filter("turn = 0 and conv_id % 5 = 0").selectExpr("substr(text, 3, cast(2 + conv_id % 9 as int)) as value")
    return literals.held_literals(spark.read.parquet(f"{sf_dir}/documents.parquet"), items.union(turns), blanks=SEPARATORS)


_EVENT = "seq int, type string, t long, i int, kind string, text string, document_type string, items string, error string"


def staged_events(spark, sf_dir):
    """The events of each user as a request's: an error ends it, and the last event of one without an error."""
    kind = F.create_map(*[F.lit(x) for x in ("view", "classified", "click", "read", "purchase", "note", "signup", "later", "error", "error")])
    numbered = numbering.numbered_by(events_of(spark, sf_dir).select("user_id", "event_id", "ts", "event_type"), ["user_id"], "event_id", name="seq")
    last = numbered.groupBy("user_id").agg((F.max("seq") + 1).alias("seq"), F.max_by("ts", "event_id").alias("ts"))
    told = numbered.select("user_id", "seq", "ts", F.try_element_at(kind, "event_type").alias("type")).unionByName(last.withColumn("type", F.lit("done")))
    none = F.lit(None).cast("string")
    return told.select(
        F.col("user_id").cast("string").alias("request_id"), F.col("seq").cast("int").alias("seq"), "type", F.unix_millis(F.col("ts").cast("timestamp")).alias("t"), F.lit(None).cast("int").alias("i"),
        *[none.alias(c) for c in ("kind", "text", "document_type", "items")], F.when(F.col("type") == "error", "UPSTREAM").alias("error"),
    )


@query(
    """WITH n AS (SELECT *, min(CASE WHEN event_type = 'error' THEN event_id END) OVER (PARTITION BY user_id) AS ended FROM events),
b AS (SELECT *, ended IS NULL OR event_id < ended AS counts FROM n), s AS (
  SELECT user_id, any_value(ended) IS NULL AS done, count(*) FILTER (counts AND event_type = 'view') AS classified, count(*) FILTER (counts AND event_type = 'click') AS read_count,
    count(*) FILTER (counts AND event_type = 'purchase') AS n_notes, max(epoch_us(ts) // 1000) FILTER (counts AND event_type = 'click') AS last_read, max(epoch_us(ts) // 1000) AS last_ms,
    max(epoch_us(ts) // 1000) FILTER (counts AND event_type = 'view') AS last_view FROM b GROUP BY user_id)
SELECT CAST(user_id AS STRING) AS request_id, CASE WHEN done THEN 'done' ELSE 'error' END AS stage, CAST(classified AS INT) AS classified, CAST(read_count AS INT) AS read_count, CAST(n_notes AS INT) AS n_notes,
  CASE WHEN last_view IS NOT NULL THEN 0 END AS classify_ms, CASE WHEN last_read IS NOT NULL THEN 0 END AS read_ms, CASE WHEN done THEN last_ms - coalesce(last_read, last_ms) END AS merge_ms,
  CASE WHEN NOT done THEN 'UPSTREAM' END AS error, CASE WHEN NOT done THEN CASE WHEN read_count > 0 THEN 'merging' ELSE 'uploading' END END AS error_stage FROM s"""
)
def stage_stream(spark, sf_dir):
    """Requests written as NDJSON in chunks of 1,000 bytes, read as a stream and folded with keyed state."""
    ndjson_chunks.register(spark)
    path = fresh_path(spark, "stage-chunks")
    lines = staged_events(spark, sf_dir).select(F.col("request_id").alias("stream"), "seq", F.to_json(F.struct(*[part.split()[0] for part in _EVENT.split(", ")])).alias("value"))
    lines.repartition("stream").sortWithinPartitions("stream", "seq").select("stream", "value").write.format("ndjson_chunks").option("chunkBytes", 1_000).mode("append").save(path)
    read = spark.readStream.format("ndjson_chunks").load(path)
    events = read.select(F.col("stream").alias("request_id"), F.from_json("value", _EVENT).alias("e")).select("request_id", "e.*")
    out = fresh_path(spark, "stage-summaries")
    with keyed.use_rocksdb(spark, drain=True):
        told = keyed.progress_stream(events, 3_600_000).writeStream.format("parquet").option("checkpointLocation", fresh_path(spark, "stage-checkpoint"))
        told.trigger(availableNow=True).start(out).awaitTermination()
    columns = ["request_id", "stage", "classified", "read_count", "n_notes", "classify_ms", "read_ms", "merge_ms", "error", "error_stage"]
    return spark.read.schema(keyed.stages.SUMMARY).parquet(out).select(*columns)
