"""Tallies of evaluation runs and registry refreshes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def verdict_tally(results: DataFrame) -> DataFrame:
    """(verdict, n, mean_latency_ms, micr_parsed) of results (file, verdict, latency_ms,
    micr_parsed); a null verdict is an error."""
    return results.groupBy(F.coalesce("verdict", F.lit("error")).alias("verdict")).agg(F.count("*").alias("n"), F.avg("latency_ms").alias("mean_latency_ms"), F.count_if(F.coalesce("micr_parsed", F.lit(False))).alias("micr_parsed"))


def uncertain_fields(fields: DataFrame) -> DataFrame:
    """(name, n): how often a field that holds something is of medium or low confidence, from
    flattened records."""
    return fields.filter(F.col("confidence").isin("medium", "low")).groupBy("name").agg(F.count("*").alias("n"))


def refresh_summary(sources: DataFrame, run_started_at: Column) -> DataFrame:
    """(ok, failed): sorted sources that the last run touched, of (source, status, started_at)."""
    touched = F.col("started_at") >= run_started_at
    pick = lambda ok: F.array_sort(F.collect_set(F.when(touched & ((F.col("status") == "ok") == ok), F.col("source"))))
    return sources.agg(pick(F.lit(True)).alias("ok"), pick(F.lit(False)).alias("failed"))
