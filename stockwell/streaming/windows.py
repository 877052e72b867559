"""Tumbling windows of telemetry, as one expression for batch and stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockwell.functions.scalars import reject_reason




def records(rows: DataFrame, ts: str, width: str, value: str, ceiling: float, errors) -> DataFrame:
    """One record per window that has rows: counts, exact percentiles, late rows (counted, never dropped) and the verdict."""
    late = F.sum(F.when(F.col(value) > ceiling, 1).otherwise(0)).cast("long")
    failed = F.sum(F.when(errors, 1).otherwise(0)).cast("long")
    p = lambda q: F.expr(f"percentile_disc({q}) within group (order by {value})")
    out = rows.groupBy(F.window(ts, width).alias("w")).agg(F.count(F.lit(1)).alias("requests"), late.alias("late"), failed.alias("errors"), p(0.5).alias("p50"), p(0.99).alias("p99"))
    verdict = reject_reason(F.col("p99") > ceiling, F.lit(False), F.lit(False), F.col("errors") * 5 > F.col("requests"))
    return out.select(F.col("w.start").alias("window_start"), "requests", "late", "errors", "p50", "p99", verdict.alias("reject_reason"))


def with_empty(found: DataFrame, at: str, step: int, measures: list[str]) -> DataFrame:
    """Windows by number (`at`, a bigint) from the first to the last, those without rows with zeros."""
    span = found.agg(F.min(at).alias("a"), F.max(at).alias("b")).where("a is not null")
    every = span.select(F.explode(F.sequence("a", "b", F.lit(step).cast("long"))).alias(at))
    return every.join(found, at, "left").fillna(0, measures)


def run_stream(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> None:
    """Drive a streaming result over all available input into the table `name` in memory."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
