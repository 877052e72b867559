"""Placement and layout cost: dependent reads, tiles, service time, penalties, compaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stockwell.operators.ranking import rank_by_range


def assign_tiles(keys: DataFrame, key: str, per_tile: int) -> DataFrame:
    """tile of each key of one region: every `per_tile` entries in key order."""
    return rank_by_range(keys, key, "_at").withColumn("tile", F.floor((F.col("_at") - 1) / per_tile).cast("long")).drop("_at")


def dependent_reads(reads: DataFrame, request: str, position: str, place: list[str]) -> DataFrame:
    """request, reads: one plus the changes of place along the request's reads."""
    w = Window.partitionBy(request).orderBy(position)
    before = F.lag(F.struct(*place)).over(w)
    moved = reads.withColumn("_new", (before.isNull() | (before != F.struct(*place))).cast("long"))
    return moved.groupBy(request).agg(F.sum("_new").alias("reads"))


def streaks(df: DataFrame, keys: list[str], order: list[str], bad: Column, least: int) -> DataFrame:
    """keys, length, begins: runs of `least` or more consecutive bad rows; a good row ends a run."""
    w = Window.partitionBy(*keys).orderBy(*order)
    runs = df.withColumn("_bad", bad).withColumn("_run", F.sum(F.when(F.col("_bad"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.where("_bad").groupBy(*keys, "_run").agg(F.count(F.lit(1)).alias("length"), F.min(order[0]).alias("begins")).where(F.col("length") >= least).drop("_run")


def schedule(df: DataFrame, seq: str, rate: str, segment: str, out: str, width: int = 4096) -> DataFrame:
    """df with the due time in microseconds within a segment: the gaps 1e6 / rate of the requests before, summed.

    Gaps are summed by ranges of `seq` (a unique bigint), the ranges' sums are prefix-summed, and rows go through
    a window inside their range only.
    """
    rows = df.withColumn("_gap", F.lit(1_000_000) / F.col(rate)).withColumn("_part", F.floor(F.col(seq) / width))
    before = lambda c, by, order: F.coalesce(F.sum(c).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    parts = rows.groupBy(segment, "_part").agg(F.sum("_gap").alias("_sum"))
    parts = parts.select(segment, "_part", before("_sum", [segment], "_part").alias("_off"))
    inside = before("_gap", [segment, "_part"], seq)
    return rows.join(parts, [segment, "_part"]).withColumn(out, F.col("_off") + inside).drop("_gap", "_part", "_off")


def saturation(df: DataFrame, keys: list[str], order: str, late: Column, least: int) -> DataFrame:
    """df with streak, the late rows in a row up to here, and saturated (`least` or more). One row per window, so few."""
    w = Window.partitionBy(*keys).orderBy(order)
    rows = df.withColumn("_run", F.sum(F.when(late, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_late", late)
    streak = F.when(F.col("_late"), F.row_number().over(Window.partitionBy(*keys, "_run", "_late").orderBy(order))).otherwise(0).cast("long")
    return rows.withColumn("streak", streak).withColumn("saturated", F.col("streak") >= least).drop("_run", "_late")
