"""Sinks: tiles, the log behind them, results and windows as lines of JSON, policy files, bulk loads, policy reload in a stream."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stockwell.sources.traces import canonical_json, policy


def write_tiles(df: DataFrame, path: str, region: str, key: str) -> None:
    """Files by region, each sorted by key. Two rows of one key in a region fail the write."""
    again = F.lag(key).over(Window.partitionBy(region).orderBy(key)).eqNullSafe(F.col(key))
    once = df.withColumn("_ok", F.assert_true(~again | F.col(key).isNull(), "two entries of one key")).where("_ok is null").drop("_ok")
    once.sortWithinPartitions(region, key).write.partitionBy(region).parquet(path)


def rotate_log(spark: SparkSession, log_path: str, rotated_path: str, cutoff: int) -> None:
    """What of a log is not published yet, as the log that replaces it. The old one stays until its owner drops it."""
    spark.read.parquet(log_path).where(F.col("csn") > cutoff).write.parquet(rotated_path)


def write_results(results: DataFrame, path: str) -> None:
    """line, id, blocks of each replayed request as lines of JSON."""
    canonical_json(results.select("line", "id", "blocks"), path)


def write_windows(windows: DataFrame, path: str) -> None:
    """One object per window, keys in sorted order."""
    canonical_json(windows, path)


def write_policy(spark: SparkSession, settings: dict[str, dict[str, int]], path: str) -> None:
    """default and regions as one JSON document with sorted keys, overwriting. Small by nature: an entry per region."""
    document = {"default": settings.get("default", {}), "regions": {r: s for r, s in settings.items() if r != "default"}}
    spark.createDataFrame([(json.dumps(document, sort_keys=True, separators=(",", ":")),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def bulk_load(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


class PolicyReload:
    """The policy in force, read again at every window; a file that is missing or bad leaves the one before in force."""

    def __init__(self, spark: SparkSession, path: str, defaults: dict[str, int]):
        self.spark, self.path, self.defaults, self.refused = spark, path, defaults, 0
        self.now = {"default": dict(defaults)}

    def window(self) -> dict[str, dict[str, int]]:
        try:
            self.now = policy(self.spark, self.path, self.defaults)
        except Exception:  # whatever is wrong with the file, requests go on under the old one
            self.refused += 1
        return self.now

    def sink(self, use):
        """For foreachBatch: use(batch, policy)."""
        return lambda batch, _: use(batch, self.window())
