"""Reads of versioned documents: the newest version per key wins, and only then tombstones are hidden."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def newest(log: DataFrame, keys: list[str], version: str = "csn") -> DataFrame:
    """The newest row per key, tombstones included. An aggregate, so that versions are reduced before the shuffle."""
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(version)).alias("_")).select(*keys, "_.*")


def latest(log: DataFrame, keys: list[str] = ("handle",), version: str = "csn") -> DataFrame:
    return newest(log, list(keys), version).where("not deleted").drop("deleted")


def point_get(log: DataFrame, handle: int) -> DataFrame:
    return latest(log.where(F.col("handle") == handle))


def single(df: DataFrame, message: str) -> DataFrame:
    """The one row of `df`, or none; two live owners are an error."""
    some = df.limit(2).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy()))
    return some.where(F.assert_true(F.col("_n") <= 1, message).isNull()).drop("_n")


def reverse(df: DataFrame, reference: str, target, source: str) -> DataFrame:
    return df.where(F.col(reference) == target).select(source).sort(source)


def incremental(log: DataFrame, after: int) -> DataFrame:
    """Newest change per handle beyond a version, tombstones kept."""
    return newest(log.where(F.col("csn") > after), ["handle"])


def publish(log: DataFrame, lower: int, cutoff: int) -> DataFrame:
    """What a tile for versions in (lower, cutoff] holds, in key order."""
    return newest(log.where((F.col("csn") > lower) & (F.col("csn") <= cutoff)), ["handle"]).sort("handle")


def compact(tiles: list[DataFrame]) -> DataFrame:
    """Tiles merged into one: newest version per key, tombstones kept."""
    out = tiles[0]
    for t in tiles[1:]:
        out = out.unionByName(t)
    return newest(out, ["handle"])


def overlay(base: DataFrame, delta: DataFrame, key: str = "handle") -> DataFrame:
    """base with delta on top: any handle that delta names, live or dead, hides its base rows."""
    live = newest(delta, [key]).where("not deleted").drop("deleted")
    return base.drop("deleted").join(delta.select(key).distinct(), key, "left_anti").unionByName(live)


def net_conflicts(before: DataFrame, ops: DataFrame) -> DataFrame:
    """entity, field, value with more than one live owner after a block of operations.

    before: entity, field, value, owner. ops: seq, entity, field, value, owner, deleted; the last operation
    on a key in the block holds, so releasing and reusing a value inside one block is legal.
    """
    keys = ["entity", "field", "value", "owner"]
    last = newest(ops.withColumnRenamed("seq", "csn"), keys).select(*keys, "deleted")
    after = before.join(last, keys, "left_anti").select(*keys).unionByName(last.where("not deleted").select(*keys))
    return after.groupBy("entity", "field", "value").agg(F.countDistinct("owner").alias("owners")).where("owners > 1")


def allocate(df: DataFrame, base: Column | int, order: list[str]) -> DataFrame:
    """Handles in commit order after `base`: ranks within buckets of the order column would need its bounds, so
    the batch to commit, not the stored data, is what goes through one ordered numbering."""
    return df.withColumn("handle", F.lit(base) + F.row_number().over(Window.orderBy(*order)))
