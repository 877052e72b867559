"""The join shapes: star fan-out, multi-hop, as-of, anti-join, and the pieces they are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def limit_per_parent(df: DataFrame, parent: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each parent in a total order (WindowGroupLimit prunes before the shuffle)."""
    w = Window.partitionBy(*parent).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def as_of(facts: DataFrame, versions: DataFrame, key: str, at: str, begin: str, end: str) -> DataFrame:
    """Each fact with the versions valid then: equal keys and at in [begin, end). The equal key makes it a hash
    or merge join with the range as a residual condition."""
    v = versions.withColumnRenamed(key, "_key")
    return facts.join(v, (F.col(key) == F.col("_key")) & (F.col(begin) <= F.col(at)) & (F.col(at) < F.col(end))).drop("_key")


def missing(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    return left.join(right, on, "left_anti")


def first_match(rows: DataFrame, lookups: list[tuple[DataFrame, Column]], value: str, out: str) -> DataFrame:
    """`value` from the first lookup whose condition holds. Each lookup must have one row per match."""
    found = []
    for k, (table, on) in enumerate(lookups):
        side = table.withColumn(f"_v{k}", F.col(value)).drop(value)
        rows = rows.join(side, on, "left")
        found.append(f"_v{k}")
    return rows.withColumn(out, F.coalesce(*found)).drop(*found)


def exclusive(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that are not in exactly one row of exactly one of a and b."""
    both = a.select(key, F.lit("a").alias("side")).unionByName(b.select(key, F.lit("b").alias("side")))
    return both.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n <> 1")
