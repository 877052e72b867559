"""Exact quantiles of groups of any size: a histogram finds the range of each rank, and only that range is ordered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Ranges for each factor of e in size.
STEPS = 200


def _range(value: Column) -> Column:
    """A number of ranges that grows with the value."""
    return (F.signum(value) * F.floor(F.log1p(F.abs(value)) * STEPS)).cast("long")


def exact(df: DataFrame, keys: list[str], value: str, nearest: dict[str, float] | None = None, linear: dict[str, float] | None = None) -> DataFrame:
    """keys and one column per name: `nearest` takes the value of rank ceil(q n), at least 1; `linear` interpolates at 1 + q (n - 1).

    Nulls and NaN take no part; a group without values gives no row. A group is never ordered as a whole: rows
    are counted by range, and only rows of the ranges that hold a wanted rank are counted by value.
    """
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).where("_v is not null and not isnan(_v)").withColumn("_r", _range(F.col("_v")))
    ranges = rows.groupBy(*keys, "_r").agg(F.count(F.lit(1)).alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_r"))
    ranges = ranges.withColumn("_upto", upto).withColumn("_n", F.sum("_c").over(Window.partitionBy(*keys)))
    wanted = []
    for name, q in (nearest or {}).items():
        wanted.append(F.struct(F.lit(name).alias("name"), F.greatest(F.lit(1), F.ceil(F.lit(q) * F.col("_n"))).cast("long").alias("rank"), F.lit(1.0).alias("share")))
    for name, q in (linear or {}).items():
        at = 1 + F.lit(q) * (F.col("_n") - 1)
        below, part = F.floor(at).cast("long"), at - F.floor(at)
        wanted.append(F.struct(F.lit(name).alias("name"), below.alias("rank"), (1 - part).alias("share")))
        wanted.append(F.struct(F.lit(name).alias("name"), F.least(below + 1, F.col("_n")).alias("rank"), part.alias("share")))
    first = F.col("_upto") - F.col("_c")
    asked = ranges.select(*keys, "_r", first.alias("_first"), "_upto", F.inline(F.array(*wanted))).where("rank > _first and rank <= _upto")
    asked = asked.select(*keys, "_r", "name", "share", (F.col("rank") - F.col("_first")).alias("_rank"))
    by = [*keys, "_r"]
    values = rows.join(asked.select(*by).distinct(), by, "left_semi").groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_c"))
    values = values.withColumn("_upto", F.sum("_c").over(Window.partitionBy(*by).orderBy("_v")))
    met = asked.join(values, by).where((F.col("_rank") <= F.col("_upto")) & (F.col("_rank") > F.col("_upto") - F.col("_c")))
    names = [*(nearest or {}), *(linear or {})]
    return met.groupBy(*keys).agg(*[F.sum(F.when(F.col("name") == n, F.col("_v") * F.col("share"))).alias(n) for n in names])
