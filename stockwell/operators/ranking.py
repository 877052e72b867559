"""Exact ranks without a window over all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def rank_by_range(df: DataFrame, key: str, out: str, width: int = 4096) -> DataFrame:
    """1-based rank by a unique bigint key: counts of key ranges are prefix-summed, rows are numbered within a range."""
    rows = df.withColumn("_range", F.floor(F.col(key) / width))
    counts = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_range", before.alias("_off"))
    number = F.row_number().over(Window.partitionBy("_range").orderBy(key))
    return rows.join(offsets, "_range").withColumn(out, F.col("_off") + number).drop("_range", "_off")
