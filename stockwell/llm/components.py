"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockwell.llm.common import Scratch


def components(edges: DataFrame, a="a", b="b") -> DataFrame:
    """node, root: every node of `edges` (two bigint columns, not null) with the smallest node reachable.

    Large-star and small-star rounds: every node passes its neighbours on to its smallest neighbour. Only
    minima per node are aggregated, so a node with many neighbours is never gathered in one task; links
    stay in tables in the shared folder and the driver sees one checksum per round. No edges: no rows.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    now = Scratch(pairs, "cc")
    mark = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    seen = mark(now.df)
    while seen[0]:
        both = now.df.unionByName(now.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        mid = Scratch(large, "cc")
        least = mid.df.groupBy("u").agg(F.min("v").alias("m"))
        small = mid.df.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        after = Scratch(small, "cc")
        mid.drop()
        now.drop()
        now, before, seen = after, seen, mark(after.df)
        if seen == before:
            break
    roots = now.df.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.df.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
