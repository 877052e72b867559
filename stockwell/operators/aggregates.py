"""Telemetry and descriptor aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed values of the latency histogram: number of buckets, lower bound of the second one (ns), ratio.
BUCKETS, BASE_NS, RATIO = 128, 100.0, 1.15


def bucket_bounds() -> list[int]:
    """Lower bounds: 0, then BASE_NS * RATIO^(i - 1), rounded half up."""
    return [0, *(int(BASE_NS * RATIO ** (i - 1) + 0.5) for i in range(1, BUCKETS))]


def bucket_of(ns: Column) -> Column:
    """The last bucket whose bound is at or below a number, from 0: a logarithm, corrected by the bounds beside it."""
    bounds = F.array(*[F.lit(x).cast("long") for x in bucket_bounds()])
    near = F.floor(F.log(F.greatest(ns, F.lit(1)) / BASE_NS) / F.log(F.lit(RATIO))) + 1
    near = F.least(F.greatest(near, F.lit(0)), F.lit(BUCKETS - 1)).cast("int")
    above = F.get(bounds, near + 1) <= ns  # null beyond the last one
    return F.when(above, near + 1).when(F.get(bounds, near) > ns, near - 1).otherwise(near).cast("long")


def histogram(df: DataFrame, keys: list[str], ns: str) -> DataFrame:
    """keys, bucket, n: counts by bucket_of."""
    return df.groupBy(*keys, bucket_of(F.col(ns)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def histogram_quantile(hist: DataFrame, keys: list[str], q: float, out: str) -> DataFrame:
    """keys, out: rank ceil(q n), at least 1; linear inside the first bucket, geometric inside the others."""
    w = Window.partitionBy(*keys).orderBy("bucket")
    total = F.sum("n").over(Window.partitionBy(*keys))
    rows = hist.withColumn("_cum", F.sum("n").over(w)).withColumn("_rank", F.greatest(F.lit(1), F.ceil(F.lit(q) * total)))
    rows = rows.where((F.col("_cum") >= F.col("_rank")) & (F.col("_cum") - F.col("n") < F.col("_rank")))
    share = (F.col("_rank") - (F.col("_cum") - F.col("n"))) / F.col("n")
    bounds = F.array(*[F.lit(float(max(1, x))) for x in bucket_bounds()])
    lower = F.element_at(bounds, (F.col("bucket") + 1).cast("int"))
    return rows.select(*keys, F.when(F.col("bucket") == 0, share * BASE_NS).otherwise(lower * F.pow(F.lit(RATIO), share)).alias(out))


def cap_and_fold(df: DataFrame, key: str, seq: str, most: int, measures: list[Column]) -> DataFrame:
    """Measures by key for the `most` keys seen first; the rest under 'other'. Ranking is over distinct keys."""
    first = df.groupBy(key).agg(F.min(seq).alias("_first"))
    kept = first.orderBy("_first", key).limit(most).select(F.col(key).alias("_kept"))
    named = df.join(F.broadcast(kept), F.col(key) == F.col("_kept"), "left")  # `most` rows at the most
    return named.groupBy(F.coalesce("_kept", F.lit("other")).alias(key)).agg(*measures)


def ratio(num: Column, den: Column) -> Column:
    """A struct of value and reason: undefined ratios are null with a reason, never 0."""
    reason = F.when(num.isNull(), "no numerator").when(den.isNull(), "no denominator").when(den == 0, "zero denominator")
    return F.struct(F.when(reason.isNull(), F.try_divide(num.cast("double"), den.cast("double"))).alias("value"), reason.alias("reason"))


def cheapest_run(tiles: DataFrame, budget: int) -> DataFrame:
    """region, start, length, total: per region the adjacent run of the least size within the budget (ties: the first
    start), or the cheapest pair if none fits. tiles: region, idx (gapless), size >= 0.

    Adding a tile to a run never makes it smaller, so the cheapest run is always a pair.
    """
    w = Window.partitionBy("region").orderBy("idx")
    pairs = tiles.withColumn("total", F.col("size") + F.lead("size").over(w)).where("total is not null")
    best = pairs.groupBy("region").agg(F.min(F.struct((F.col("total") > budget).alias("over"), F.col("total").alias("total"), F.col("idx").alias("idx"))).alias("b"))
    return best.select("region", F.col("b.idx").alias("start"), F.lit(2).cast("long").alias("length"), F.col("b.total").alias("total"))
