"""Deterministic generators: Zipf ranks, the request mix, synthetic documents, load segments with drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stockwell.operators.ranking import rank_by_range

#: The scale of integer Zipf weights, and the request mix in percent.
ZIPF_SCALE = 2**32
MIX = (("order_flow", 70), ("stock_lookup", 15), ("customer_lookup", 10), ("movements_scan", 5))
#: Cells that the range of draws is cut into when draws meet ranks.
CELLS = 4096


def zipf_weights(keys: DataFrame, key: str, width: int = 4096) -> DataFrame:
    """key, rank, before, upto: the integer weight of rank r is ZIPF_SCALE / r, 1 at least, and owns [before, upto) of all weights.

    Prefix sums over ranges of ranks, then within a range: no window spans all keys.
    """
    rows = rank_by_range(keys, key, "rank")
    rows = rows.withColumn("_w", F.greatest(F.lit(1), F.floor(F.lit(ZIPF_SCALE) / F.col("rank"))).cast("long"))
    rows = rows.withColumn("_part", F.floor((F.col("rank") - 1) / width))
    sums = rows.groupBy("_part").agg(F.sum("_w").alias("_s"))
    before = F.coalesce(F.sum("_s").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.join(sums.select("_part", before.alias("_off")), "_part")
    inside = F.sum("_w").over(Window.partitionBy("_part").orderBy("rank"))
    return rows.select(key, "rank", (F.col("_off") + inside - F.col("_w")).alias("before"), (F.col("_off") + inside).alias("upto"))


def zipf_draws(draws: DataFrame, draw: str, weights: DataFrame) -> DataFrame:
    """The rows of `draws` with the rank that owns draw modulo the sum of all weights.

    Owners are looked up by order instead of by a range join: in each cell of the range, draws and the
    beginnings of ranks are sorted together and the last rank begun is carried on. A rank that reaches
    over several cells begins in each of them.
    """
    total = weights.agg(F.max("upto")).first()[0] or 1
    width = max(1, -(-total // CELLS))
    begins = weights.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("before") / width), F.floor((F.col("upto") - 1) / width))))
    begins = begins.select("_cell", F.greatest("before", F.col("_cell") * width).alias("_at"), F.lit(0).alias("_kind"), F.col("rank").alias("_rank"))
    at = (F.col(draw) % F.lit(total)).cast("long")
    asked = draws.withColumn("_at", at).withColumn("_cell", F.floor(F.col("_at") / width)).withColumn("_kind", F.lit(1))
    both = asked.unionByName(begins, allowMissingColumns=True)
    last = F.last("_rank", ignorenulls=True).over(Window.partitionBy("_cell").orderBy("_at", "_kind"))
    return both.withColumn("rank", last).where("_kind = 1").drop("_at", "_cell", "_kind", "_rank")


def mix_shape(percent: Column) -> Column:
    """The request shape of a number from 0 to 99."""
    upto, out = 0, None
    for name, share in MIX:
        upto += share
        out = F.when(percent < upto, name) if out is None else out.when(percent < upto, name)
    return out


def synthetic_documents(tags: DataFrame, n: int) -> DataFrame:
    """tag, index, doc: `n` documents of each tag; what they hold depends on tag and index alone."""
    rows = tags.select("tag", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("index"))
    body = F.md5(F.concat_ws(":", "tag", F.col("index").cast("string")).cast("binary"))
    name = F.concat("tag", F.lit("-"), F.lpad(F.col("index").cast("string"), 6, "0"))
    return rows.select("tag", "index", F.to_json(F.struct(body.alias("body"), name.alias("id"))).alias("doc"))


def segments(rows: DataFrame, seq: str, size: int, rates: list[float]) -> DataFrame:
    """Rows with their load segment (`size` numbers of `seq` each) and its offered rate, which the list gives in turn."""
    segment = F.floor(F.col(seq) / size)
    rate = F.element_at(F.array(*[F.lit(r) for r in rates]), (segment % len(rates) + 1).cast("int"))
    return rows.withColumn("segment", segment).withColumn("rate", rate)


def drifted_shares(rows: DataFrame, shape: str, drifting: str, factor: int) -> DataFrame:
    """segment, shape, share, rate: shares of the shapes by segment, the weight of one multiplied in every second segment."""
    w = rows.groupBy("segment", shape).agg(F.count(F.lit(1)).cast("double").alias("weight"), F.max("rate").alias("rate"))
    w = w.withColumn("weight", F.col("weight") * F.when((F.col("segment") % 2 == 1) & (F.col(shape) == drifting), factor).otherwise(1))
    return w.select("segment", shape, F.round(F.col("weight") / F.sum("weight").over(Window.partitionBy("segment")), 9).alias("share"), "rate")
