
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = "1995-01-01"
#: Tombstones of the change log are events of this type.
TOMBSTONE = "error"
#: Days that a product version lasts; the last one stays open.
VERSION_DAYS, OPEN_DAY = 800, 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def day(ts: str):
    return F.datediff(F.col(ts), F.lit(EPOCH).cast("date")).cast("long")


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """handle, csn, deleted, event_type, value: versions of user documents; csn is unique."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("handle"), F.col("event_id").alias("csn"), (F.col("event_type") == TOMBSTONE).alias("deleted"), "event_type", "value")


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    return l.select(F.col("l_orderkey").alias("order_no"), F.col("l_linenumber").cast("long").alias("line_no"), F.col("l_partkey").alias("sku"), F.col("l_suppkey").alias("loc"), F.col("l_quantity").cast("long").alias("qty"), day("l_shipdate").alias("day"), (F.col("l_returnflag") == "R").alias("returned"))


def movements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """order_no, line_no, sku, loc, delta, day: returned lines come in, others go out."""
    delta = F.when(F.col("returned"), F.col("qty")).otherwise(-F.col("qty"))
    return order_lines(spark, sf_dir).select("order_no", "line_no", "sku", "loc", delta.alias("delta"), "day")


def product_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sku, k, valid_from, valid_to (exclusive), lead_time_days: 1 + sku % 3 versions of each product."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("sku"))
    v = p.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("sku") % 3)))
    to = F.when(F.col("k") == F.col("sku") % 3, F.lit(OPEN_DAY)).otherwise((F.col("k") + 1) * VERSION_DAYS)
    return v.select("sku", "k", (F.col("k") * VERSION_DAYS).alias("valid_from"), to.cast("long").alias("valid_to"), (1 + (F.col("sku") * 7 + F.col("k") * 13) % 30).alias("lead_time_days"))


#: The same images as DuckDB common table expressions.
SQL = {
    "log": f"log AS (SELECT user_id AS handle, event_id AS csn, event_type = '{TOMBSTONE}' AS deleted, event_type, value FROM events)",
    "lines": f"lines AS (SELECT l_orderkey AS order_no, l_linenumber::BIGINT AS line_no, l_partkey AS sku, l_suppkey AS loc, l_quantity::BIGINT AS qty, date_diff('day', DATE '{EPOCH}', l_shipdate::DATE)::BIGINT AS day, l_returnflag = 'R' AS returned FROM lineitem)",
    "movements": "movements AS (SELECT order_no, line_no, sku, loc, CASE WHEN returned THEN qty ELSE -qty END AS delta, day FROM lines)",
    "versions": f"versions AS (SELECT sku, k, k * {VERSION_DAYS} AS valid_from, CASE WHEN k = sku % 3 THEN {OPEN_DAY} ELSE (k + 1) * {VERSION_DAYS} END::BIGINT AS valid_to, 1 + (sku * 7 + k * 13) % 30 AS lead_time_days FROM (SELECT p_partkey AS sku, unnest(range(0, p_partkey % 3 + 1)) AS k FROM part))",
}


def with_images(*names: str, sql: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names) + (", " if not sql.lstrip().upper().startswith("SELECT") else "\n") + sql
