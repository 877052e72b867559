"""Helpers shared by the text operators: inputs, scratch tables, exact distributed ranks."""

from __future__ import annotations

import atexit
import gc
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: What separates words everywhere in this subpackage: ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows that a group of one window may hold on average before it is spread further.
SUB_BUCKETS = 4096

#: Rows that Python workers get at a time, where the session keeps Spark's default: texts are long rows.
BATCH_ROWS = 2000

_made: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a local one only where none is set (tests)."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    return (base or "/tmp/checkpoints/stockwell").rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Python workers get BATCH_ROWS rows at a time, unless the session has chosen another number."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def remove_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _sweep() -> None:
    for spark, path in _made:
        try:
            remove_path(spark, path)
        except Exception:  # the session has ended: the folder's owner cleans up
            return


atexit.register(_sweep)


class Scratch:
    """A table written to the shared folder: lineage ends there, and a lost executor loses nothing."""

    def __init__(self, df: DataFrame, tag: str):
        self.spark = df.sparkSession
        small_batches(self.spark)
        self.path = f"{scratch_dir(self.spark)}/{tag}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        _made.append((self.spark, self.path))
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        """Delete it as soon as nothing reads it any more."""
        remove_path(self.spark, self.path)
        _made.remove((self.spark, self.path))


def materialize(df: DataFrame, tag: str) -> DataFrame:
    return Scratch(df, tag).df


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of finished steps, which it does when the driver's garbage is collected.

    Twice, because the last step's plan is held until the next job; removal itself runs in the background.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def ranked(df: DataFrame, part: list[str], order: list[str], sub: Column, tie: list[str], out: str) -> DataFrame:
    """Add `out`, the 1-based exact rank within `part` ordered by (order, sub, tie).

    No window spans a whole part: counts of (part, order) and (part, order, sub) are prefix-summed, and
    rows are numbered only inside (part, order, sub). part, order and sub must not be null; ties among
    fully equal rows are numbered arbitrarily.
    """
    keys = [*part, *order, "_sub"]
    rows = df.withColumn("_sub", sub)
    fine = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    before = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    coarse = fine.groupBy(*part, *order).agg(F.sum("_n").alias("_n"))
    w = Window.partitionBy(*part).orderBy(*order) if part else Window.orderBy(*order)
    coarse = coarse.select(*part, *order, before(w).alias("_coarse"))
    fine = fine.withColumn("_fine", before(Window.partitionBy(*part, *order).orderBy("_sub"))).drop("_n")
    offsets = fine.join(coarse, [*part, *order]).select(*keys, (F.col("_coarse") + F.col("_fine")).alias("_off"))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*tie))
    return rows.join(offsets, keys).withColumn(out, (F.col("_off") + number).cast("long")).drop("_off", "_sub")
