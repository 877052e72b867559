"""Line sources: request traces, window telemetry, key=value logs, seed blocks, policies, run records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_LINE = 65_536


def trace(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """line (text), sha256, request of each JSON line. Malformed, oversized or duplicate-keyed lines fail the read.

    Order is part of a trace, so each request carries its own sequence in its id; Spark's row order is not used.
    """
    lines = spark.read.text(path).withColumnRenamed("value", "line")
    keys = F.json_object_keys("line")
    checked = F.when(F.octet_length("line") > MAX_LINE, F.raise_error(F.lit("line too long")))
    checked = checked.when(F.size(keys) != F.size(F.array_distinct(keys)), F.raise_error(F.lit("duplicate key")))
    lines = lines.withColumn("line", F.coalesce(checked.cast("string"), F.col("line")))
    return lines.select("line", F.sha2("line", 256).alias("sha256"), F.from_json("line", schema, {"mode": "FAILFAST"}).alias("request"))


def log_frames(spark: SparkSession, path: str) -> DataFrame:
    """seq, payload of a framed log, lines of `seq crc32c payload` (hexadecimal checksum of the payload).

    A last frame (the greatest seq) that does not check is a torn tail and is cut; any other fails the read.
    """
    from stockwell.functions.scalars import crc32c

    parts = F.split("value", " ", 3)
    rows = spark.read.text(path).select(F.get(parts, 0).try_cast("long").alias("seq"), F.get(parts, 1).alias("crc"), F.get(parts, 2).alias("payload"))
    rows = rows.withColumn("ok", F.coalesce(F.lower(F.lpad(F.hex(crc32c("payload")), 8, "0")) == F.col("crc"), F.lit(False)))
    last = rows.agg(F.max("seq")).first()[0]
    fine = F.assert_true(F.col("ok") | F.col("seq").isNull() | (F.col("seq") == F.lit(last)), "bad frame").isNull()
    return rows.where(fine).where("ok").select("seq", "payload")


def windows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Window telemetry: lines that are JSON objects; missing numbers are 0, other lines are skipped."""
    rows = spark.read.text(path).where(F.startswith("value", F.lit("{")))
    rows = rows.select(F.from_json("value", schema).alias("w")).select("w.*")
    return rows.fillna(0)


def key_values(spark: SparkSession, path: str) -> DataFrame:
    """fields: the k=v tokens of each line as a map; tokens without '=' are dropped."""
    tokens = F.filter(F.split("value", " +"), lambda t: F.contains(t, F.lit("=")))
    pairs = F.transform(tokens, lambda t: F.struct(F.substring_index(t, "=", 1).alias("k"), F.regexp_replace(t, "^[^=]*=", "").alias("v")))
    return spark.read.text(path).select(F.map_from_entries(pairs).alias("fields"))


def seed_blocks(spark: SparkSession, path: str) -> DataFrame:
    """block, entity, doc (JSON), unique_field, unique_value (JSON): documents of seed blocks; a declared unique value must be in its document."""
    schema = "block string, docs array<struct<entity: string, doc: string, unique: struct<field: string, value: string>>>"
    docs = spark.read.schema(schema).option("mode", "FAILFAST").json(path).select("block", F.inline("docs"))
    docs = docs.select("block", "entity", "doc", F.col("unique.field").alias("unique_field"), F.col("unique.value").alias("unique_value"))
    own = F.call_function("get_json_object", F.col("doc"), F.concat(F.lit("$."), F.col("unique_field")))
    wrong = (F.col("entity") != "Stock") & ~own.eqNullSafe(F.col("unique_value"))
    return docs.withColumn("doc", F.when(wrong, F.raise_error(F.lit("unique value differs from its document"))).otherwise(F.col("doc")))


def policy(spark: SparkSession, path: str, defaults: dict[str, int]) -> dict[str, dict[str, int]]:
    """region -> settings; a bad value rejects the whole document. Small by nature: one entry per region."""
    import json

    text = "\n".join(r.value for r in spark.read.text(path).collect())
    document = json.loads(text)
    out = {"default": defaults | document.get("default", {})}
    for region, own in document.get("regions", {}).items():
        if not (region[:2] in ("P|", "U|", "R|") and len(region) > 2):
            raise ValueError(f"bad region {region!r}")
        out[region] = out["default"] | own
    for own in out.values():
        if any(not isinstance(v, (int, bool)) or v < 0 for v in own.values()):
            raise ValueError("bad policy value")
    return out


def run_records(spark: SparkSession, pattern: str, schema: T.StructType) -> DataFrame:
    """Run records with the block and rung that their paths name: .../block-B/rung-R/run-*.json."""
    rows = spark.read.schema(schema).option("multiLine", True).json(pattern)
    at = F.input_file_name()
    return rows.select(F.regexp_extract(at, r"block-(\d+)", 1).cast("int").alias("block"), F.regexp_extract(at, r"rung-(\d+)", 1).cast("int").alias("rung"), "*")


def canonical_json(df: DataFrame, path: str) -> None:
    """Lines of JSON with keys in sorted order and no spaces."""
    df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value")).write.text(path)
