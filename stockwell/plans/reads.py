"""Queries over versioned documents: scans, lookups, tiers, tiles, top-k, set operations, scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stockwell.functions import scalars
from stockwell.operators import versions
from stockwell.operators.joins import exclusive, limit_per_parent
from stockwell.plans.registry import Registry
from stockwell.sources.tables import change_log, movements, order_lines, table, with_images

_r = Registry()
QUERIES, ORACLES = _r.queries, _r.oracles
query = _r.query

_LATEST = """live AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY handle ORDER BY csn DESC) AS n FROM log) WHERE n = 1 AND NOT deleted)"""


@query(with_images("log", sql=f"{_LATEST} SELECT handle, csn, event_type, value FROM live"))
def latest_entity_scan(spark, sf_dir):
    return versions.latest(change_log(spark, sf_dir)).select("handle", "csn", "event_type", "value")


@query(with_images("log", sql="SELECT handle, csn, deleted FROM log"))
def all_versions_scan(spark, sf_dir):
    return change_log(spark, sf_dir).select("handle", "csn", "deleted")


@query("SELECT c_custkey, c_name FROM customer WHERE c_name >= 'Customer#00000001' AND c_name < 'Customer#00000002'")
def prefix_scan(spark, sf_dir):
    # A prefix as the range up to its successor: both bounds reach the Parquet statistics.
    name = F.col("c_name")
    return table(spark, sf_dir, "customer").where((name >= "Customer#00000001") & (name < "Customer#00000002")).select("c_custkey", "c_name")


@query(with_images("log", sql=f"{_LATEST} SELECT handle, csn, value FROM live WHERE handle = 11"))
def point_get(spark, sf_dir):
    return versions.point_get(change_log(spark, sf_dir), 11).select("handle", "csn", "value")


@query("SELECT c_custkey, c_nationkey::BIGINT AS nation FROM customer WHERE c_name = 'Customer#000000042'")
def unique_lookup(spark, sf_dir):
    found = table(spark, sf_dir, "customer").where(F.col("c_name") == "Customer#000000042")
    return versions.single(found.select("c_custkey", F.col("c_nationkey").cast("long").alias("nation")), "two live owners of one unique value")


@query("SELECT o_orderkey FROM orders WHERE o_custkey = 42 ORDER BY 1")
def reverse_lookup(spark, sf_dir):
    return versions.reverse(table(spark, sf_dir, "orders"), "o_custkey", 42, "o_orderkey")


@query(with_images("log", sql="SELECT handle, max(csn) AS csn, arg_max(deleted, csn) AS deleted FROM log WHERE csn > 5000 GROUP BY handle"))
def incremental_scan(spark, sf_dir):
    return versions.incremental(change_log(spark, sf_dir), 5000).select("handle", "csn", "deleted")


@query(with_images("log", sql=f"{_LATEST} SELECT event_type AS entity, count(*) AS live, sum(strlen(event_type) + 8)::BIGINT AS bytes FROM live GROUP BY 1"))
def scan_volume(spark, sf_dir):
    live = versions.latest(change_log(spark, sf_dir))
    return live.groupBy(F.col("event_type").alias("entity")).agg(F.count(F.lit(1)).alias("live"), F.sum(F.octet_length("event_type") + 8).cast("long").alias("bytes"))


@query(with_images("log", sql=f"{_LATEST} SELECT handle, csn FROM live"))
def merged_tiers(spark, sf_dir):
    log = change_log(spark, sf_dir)
    tiles = [versions.publish(log, lo, hi) for lo, hi in ((-1, 2000), (2000, 6000))]
    return versions.compact([*tiles, log.where("csn > 6000")]).where("not deleted").select("handle", "csn")


@query(with_images("log", sql="SELECT handle, max(csn) AS csn, arg_max(deleted, csn) AS deleted FROM log WHERE csn > 1000 AND csn <= 6000 GROUP BY handle"))
def tile_publish(spark, sf_dir):
    return versions.publish(change_log(spark, sf_dir), 1000, 6000).select("handle", "csn", "deleted")


@query(with_images("log", sql="""
base AS (SELECT handle, max(csn) AS csn, arg_max(event_type, csn) AS event_type FROM log WHERE csn <= 5000 GROUP BY handle),
newer AS (SELECT handle, max(csn) AS csn, arg_max(event_type, csn) AS event_type, arg_max(deleted, csn) AS deleted FROM log WHERE csn > 5000 GROUP BY handle)
SELECT handle, csn, event_type FROM base WHERE handle NOT IN (SELECT handle FROM newer)
  UNION ALL SELECT handle, csn, event_type FROM newer WHERE NOT deleted"""))
def index_overlay(spark, sf_dir):
    log = change_log(spark, sf_dir)
    merged = versions.overlay(versions.newest(log.where("csn <= 5000"), ["handle"]), log.where("csn > 5000"))
    return merged.select("handle", "csn", "event_type")


@query(with_images("lines", "movements", sql="SELECT order_no, line_no, sku, loc, delta, day FROM movements ORDER BY order_no, line_no, sku, loc, delta, day LIMIT 100"))
def top_movements(spark, sf_dir):
    by = ["order_no", "line_no", "sku", "loc", "delta", "day"]
    return movements(spark, sf_dir).select(*by).orderBy(*by).limit(100)


@query(with_images("lines", sql="SELECT order_no, line_no, sku, qty FROM (SELECT *, row_number() OVER (PARTITION BY order_no ORDER BY line_no, sku, loc, qty, day) AS n FROM lines) WHERE n <= 2"))
def first_lines_per_order(spark, sf_dir):
    rows = limit_per_parent(order_lines(spark, sf_dir), ["order_no"], ["line_no", "sku", "loc", "qty", "day"], 2)
    return rows.select("order_no", "line_no", "sku", "qty")


@query("""SELECT 'both' AS side, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'either', count(*) FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'first only', count(*) FROM (SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier)""")
def key_sets(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    sets = {"both": a.intersect(b), "either": a.union(b).distinct(), "first only": a.distinct().join(b, "k", "left_anti")}
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(side).alias("side"), "n") for side, df in sets.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""SELECT k AS order_no, count(*) AS n FROM (SELECT o_orderkey AS k FROM orders UNION ALL SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R') GROUP BY k HAVING count(*) <> 1""")
def exclusivity(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_no"))
    returned = order_lines(spark, sf_dir).where("returned").select("order_no").distinct()
    return exclusive(orders, returned, "order_no")


@query("""SELECT c_custkey, 'c' || lpad(c_custkey::VARCHAR, 6, '0') || '@example.com' AS email, c_custkey AS number,
 'P|' || c_mktsegment AS region, strlen(c_name)::VARCHAR || ':' || c_name || ':' AS prefixed, '["' || c_custkey || '","' || c_nationkey || '"]' AS json_key,
 greatest(0, c_nationkey - 10)::BIGINT AS saturated FROM customer""")
def scalar_names(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    email = F.concat(scalars.padded("c", key, 6), F.lit("@example.com"))
    return c.select(
        "c_custkey", email.alias("email"), scalars.number_of(scalars.padded("S", key, 6)).alias("number"), scalars.region(F.lit("P"), F.col("c_mktsegment")).alias("region"),
        scalars.length_prefixed(F.col("c_name")).alias("prefixed"), scalars.json_key(key, F.col("c_nationkey")).alias("json_key"), scalars.saturating_sub(F.col("c_nationkey"), F.lit(10)).cast("long").alias("saturated"))


@query("""WITH s AS (SELECT c_custkey, (c_custkey::HUGEINT + 3 * 11400714819323198485::HUGEINT) % 18446744073709551616::HUGEINT AS z FROM customer),
a AS (SELECT c_custkey, xor(z::UBIGINT, (z::UBIGINT >> 30)) AS x FROM s),
m AS (SELECT c_custkey, x, (x & 4294967295)::HUGEINT AS lo, (x >> 32)::HUGEINT AS hi FROM a),
b AS (SELECT c_custkey, ((lo * 13787848793156543929::HUGEINT) % 18446744073709551616::HUGEINT + ((hi * (13787848793156543929::HUGEINT % 4294967296)) % 4294967296) * 4294967296::HUGEINT) % 18446744073709551616::HUGEINT AS z FROM m),
c AS (SELECT c_custkey, xor(z::UBIGINT, (z::UBIGINT >> 27)) AS x FROM b),
d AS (SELECT c_custkey, (x & 4294967295)::HUGEINT AS lo, (x >> 32)::HUGEINT AS hi FROM c),
e AS (SELECT c_custkey, ((lo * 10723151780598845931::HUGEINT) % 18446744073709551616::HUGEINT + ((hi * (10723151780598845931::HUGEINT % 4294967296)) % 4294967296) * 4294967296::HUGEINT) % 18446744073709551616::HUGEINT AS z FROM d)
SELECT c_custkey, xor(z::UBIGINT, (z::UBIGINT >> 31))::VARCHAR AS draw FROM e""")
def split_mix_draws(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", scalars.split_mix(F.col("c_custkey"), F.lit(3)).cast("string").alias("draw"))


@query("""SELECT p_partkey, CASE WHEN p_size <= 0 THEN 1.0 ELSE round(pow(0.5, greatest(1.0, round(p_size * ln(2)))), 12) END::DOUBLE AS fpr,
 round(CASE WHEN p_retailprice < 1000 THEN 0.05 * (p_retailprice / 1000) ELSE 0.05 + 0.95 * (1 / (1 + exp(-(p_retailprice - 1000) / 500.0)) - 0.5) / 0.5 END, 9)::DOUBLE AS penalty,
 round(CASE WHEN p_size <= 4 THEN 89.0 WHEN p_size <= 16 THEN 89.0 + ln(p_size / 4.0) / ln(4.0) * 25.0 WHEN p_size <= 64 THEN 114.0 + ln(p_size / 16.0) / ln(4.0) * 60.0 ELSE 174.0 END, 9)::DOUBLE AS read_us FROM part""")
def cost_functions(spark, sf_dir):
    size, price = F.col("p_size"), F.col("p_retailprice")
    read = scalars.log_linear(size, [(4.0, 89.0), (16.0, 114.0), (64.0, 174.0)])
    return table(spark, sf_dir, "part").select("p_partkey", F.round(scalars.false_positive_rate(size), 12).alias("fpr"), F.round(scalars.penalty(price, F.lit(1000.0)), 9).alias("penalty"), F.round(read, 9).alias("read_us"))


@query(with_images("log", sql="SELECT event_type AS family, count(*) AS entries, round(count(*) * 1.0 / sum(count(*)) OVER (), 12)::DOUBLE AS share FROM log GROUP BY 1"))
def family_shares(spark, sf_dir):
    by = change_log(spark, sf_dir).groupBy(F.col("event_type").alias("family")).agg(F.count(F.lit(1)).alias("entries"))
    return by.withColumn("share", F.round(F.col("entries") / F.sum("entries").over(Window.partitionBy()), 12))


@query("SELECT r_regionkey::BIGINT AS r, sha256(r_name) AS digest FROM region")
def content_digest(spark, sf_dir):
    return table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("r"), F.sha2("r_name", 256).alias("digest"))
