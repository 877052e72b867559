"""Queries of the join shapes and of the descriptors measured over them."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockwell.operators import joins, layout
from stockwell.operators.aggregates import ratio
from stockwell.plans.registry import Registry
from stockwell.plans.requests import compile_request
from stockwell.sources.tables import change_log, movements, order_lines, product_versions, table, with_images

_r = Registry()
QUERIES, ORACLES = _r.queries, _r.oracles
query = _r.query


@query(with_images("lines", "movements", sql="""
l AS (SELECT DISTINCT order_no, line_no, sku, loc FROM lines),
m AS (SELECT l.order_no, l.line_no, l.sku, l.loc, m.order_no AS m_order, m.delta, m.day,
        row_number() OVER (PARTITION BY l.order_no, l.line_no, l.sku, l.loc ORDER BY m.order_no, m.line_no, m.delta, m.day) AS n
      FROM l JOIN movements m ON m.sku = l.sku AND m.loc = l.loc AND m.day >= 300)
SELECT m.order_no, m.line_no, m.sku, m.loc, p_brand AS brand, s_name AS supplier, n_name AS nation, m_order, delta, day
FROM m JOIN part ON p_partkey = m.sku JOIN supplier ON s_suppkey = m.loc JOIN nation ON n_nationkey = s_nationkey WHERE n <= 128"""))
def star_fanout(spark, sf_dir):
    lines = order_lines(spark, sf_dir).select("order_no", "line_no", "sku", "loc").distinct()
    moves = movements(spark, sf_dir).where("day >= 300").select("sku", "loc", F.col("order_no").alias("m_order"), F.col("line_no").alias("m_line"), "delta", "day")
    met = joins.limit_per_parent(lines.join(moves, ["sku", "loc"]), ["order_no", "line_no", "sku", "loc"], ["m_order", "m_line", "delta", "day"], 128)
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("sku"), F.col("p_brand").alias("brand"))
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("loc"), F.col("s_name").alias("supplier"), "s_nationkey")
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("nation"))
    star = met.join(part, "sku").join(supplier, "loc").join(nation, "s_nationkey")
    return star.select("order_no", "line_no", "sku", "loc", "brand", "supplier", "nation", "m_order", "delta", "day")


@query(with_images("lines", sql="""
items AS (SELECT DISTINCT sku FROM lines WHERE loc = 7 AND day BETWEEN 100 AND 399),
found AS (SELECT l.sku, l.order_no, l.qty, l.returned FROM items JOIN lines l USING (sku))
SELECT f.sku, p_type AS category, count(*) AS lines, count(DISTINCT f.order_no) AS orders, count(DISTINCT o_custkey) AS buyers,
 sum(CASE WHEN f.returned THEN 1 ELSE 0 END)::BIGINT AS returns
FROM found f JOIN part ON p_partkey = f.sku JOIN orders ON o_orderkey = f.order_no JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2"""))
def multi_hop(spark, sf_dir):
    lines = order_lines(spark, sf_dir)
    items = lines.where("loc = 7 and day between 100 and 399").select("sku").distinct()
    found = lines.join(items, "sku", "left_semi").select("sku", "order_no", "returned")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("sku"), F.col("p_type").alias("category"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_no"), "o_custkey")
    buyers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"))
    rows = found.join(part, "sku").join(orders, "order_no").join(buyers, "o_custkey")
    return rows.groupBy("sku", "category").agg(F.count(F.lit(1)).alias("lines"), F.countDistinct("order_no").alias("orders"), F.countDistinct("o_custkey").alias("buyers"), F.sum(F.col("returned").cast("long")).alias("returns"))


@query(with_images("lines", "versions", sql="""SELECT l.order_no, l.line_no, l.sku, l.day, v.k, v.lead_time_days FROM lines l
JOIN versions v ON v.sku = l.sku AND v.valid_from <= l.day AND l.day < v.valid_to"""))
def as_of(spark, sf_dir):
    met = joins.as_of(order_lines(spark, sf_dir), product_versions(spark, sf_dir), "sku", "day", "valid_from", "valid_to")
    return met.select("order_no", "line_no", "sku", "day", "k", "lead_time_days")


@query(with_images("lines", "movements", sql="""SELECT DISTINCT sku FROM lines WHERE day = 400 AND sku NOT IN (SELECT sku FROM movements WHERE delta > 0 AND day BETWEEN 300 AND 500)"""))
def lost_sales(spark, sf_dir):
    demand = order_lines(spark, sf_dir).where("day = 400").select("sku").distinct()
    supply = movements(spark, sf_dir).where("delta > 0 and day between 300 and 500").select("sku")
    return joins.missing(demand, supply, ["sku"])


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def orders_without_lines(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.missing(table(spark, sf_dir, "orders").select("o_orderkey"), lines, ["o_orderkey"])


@query("""SELECT o_orderkey, coalesce(c.c_name, s.s_name) AS owner FROM orders
LEFT JOIN customer c ON c.c_custkey = o_custkey AND c.c_acctbal > 0 LEFT JOIN supplier s ON s.s_suppkey = o_custkey""")
def fallback_lookup(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    first = table(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey", F.col("c_name").alias("name"))
    other = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("name"))
    found = joins.first_match(orders, [(first, F.col("o_custkey") == F.col("c_custkey")), (other, F.col("o_custkey") == F.col("s_suppkey"))], "name", "owner")
    return found.select("o_orderkey", "owner")


@query("SELECT o_orderkey, c_custkey AS buyer, c_mktsegment AS segment FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'O'")
def resolve_buyers(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'")
    return orders.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_custkey").alias("buyer"), F.col("c_mktsegment").alias("segment"))


@query(with_images("lines", sql="""SELECT l.order_no, l.line_no, l.sku, l.qty FROM lines l LEFT JOIN orders o ON o.o_orderkey = l.order_no
LEFT JOIN part p ON p.p_partkey = l.sku WHERE o.o_orderkey IS NULL OR p.p_size < l.qty"""))
def mismatches(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    rows = order_lines(spark, sf_dir).join(o, F.col("order_no") == F.col("o_orderkey"), "left").join(p, F.col("sku") == F.col("p_partkey"), "left")
    return rows.where("o_orderkey is null or p_size < qty").select("order_no", "line_no", "sku", "qty")


@query(with_images("lines", sql="""per AS (SELECT o_orderkey, count(order_no) AS n FROM orders LEFT JOIN lines ON order_no = o_orderkey GROUP BY 1)
SELECT max(n) AS most, quantile_cont(n, 0.5)::DOUBLE AS median, sum(n)::BIGINT AS total, sum(CASE WHEN n = 0 THEN 1 ELSE 0 END)::BIGINT AS absent FROM per"""))
def fan_out_stats(spark, sf_dir):
    from stockwell.plans.requests import fan_out

    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_no"))
    return fan_out(orders, order_lines(spark, sf_dir).select("order_no"), "order_no")


@query(with_images("lines", sql="""g AS (SELECT order_no, bool_and(loc = first_loc) AS same FROM (SELECT order_no, loc, min(loc) OVER (PARTITION BY order_no) AS first_loc FROM lines) GROUP BY 1)
SELECT count(*) AS parents, sum(CASE WHEN same THEN 1 ELSE 0 END)::BIGINT AS colocated, round(sum(CASE WHEN same THEN 1 ELSE 0 END)::DOUBLE / count(*), 12)::DOUBLE AS ratio FROM g"""))
def colocation(spark, sf_dir):
    g = order_lines(spark, sf_dir).groupBy("order_no").agg((F.min("loc") == F.max("loc")).alias("same"))
    n = g.agg(F.count(F.lit(1)).alias("parents"), F.sum(F.col("same").cast("long")).alias("colocated"))
    return n.select("parents", "colocated", F.round(ratio(F.col("colocated"), F.col("parents"))["value"], 12).alias("ratio"))


@query(with_images("lines", sql="SELECT order_no, count(*) AS groups, count(DISTINCT sku) AS predicates, count(DISTINCT loc) AS regions FROM lines GROUP BY 1"))
def read_groups(spark, sf_dir):
    return order_lines(spark, sf_dir).groupBy("order_no").agg(F.count(F.lit(1)).alias("groups"), F.countDistinct("sku").alias("predicates"), F.countDistinct("loc").alias("regions"))


@query("""WITH line AS (SELECT * FROM lineitem WHERE l_orderkey = 100),
p AS (SELECT line.*, part.p_brand FROM line JOIN part ON p_partkey = l_partkey)
SELECT l_partkey AS sku, p_brand AS brand, s_name AS supplier FROM p JOIN supplier ON s_suppkey = l_suppkey""")
def request_dag(spark, sf_dir):
    names = {t: table(spark, sf_dir, t) for t in ("lineitem", "part", "supplier")}
    blocks = {
        "line": {"from": "lineitem", "where": {"l_orderkey": "$order_no"}},
        "product": {"from": "part", "where": {"p_partkey": "$line.l_partkey"}, "get": True},
        "supplier": {"from": "supplier", "where": {"s_suppkey": "$line.l_suppkey"}, "get": True, "order": ["s_suppkey"]},
    }
    out = compile_request(names, blocks, {"order_no": 100})
    rows = out["product"].distinct().join(out["supplier"], "line")
    return rows.select(F.col("line.l_partkey").alias("sku"), F.col("product.p_brand").alias("brand"), F.col("supplier.s_name").alias("supplier"))


@query(with_images("lines", sql="""
t AS (SELECT sku, floor((row_number() OVER (ORDER BY sku) - 1) / 64)::BIGINT AS tile FROM (SELECT DISTINCT sku FROM lines)),
r AS (SELECT l.order_no, t.tile, row_number() OVER (PARTITION BY l.order_no ORDER BY l.line_no, l.sku, l.loc, l.qty, l.day) AS n FROM lines l JOIN t USING (sku)),
m AS (SELECT order_no, tile, lag(tile) OVER (PARTITION BY order_no ORDER BY n) AS before FROM r)
SELECT order_no, sum(CASE WHEN before IS NULL OR before <> tile THEN 1 ELSE 0 END)::BIGINT AS reads FROM m GROUP BY 1"""))
def dependent_reads(spark, sf_dir):
    lines = order_lines(spark, sf_dir)
    tiles = layout.assign_tiles(lines.select("sku").distinct(), "sku", 64)
    order = F.struct("line_no", "sku", "loc", "qty", "day")
    reads = lines.join(tiles, "sku").withColumn("at", order)
    return layout.dependent_reads(reads, "order_no", "at", ["tile"])


@query(with_images("log", sql="SELECT handle, count(*) AS accesses FROM log GROUP BY 1"))
def access_counts(spark, sf_dir):
    return change_log(spark, sf_dir).groupBy("handle").agg(F.count(F.lit(1)).alias("accesses"))


@query("SELECT p_type AS category, n_name AS region, year(l_shipdate)::BIGINT AS year, month(l_shipdate)::BIGINT AS month, sum(l_quantity::BIGINT)::BIGINT AS demand FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY ALL")
def demand_by_month(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_shipdate", F.col("l_quantity").cast("long").alias("qty"))  # noqa: E741
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("category"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("n_nationkey"))
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("region"))
    rows = l.join(p, "l_partkey").join(s, "l_suppkey").join(n, "n_nationkey")
    return rows.groupBy("category", "region", F.year("l_shipdate").cast("long").alias("year"), F.month("l_shipdate").cast("long").alias("month")).agg(F.sum("qty").alias("demand"))
