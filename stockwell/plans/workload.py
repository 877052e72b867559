"""Queries of the workload: generators, checks of requests, keys and tiles, and per-window state that follows from them."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stockwell.functions import scalars
from stockwell.operators import checks, generators, layout, sequences, versions
from stockwell.plans.registry import Registry
from stockwell.plans.telemetry import telemetry
from stockwell.sources.tables import change_log, order_lines, table, with_images

_r = Registry()
QUERIES, ORACLES = _r.queries, _r.oracles
query = _r.query

_TELEMETRY = "t AS (SELECT event_id, floor(epoch(ts) / 3600)::BIGINT AS \"at\", event_type AS region, user_id, value, round(value * 1000)::BIGINT AS ns FROM events)"


def _split_mix_sql(seed: str, nth: int, rows: str) -> str:
    """CTEs a..e over `rows` (a select with c_custkey), ending in `draws` (c_custkey, u): the nth SplitMix64 output from a seed, unsigned."""
    product = lambda m: f"((lo * {m}::HUGEINT) % 18446744073709551616::HUGEINT + ((hi * ({m}::HUGEINT % 4294967296)) % 4294967296) * 4294967296::HUGEINT) % 18446744073709551616::HUGEINT"
    return f"""s{nth} AS (SELECT c_custkey, ({seed}::HUGEINT + {nth} * {scalars.GAMMA}::HUGEINT) % 18446744073709551616::HUGEINT AS z FROM ({rows})),
a{nth} AS (SELECT c_custkey, xor(z::UBIGINT, (z::UBIGINT >> 30)) AS x FROM s{nth}), m{nth} AS (SELECT c_custkey, (x & 4294967295)::HUGEINT AS lo, (x >> 32)::HUGEINT AS hi FROM a{nth}),
b{nth} AS (SELECT c_custkey, {product(scalars.MIX1)} AS z FROM m{nth}), c{nth} AS (SELECT c_custkey, xor(z::UBIGINT, (z::UBIGINT >> 27)) AS x FROM b{nth}),
d{nth} AS (SELECT c_custkey, (x & 4294967295)::HUGEINT AS lo, (x >> 32)::HUGEINT AS hi FROM c{nth}), e{nth} AS (SELECT c_custkey, {product(scalars.MIX2)} AS z FROM d{nth}),
draws{nth} AS (SELECT c_custkey, xor(z::UBIGINT, (z::UBIGINT >> 31)) AS u FROM e{nth})"""


@query(f"""WITH w AS (SELECT row_number() OVER (ORDER BY p_partkey) AS rank FROM part),
z AS (SELECT rank, sum(greatest(1, 4294967296 // rank)) OVER (ORDER BY rank)::BIGINT AS cum, greatest(1, 4294967296 // rank)::BIGINT AS weight FROM w),
{_split_mix_sql('c_custkey', 1, 'SELECT c_custkey FROM customer')}, {_split_mix_sql('c_custkey', 2, 'SELECT c_custkey FROM customer')},
d AS (SELECT a.c_custkey, (a.u::HUGEINT % (SELECT max(cum) FROM z)::HUGEINT)::BIGINT AS u, (b.u % 100)::BIGINT AS v FROM draws1 a JOIN draws2 b USING (c_custkey))
SELECT c_custkey, rank, CASE WHEN v < 70 THEN 'order_flow' WHEN v < 85 THEN 'stock_lookup' WHEN v < 95 THEN 'customer_lookup' ELSE 'movements_scan' END AS shape
FROM d JOIN z ON d.u >= z.cum - z.weight AND d.u < z.cum""")
def zipf_requests(spark, sf_dir):
    weights = generators.zipf_weights(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey")
    draws = table(spark, sf_dir, "customer").select("c_custkey", scalars.split_mix(F.col("c_custkey"), F.lit(1)).alias("draw"), scalars.split_mix(F.col("c_custkey"), F.lit(2)).alias("kind"))
    drawn = generators.zipf_draws(draws, "draw", weights)
    return drawn.select("c_custkey", "rank", generators.mix_shape((F.col("kind") % 100).cast("int")).alias("shape"))


@query("""SELECT r_name AS tag, i AS index, '{"body":"' || md5(r_name || ':' || i) || '","id":"' || r_name || '-' || lpad(i::VARCHAR, 6, '0') || '"}' AS doc FROM region, range(0, 2000) t(i)""")
def synthetic_documents(spark, sf_dir):
    return generators.synthetic_documents(table(spark, sf_dir, "region").select(F.col("r_name").alias("tag")), 2000)


@query(with_images("log", sql="""n AS (SELECT handle, max(csn) AS csn, arg_max(deleted, csn) AS deleted, arg_max(event_type, csn) AS event_type FROM log WHERE csn > 4000 GROUP BY handle)
SELECT handle, csn, deleted, event_type FROM n"""))
def bounded_snapshot(spark, sf_dir):
    newest = versions.newest(change_log(spark, sf_dir).where("csn > 4000").select("handle", "csn", "deleted", "event_type"), ["handle"])
    return checks.within_bytes(newest, F.octet_length("event_type") + 17, 1 << 40)


#: Requests with one defect in some: an extra field, an expression as a text, an empty text, a wrong constant.
_BAD = {1: "extra", 2: "expression", 3: "empty", 4: "limit"}


def _request_json(order, customer):
    """A JSON line per order, of four shapes; by order number modulo 11 some have a defect."""
    bad = order % 11
    text = F.when(bad == 2, F.lit("$x")).when(bad == 3, F.lit("")).otherwise(F.concat(F.lit("v"), customer.cast("string")))
    number = F.concat(F.lit("r-"), F.lpad(order.cast("string"), 8, "0"))
    extra = F.when(bad == 1, F.lit(',"more":1')).otherwise(F.lit(""))
    limit = F.when(bad == 4, F.lit("99")).otherwise(F.lit("100"))
    stock = F.concat(F.lit('{"get":{"Stock":{"where":{"sku":"'), text, F.lit('","loc":"L1"}}}}'))
    person = F.concat(F.lit('{"find":{"Customer":{"email":"'), text, F.lit('"}}}'))
    moves = F.concat(F.lit('{"find":{"StockMovement":{"where":{"order_no":"'), text, F.lit('"}},"order":["movement_no"],"limit":'), limit, F.lit("}}"))
    flow = F.concat(F.lit('{"cust":{"find":{"Customer":{"email":"'), text, F.lit('"}}},"take":{"needs":["cust"],"ops":[],"else":[]}}'))
    shape = order % 4
    blocks = F.when(shape == 0, flow).otherwise(F.concat(F.lit('{"q":'), F.when(shape == 1, stock).when(shape == 2, person).otherwise(moves), F.lit("}")))
    return F.concat(F.lit('{"id":"'), number, F.lit('"'), extra, F.lit(',"class":{"durability":"batched"},"blocks":'), blocks, F.lit("}"))


@query("""WITH r AS (SELECT o_orderkey, o_orderkey % 11 AS bad, o_orderkey % 4 AS k FROM orders)
SELECT o_orderkey, CASE k WHEN 0 THEN 'order_flow' WHEN 1 THEN 'stock_lookup' WHEN 2 THEN 'customer_lookup' ELSE 'movements_scan' END AS shape,
 nullif(concat_ws('+', CASE WHEN bad = 1 THEN 'fields' END, CASE WHEN bad IN (2, 3) THEN 'text' END, CASE WHEN bad = 4 AND k = 3 THEN 'constant' END), '') AS rejected FROM r""")
def request_checks(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", _request_json(F.col("o_orderkey"), F.col("o_custkey")).alias("line"))
    return o.select("o_orderkey", checks.shape_of(F.col("line")).alias("shape"), checks.rejections(F.col("line")).alias("rejected"))


@query(with_images("log", sql="""k AS (SELECT handle, csn, event_type, 'P' || event_type || chr(0) || printf('%016x', handle) || printf('%016x', 9223372036854775807 - csn) AS k FROM log),
n AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY k) AS n FROM k) SELECT event_type, handle, csn, n FROM n WHERE n <= 200"""))
def key_order(spark, sf_dir):
    # Keys compare as unsigned bytes: entity, zero byte, big-endian handle, and the inverted version, so that the newest comes first.
    key = scalars.document_key(F.col("event_type"), F.col("handle"), F.col("csn"))
    w = Window.partitionBy("event_type").orderBy("k")
    rows = change_log(spark, sf_dir).select("event_type", "handle", "csn", key.alias("k"))
    return rows.withColumn("n", F.row_number().over(w).cast("long")).where("n <= 200").select("event_type", "handle", "csn", "n")


@query("""WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 9223372036854775807::HUGEINT - l_orderkey AS a, l_partkey::HUGEINT AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN a + b <= 9223372036854775807 THEN (a + b)::VARCHAR END AS added, CASE WHEN -a - b >= -9223372036854775808 THEN (-a - b)::VARCHAR END AS taken FROM v""")
def checked_arithmetic(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    a, b = F.lit(2**63 - 1) - F.col("l_orderkey"), F.col("l_partkey")
    return l.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.try_add(a, b).cast("string").alias("added"), F.try_subtract(-a, b).cast("string").alias("taken"))


@query("""WITH hint AS (SELECT c_name AS name, CASE WHEN c_custkey % 5 = 0 THEN c_custkey + 1 WHEN c_custkey % 7 = 0 THEN NULL ELSE c_custkey END AS handle FROM customer),
h AS (SELECT hint.name, d.c_custkey AS found FROM hint LEFT JOIN customer d ON d.c_custkey = hint.handle AND d.c_name = hint.name)
SELECT h.name, coalesce(h.found, c.c_custkey) AS handle, h.found IS NOT NULL AS by_hint FROM h JOIN customer c ON c.c_name = h.name""")
def hinted_lookup(spark, sf_dir):
    docs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("handle"), F.col("c_name").alias("name"))
    # An index that has fallen behind: some hints name another document, some are gone.
    hint = F.when(F.col("handle") % 5 == 0, F.col("handle") + 1).when(F.col("handle") % 7 == 0, None).otherwise(F.col("handle"))
    return checks.hinted(docs.select("name", hint.alias("hint")), docs, "name", "handle")


@query("""SELECT 'agreed' AS said, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey
UNION ALL SELECT 'dangling', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)""")
def index_agreement(spark, sf_dir):
    entries = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("handle"), F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("value"))
    docs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("handle"), F.col("c_name").alias("name"))
    said = checks.agreement(entries, docs, "handle", "value", "name").groupBy("said").agg(F.count(F.lit(1)).alias("n"))
    return spark.createDataFrame([("agreed",), ("dangling",)], "said string").join(said, "said", "left").fillna(0)


@query(f"""WITH {_TELEMETRY}, c AS (SELECT region, "at", max(event_id) AS cutoff, count(*) AS entries FROM t GROUP BY ALL)
SELECT region, "at", cutoff, lag(cutoff, 1, 0) OVER (PARTITION BY region ORDER BY cutoff)::BIGINT AS lower, entries FROM c""")
def tile_bounds(spark, sf_dir):
    tiles = telemetry(spark, sf_dir).groupBy("region", "at").agg(F.max("event_id").alias("cutoff"), F.count(F.lit(1)).alias("entries"))
    return tiles.select("region", "at", "cutoff", F.lag("cutoff", 1, 0).over(Window.partitionBy("region").orderBy("cutoff")).alias("lower"), "entries")


@query(f"""WITH {_TELEMETRY}, z AS (SELECT region, "at", sum(ns)::BIGINT AS size FROM t GROUP BY ALL) SELECT region, "at", size FROM z ORDER BY size DESC, region, "at" LIMIT 4""")
def largest_tiles(spark, sf_dir):
    tiles = telemetry(spark, sf_dir).groupBy("region", "at").agg(F.sum("ns").alias("size"))
    return tiles.orderBy(F.desc("size"), "region", "at").limit(4)


@query(f"""WITH {_TELEMETRY}, x AS (SELECT region AS a, user_id % 5 AS b FROM t), j AS (SELECT a, b, count(*)::DOUBLE AS n FROM x GROUP BY ALL),
m AS (SELECT *, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb, sum(n) OVER () AS t FROM j)
SELECT a, b, n::BIGINT AS n, round(n / t, 9) AS support, round(n / na, 9) AS confidence, round(n * t / (na * nb), 9) AS lift, round(n / t * log2(n * t / (na * nb)), 9) AS information FROM m""")
def field_associations(spark, sf_dir):
    x = telemetry(spark, sf_dir).select(F.col("region").alias("a"), (F.col("user_id") % 5).alias("b"))
    return checks.associations(x, "a", "b")


@query(f"""WITH {_TELEMETRY}, s AS (SELECT event_id, event_id // 2500 AS segment, region FROM t),
c AS (SELECT segment, region, count(*)::DOUBLE AS n FROM s GROUP BY ALL), w AS (SELECT segment, region, n * CASE WHEN segment % 2 = 1 AND region = 'purchase' THEN 3 ELSE 1 END AS weight FROM c)
SELECT segment, region, round(weight / sum(weight) OVER (PARTITION BY segment), 9) AS share, CASE WHEN segment % 2 = 0 THEN 200.0 ELSE 400.0 END::DOUBLE AS rate FROM w""")
def drifting_segments(spark, sf_dir):
    rows = telemetry(spark, sf_dir).select("event_id", "region")
    plan = generators.segments(rows, "event_id", 2500, [200.0, 400.0])
    return generators.drifted_shares(plan, "region", "purchase", 3)


@query(f"""WITH {_TELEMETRY}, w AS (SELECT "at", quantile_disc(value, 0.99) > 40 OR count(*) FILTER (WHERE value > 45) > 0 AS late FROM t GROUP BY 1),
r AS (SELECT *, sum(CASE WHEN late THEN 0 ELSE 1 END) OVER (ORDER BY "at") AS run FROM w),
k AS (SELECT "at", late, CASE WHEN late THEN row_number() OVER (PARTITION BY run, late ORDER BY "at") ELSE 0 END AS streak FROM r) SELECT "at", late, streak, streak >= 3 AS saturated FROM k""")
def lag_saturation(spark, sf_dir):
    p99 = F.expr("percentile_disc(0.99) within group (order by value)")
    w = telemetry(spark, sf_dir).groupBy("at").agg(((p99 > 40) | (F.count_if(F.col("value") > 45) > 0)).alias("late"))
    return layout.saturation(w, [], "at", F.col("late"), 3).select("at", "late", "streak", "saturated")


@query(f"""WITH {_TELEMETRY}, w AS (SELECT region, "at", count(*) FILTER (WHERE value > 120) AS scans FROM t GROUP BY ALL), f AS (SELECT region, min("at") AS first FROM w WHERE scans > 0 GROUP BY 1)
SELECT w.region, w."at", scans, w."at" >= f.first AND f.first IS NOT NULL AS indexed, coalesce(w."at" = f.first, false) AS flipped FROM w LEFT JOIN f USING (region)""")
def sticky_index(spark, sf_dir):
    w = telemetry(spark, sf_dir).groupBy("region", "at").agg(F.count_if(F.col("value") > 120).alias("scans"))
    so_far = Window.partitionBy("region").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.sum(F.when(F.col("scans") > 0, 1).otherwise(0)).over(so_far)
    return w.select("region", "at", "scans", (seen > 0).alias("indexed"), ((seen == 1) & (F.col("scans") > 0)).alias("flipped"))


@query()
def index_upkeep(spark, sf_dir):
    w = telemetry(spark, sf_dir).groupBy("region", F.col("at").alias("window")).agg(F.max("event_id").alias("csn"), F.count_if(F.col("value") > 120).alias("scans"), F.count(F.lit(1)).alias("changes"))
    return sequences.index_upkeep(w)


@query()
def ready_groups(spark, sf_dir):
    rows = telemetry(spark, sf_dir).select((F.col("user_id") % 16).alias("server"), F.col("event_id").alias("seq"), (F.col("event_id") * 5000.0).alias("due_us"), F.when(F.col("event_id") % 5000 < 2500, 200.0).otherwise(400.0).alias("rate"))
    return sequences.ready_groups(rows, ["server"], 8, 160_000)


@query()
def crc32c_digests(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", scalars.crc32c(F.col("c_name")).alias("crc"))


@query(with_images("lines", sql="""SELECT 'o' || order_no AS request, count(*) AS docs, sum(strlen(order_no::VARCHAR) + strlen(sku::VARCHAR))::BIGINT AS bytes FROM lines WHERE qty > 0 GROUP BY order_no"""))
def put_documents(spark, sf_dir):
    docs = order_lines(spark, sf_dir).select(F.concat(F.lit("o"), F.col("order_no").cast("string")).alias("request"), F.concat(F.col("order_no").cast("string"), F.col("sku").cast("string")).alias("doc"), "qty")
    return checks.puts(docs.where("qty > 0"), "doc").groupBy("request").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.octet_length("doc")).cast("long").alias("bytes"))
