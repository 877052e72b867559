"""Queries of the cost analytics: layouts, placement, verdicts, floors, footprints, join descriptors."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stockwell.functions import scalars
from stockwell.operators import costmodel, layout
from stockwell.plans.registry import Registry
from stockwell.plans.requests import compile_request, descriptors
from stockwell.plans.telemetry import telemetry
from stockwell.sources.tables import order_lines, table, with_images

_r = Registry()
QUERIES, ORACLES = _r.queries, _r.oracles
query = _r.query

_TELEMETRY = "t AS (SELECT event_id, floor(epoch(ts) / 3600)::BIGINT AS \"at\", event_type AS region, user_id, value, round(value * 1000)::BIGINT AS ns FROM events)"
GAINS = [1.0, 1.1, 1.25]


def _service_sql(pattern: tuple, page: str, bits: str) -> str:
    _, _, dependent, parallel, size, probes, scans = pattern
    read = f"(CASE WHEN {page} <= 4096 THEN 96.3::DOUBLE WHEN {page} <= 16384 THEN 96.3 + ln({page} / 4096.0) / ln(4.0) * (117.4 - 96.3) WHEN {page} <= 65536 THEN 117.4 + ln({page} / 16384.0) / ln(4.0) * (185.8 - 117.4) ELSE 185.8 END)"
    out = f"{dependent} * {read} + {-(-parallel // 32)} * 4.9"
    if scans:
        out += f" + {size / (1024 * 1024)} / (831.0 * CASE WHEN {page} <= 4096 THEN 605.0 / 831.0 ELSE least(1.0, 605.0 / 831.0 * pow(gain, log2({page} / 4096.0))) END) * 1e6"
    if probes:
        out += f" + tiles * (0.15 + CASE WHEN {bits} <= 0 THEN 1.0 ELSE pow(0.5, greatest(1, round({bits} * ln(2)))) END * {read})"
    return f"({out})"


def _score_sql(page: str, bits: str) -> str:
    parts = []
    for p in costmodel.PATTERNS:
        x, slo = f"1.26 * {_service_sql(p, page, bits)}", f"(2.0 * 1.26 * {_service_sql(p, '4096', '10')})"
        parts.append(f"{p[1]} * (CASE WHEN {x} < {slo} THEN 0.05 * ({x} / {slo}) ELSE 0.05 + 0.95 * ((1.0 / (1.0 + exp(-({x} - {slo}) / ({slo} / 2.0)))) - 0.5) / 0.5 END)")
    return " + ".join(parts)


_LOADS = f"""{_TELEMETRY}, l AS (SELECT region, count(DISTINCT "at")::DOUBLE / 16 AS tiles FROM t GROUP BY 1), loads AS (SELECT region, tiles, gain FROM l, (VALUES (1.0::DOUBLE), (1.1), (1.25)) g(gain))"""


def _loads(spark, sf_dir):
    tiles = telemetry(spark, sf_dir).groupBy("region").agg((F.countDistinct("at") / 16.0).alias("tiles"))
    return tiles.withColumn("gain", F.explode(F.array(*[F.lit(g) for g in GAINS])))


@query(f"""WITH {_LOADS}, s AS (SELECT region, gain, page, bits, {_score_sql('page', 'bits')} AS score, {_score_sql('4096', '10')} AS base FROM loads, (VALUES (4096), (16384), (65536)) p(page), (VALUES (0), (10), (14)) b(bits))
SELECT region, gain, page, bits, round(score, 9)::DOUBLE AS score, round((base - score) / base * 100, 6)::DOUBLE AS gain_pct, row_number() OVER (PARTITION BY region, gain ORDER BY round(score, 9), page, bits) AS rank FROM s""")
def layout_headroom(spark, sf_dir):
    return costmodel.headroom(_loads(spark, sf_dir), ["region", "gain"], "tiles", "gain")


@query(f"""WITH {_LOADS}, s AS (SELECT region, gain, {_score_sql('4096', '10')} AS base, {_score_sql('4096', '14')} AS best FROM loads), a AS (SELECT *, 3.92 * (1 - share) AS amp FROM s, (VALUES (0.05::DOUBLE), (0.1), (0.2), (0.4)) x(share))
SELECT region, gain, share, round(amp, 9)::DOUBLE AS write_amp, round((base + 0.05 * 3.92 - best - 0.05 * amp) / (base + 0.05 * 3.92) * 100, 6)::DOUBLE AS gain_pct FROM a""")
def partition_breakeven(spark, sf_dir):
    return costmodel.breakeven(_loads(spark, sf_dir), ["region", "gain"], "tiles", "gain", 0.05, [0.05, 0.1, 0.2, 0.4])


_READS = """reads AS (SELECT order_no, line_no, loc, qty, day, sku, 1 AS step, 'U' AS marker, 'Order' AS entity, order_no AS k FROM lines
 UNION ALL SELECT order_no, line_no, loc, qty, day, sku, 2, 'U', 'Stock', sku FROM lines UNION ALL SELECT order_no, line_no, loc, qty, day, sku, 3, 'P', 'Stock', sku FROM lines),
counts AS (SELECT marker, entity, k, count(*) AS n FROM reads GROUP BY ALL),
keys AS (SELECT *, row_number() OVER (PARTITION BY marker, entity ORDER BY k) - 1 AS own, row_number() OVER (ORDER BY entity, k, marker) - 1 AS beside, row_number() OVER (ORDER BY n DESC, marker, entity, k) - 1 AS hot FROM counts),
tiles AS (SELECT marker, entity, k, p.placement, CASE p.placement WHEN 'today' THEN marker || entity || (own // 256) WHEN 'colocate' THEN (beside // 256)::VARCHAR ELSE (hot // 256)::VARCHAR END AS tile FROM keys, (VALUES ('today'), ('colocate'), ('freq')) p(placement)),
seen AS (SELECT t.placement, t.tile, lag(t.tile) OVER (PARTITION BY t.placement, r.order_no, r.line_no, r.loc, r.qty, r.day, r.sku ORDER BY r.step) AS before FROM reads r JOIN tiles t USING (marker, entity, k)),
totals AS (SELECT placement, sum(CASE WHEN before IS NULL OR before <> tile THEN 1 ELSE 0 END)::BIGINT AS reads FROM seen GROUP BY 1)"""


@query(with_images("lines", sql=f"""{_READS.replace('FROM lines', 'FROM dl')}
SELECT a.placement, a.reads, round((b.reads - a.reads) * 100.0 / b.reads, 9)::DOUBLE AS reduction_pct FROM totals a JOIN totals b ON b.placement = 'today'""".replace("reads AS (SELECT order_no", "dl AS (SELECT DISTINCT order_no, line_no, loc, qty, day, sku FROM lines), reads AS (SELECT order_no", 1)))
def placement_headroom(spark, sf_dir):
    request = ["order_no", "line_no", "loc", "qty", "day", "sku"]
    lines = order_lines(spark, sf_dir).select(*request).distinct()
    step = lambda n, marker, entity, key: F.struct(F.lit(n).alias("step"), F.lit(marker).alias("marker"), F.lit(entity).alias("entity"), F.col(key).alias("k"))
    reads = lines.select(*request, F.inline(F.array(step(1, "U", "Order", "order_no"), step(2, "U", "Stock", "sku"), step(3, "P", "Stock", "sku"))))
    counts = reads.groupBy("marker", "entity", "k").agg(F.count(F.lit(1)).alias("n"))
    part = F.floor(F.col("k") / 4096)
    keys = costmodel.ranked_keys(counts, ["k"], F.struct("marker", "entity", part.alias("p")), "at")
    first = keys.groupBy("marker", "entity").agg(F.min("at").alias("first"))
    keys = keys.join(F.broadcast(first), ["marker", "entity"]).withColumn("own", F.col("at") - F.col("first"))  # one row per region
    keys = costmodel.ranked_keys(keys, ["k", "marker"], F.struct("entity", part.alias("p")), "beside")
    keys = costmodel.ranked_keys(keys, ["k"], F.struct((-F.col("n")).alias("n"), "marker", "entity", part.alias("p")), "hot")
    tile = lambda at: F.floor(F.col(at) / 256).cast("string")
    placed = keys.select("marker", "entity", "k", F.concat("marker", "entity", tile("own")).alias("today"), tile("beside").alias("colocate"), tile("hot").alias("freq"))
    seen = reads.join(placed, ["marker", "entity", "k"])
    seen = seen.withColumn("request", F.struct(*request))
    totals = [layout.dependent_reads(seen, "request", "step", [p]).agg(F.sum("reads").alias("reads")).select(F.lit(p).alias("placement"), "reads") for p in ("today", "colocate", "freq")]
    totals = totals[0].unionByName(totals[1]).unionByName(totals[2])
    base = F.max(F.when(F.col("placement") == "today", F.col("reads"))).over(Window.partitionBy())  # three rows
    return totals.select("placement", "reads", F.round((base - F.col("reads")) * 100.0 / base, 9).alias("reduction_pct"))


@query(f"""WITH {_TELEMETRY}, r AS (SELECT region, count(*) AS n, avg(value) AS mean, sum(CASE WHEN user_id % 2 = 0 THEN ns ELSE 0 END)::BIGINT AS ingest, sum(CASE WHEN user_id % 2 = 1 AND value > 20 THEN ns ELSE 0 END)::BIGINT AS reorganised FROM t GROUP BY 1)
SELECT region, round(n * mean + 0.5 * (ingest + reorganised), 6) AS cost, round(n * mean, 6) AS service, round(0.5 * ingest / greatest(n * mean, 1.0), 9) AS ingest_ratio, round(0.5 * reorganised / greatest(n * mean, 1.0), 9) AS reorganised_ratio,
 CASE WHEN ingest > 0 THEN round(reorganised::DOUBLE / ingest, 9) END AS rewrite_factor, CASE WHEN ingest > 0 THEN round((ingest + reorganised)::DOUBLE / ingest, 9) END AS write_amp FROM r""")
def region_costs(spark, sf_dir):
    written = lambda ok: F.sum(F.when(ok, F.col("ns")).otherwise(0))
    r = telemetry(spark, sf_dir).groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), written(F.col("user_id") % 2 == 0).alias("ingest"), written((F.col("user_id") % 2 == 1) & (F.col("value") > 20)).alias("reorganised"))
    service, both = F.col("n") * F.col("mean"), F.col("ingest") + F.col("reorganised")
    term = lambda c: F.round(0.5 * F.col(c) / F.greatest(service, F.lit(1.0)), 9)
    factor = lambda x: F.when(F.col("ingest") > 0, F.round(x / F.col("ingest"), 9))
    return r.select("region", F.round(scalars.region_cost(F.col("n"), F.col("mean"), both, 0.5), 6).alias("cost"), F.round(service, 6).alias("service"), term("ingest").alias("ingest_ratio"), term("reorganised").alias("reorganised_ratio"), factor(F.col("reorganised")).alias("rewrite_factor"), factor(both).alias("write_amp"))


# Runs: arm = event type, rung = hour of the day / 6, block = user number / 5. A run is clean if its tail is below the ceiling.
_RUNS = f"""{_TELEMETRY}, runs AS (SELECT region AS arm, ("at" % 24) // 6 AS rung, user_id % 5 AS block, count(*) AS achieved, quantile_disc(value, 0.99) AS p99, max(value) <= 250 AS sustained FROM t GROUP BY ALL)"""


def _runs(spark, sf_dir):
    p99 = F.expr("percentile_disc(0.99) within group (order by value)")
    by = F.col("region").alias("arm"), F.floor((F.col("at") % 24) / 6).alias("rung"), (F.col("user_id") % 5).alias("block")
    return telemetry(spark, sf_dir).groupBy(*by).agg(F.count(F.lit(1)).alias("achieved"), p99.alias("p99"), (F.max("value") <= 250).alias("sustained"))


@query(f"""WITH {_RUNS}, f AS (SELECT min(p99) AS floor FROM runs WHERE arm = 'view'), a AS (SELECT arm, rung, quantile_cont(p99, 0.5) AS median, count(*) AS blocks FROM runs WHERE arm <> 'view' GROUP BY ALL)
SELECT a.arm, a.rung, blocks, round(median, 9) AS p99, floor, round(median / floor, 9) AS over_floor, round(median - floor, 9) AS above_floor, (SELECT count(*) FROM runs r WHERE r.arm = a.arm AND r.rung = a.rung AND r.p99 <= 50 + floor) AS clean_blocks FROM a, f""")
def floor_adjusted(spark, sf_dir):
    # The smallest reading of the idle arm is the floor: a larger one would flatter the others.
    runs = _runs(spark, sf_dir)
    floor = F.min(F.when(F.col("arm") == "view", F.col("p99"))).over(Window.partitionBy())  # one row per run
    rows = runs.withColumn("floor", floor).where("arm <> 'view'")
    a = rows.groupBy("arm", "rung").agg(F.count(F.lit(1)).alias("blocks"), F.percentile("p99", F.lit(0.5)).alias("median"), F.max("floor").alias("floor"), F.count_if(F.col("p99") <= 50 + F.col("floor")).alias("clean_blocks"))
    return a.select("arm", "rung", "blocks", F.round("median", 9).alias("p99"), "floor", F.round(F.col("median") / F.col("floor"), 9).alias("over_floor"), F.round(F.col("median") - F.col("floor"), 9).alias("above_floor"), "clean_blocks")


@query(f"""WITH {_RUNS}, d AS (SELECT p.rung, p.block, p.achieved, least(c.achieved, e.achieved) AS slower, p.sustained FROM runs p JOIN runs c ON c.arm = 'click' AND c.rung = p.rung AND c.block = p.block JOIN runs e ON e.arm = 'error' AND e.rung = p.rung AND e.block = p.block WHERE p.arm = 'purchase')
SELECT rung, count(*) AS blocks, round(quantile_cont(round(slower::DOUBLE / achieved, 4), 0.5), 9) AS deficit, count(*) FILTER (WHERE sustained) AS sustained,
 CASE WHEN quantile_cont(round(slower::DOUBLE / achieved, 4), 0.5) <= 1.5 AND count(*) FILTER (WHERE sustained) >= greatest(1, count(*) - 1) THEN 'PASS' ELSE 'FAIL' END AS verdict FROM d GROUP BY 1""")
def acceptance_verdicts(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    arm = lambda name, out: runs.where(F.col("arm") == name).select("rung", "block", F.col("achieved").alias(out))
    d = runs.where("arm = 'purchase'").join(arm("click", "c"), ["rung", "block"]).join(arm("error", "e"), ["rung", "block"])
    d = d.withColumn("deficit", F.round(scalars.deficit(F.least("c", "e"), F.col("achieved")), 4))
    v = d.groupBy("rung").agg(F.count(F.lit(1)).alias("blocks"), F.percentile("deficit", F.lit(0.5)).alias("deficit"), F.count_if("sustained").alias("sustained"))
    ok = (F.col("deficit") <= 1.5) & (F.col("sustained") >= F.greatest(F.lit(1), F.col("blocks") - 1))
    return v.select("rung", "blocks", F.round("deficit", 9).alias("deficit"), "sustained", F.when(ok, "PASS").otherwise("FAIL").alias("verdict"))


@query(f"""WITH {_RUNS}, s AS (SELECT arm, rung, bool_and(sustained) AS ok, sum(achieved)::DOUBLE AS achieved FROM runs GROUP BY ALL), top AS (SELECT max(rung) AS top FROM s),
b AS (SELECT arm, max(rung) FILTER (WHERE ok) AS best FROM s GROUP BY 1), pairs AS (SELECT a.arm AS declared, c.arm AS learned, a.best AS d, c.best AS l, top FROM b a JOIN b c ON a.arm <> c.arm, top),
common AS (SELECT p.declared, p.learned, max(x.rung) AS rung FROM pairs p JOIN s x ON x.arm = p.declared AND x.ok JOIN s y ON y.arm = p.learned AND y.ok AND y.rung = x.rung GROUP BY ALL),
g AS (SELECT p.*, (y.achieved - x.achieved) / x.achieved AS gain FROM pairs p LEFT JOIN common c USING (declared, learned) LEFT JOIN s x ON x.arm = p.declared AND x.rung = c.rung LEFT JOIN s y ON y.arm = p.learned AND y.rung = c.rung)
SELECT declared, learned, round(gain, 9) AS gain, CASE WHEN d IS NULL OR l IS NULL THEN 'NOT-MEASURABLE' WHEN d = top AND l = top THEN CASE WHEN gain > 0.15 THEN 'PASS' ELSE 'NOT-MEASURABLE' END
 WHEN l > d THEN 'PASS' WHEN gain > 0.15 THEN 'PASS' WHEN abs(gain) <= 0.02 THEN 'NOT-MEASURABLE' ELSE 'FAIL' END AS verdict FROM g""")
def win_verdicts(spark, sf_dir):
    """Does one arm sustain a higher level than another, or more at the highest common one? A tie at the top level decides nothing."""
    s = _runs(spark, sf_dir).groupBy("arm", "rung").agg(F.bool_and("sustained").alias("ok"), F.sum("achieved").cast("double").alias("achieved"))
    levels = F.map_from_entries(F.collect_list(F.when(F.col("ok"), F.struct("rung", "achieved"))))
    arms = s.groupBy("arm").agg(levels.alias("levels"), F.max("rung").alias("highest"))
    arms = arms.agg(F.collect_list(F.struct("arm", "levels")).alias("all"), F.max("highest").alias("top"))  # as many as there are arms
    both = arms.select("top", "all", F.explode("all").alias("a")).select("top", "a", F.explode("all").alias("b"))
    both = both.select("top", F.col("a.arm").alias("declared"), F.col("a.levels").alias("x"), F.col("b.arm").alias("learned"), F.col("b.levels").alias("y")).where("declared <> learned")
    d, l = F.array_max(F.map_keys("x")), F.array_max(F.map_keys("y"))  # noqa: E741
    common = F.array_max(F.array_intersect(F.map_keys("x"), F.map_keys("y")))
    both = both.withColumns({"d": d, "l": l, "before": F.element_at("x", common), "after": F.element_at("y", common)}).withColumn("gain", (F.col("after") - F.col("before")) / F.col("before"))
    more = F.col("gain") > 0.15
    tie = F.when(more, "PASS").otherwise("NOT-MEASURABLE")
    verdict = F.when(F.col("d").isNull() | F.col("l").isNull(), "NOT-MEASURABLE").when((F.col("d") == F.col("top")) & (F.col("l") == F.col("top")), tie)
    verdict = verdict.when((F.col("l") > F.col("d")) | more, "PASS").when(F.abs("gain") <= 0.02, "NOT-MEASURABLE").otherwise("FAIL")
    return both.select("declared", "learned", F.round("gain", 9).alias("gain"), verdict.alias("verdict"))


@query(f"""WITH {_RUNS}, p AS (SELECT a.rung, a.block, a.arm, a.achieved, b.achieved AS base FROM runs a JOIN runs b ON b.arm = 'view' AND b.rung = a.rung AND b.block = a.block)
SELECT arm, rung, block, achieved, base, round(achieved::DOUBLE / base, 9) AS ratio FROM p""")
def arm_records(spark, sf_dir):
    runs = _runs(spark, sf_dir).select("arm", "rung", "block", "achieved")
    base = runs.where("arm = 'view'").select("rung", "block", F.col("achieved").alias("base"))
    return runs.join(base, ["rung", "block"]).withColumn("ratio", F.round(F.col("achieved") / F.col("base"), 9)).select("arm", "rung", "block", "achieved", "base", "ratio")


@query(f"""WITH {_TELEMETRY} SELECT region AS machine, count(*) AS samples, round(quantile_cont(value, 0.5), 9) AS median, min(value) AS least, max(value) AS most, count(DISTINCT user_id % 3) AS states, CASE WHEN quantile_cont(ns, 0.5) = floor(quantile_cont(ns, 0.5)) THEN floor(quantile_cont(ns, 0.5))::BIGINT::VARCHAR ELSE quantile_cont(ns, 0.5)::VARCHAR END AS median_ns FROM t GROUP BY 1""")
def machine_states(spark, sf_dir):
    q = lambda c: F.percentile(c, F.lit(0.5))
    a = telemetry(spark, sf_dir).groupBy(F.col("region").alias("machine")).agg(F.count(F.lit(1)).alias("samples"), F.round(q("value"), 9).alias("median"), F.min("value").alias("least"), F.max("value").alias("most"), F.countDistinct(F.col("user_id") % 3).alias("states"), q("ns").alias("ns"))
    return a.withColumn("median_ns", scalars.whole_if_whole(F.col("ns"))).drop("ns")


@query("""WITH f AS (SELECT 'orders' AS arm, count(*) AS rows, sum(strlen(o_orderstatus) + strlen(o_orderpriority) + 24)::BIGINT AS bytes FROM orders UNION ALL SELECT 'customer', count(*), sum(strlen(c_name) + strlen(c_mktsegment) + 20)::BIGINT FROM customer)
SELECT arm, rows, bytes, round(bytes::DOUBLE / rows, 9) AS bytes_per_row, round(bytes::DOUBLE / 65536, 9) AS x_cap, bytes::DOUBLE / 65536 >= 10 AS meets_floor FROM f""")
def footprints(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    size = lambda df, name, x: df.agg(F.count(F.lit(1)).alias("rows"), F.sum(x).cast("long").alias("bytes")).withColumn("arm", F.lit(name))
    both = size(o, "orders", F.octet_length("o_orderstatus") + F.octet_length("o_orderpriority") + 24).unionByName(size(c, "customer", F.octet_length("c_name") + F.octet_length("c_mktsegment") + 20))
    cap = F.col("bytes") / 65536
    return both.select("arm", "rows", "bytes", F.round(F.col("bytes") / F.col("rows"), 9).alias("bytes_per_row"), F.round(cap, 9).alias("x_cap"), (cap >= 10).alias("meets_floor"))


#: Recall of a lot (a supplier's month): items -> products -> lines -> {orders -> buyers, returns}, and the check of both branches.
RECALL = {
    "items": {"from": "items", "where": {"lot": "$lot"}},
    "products": {"from": "part", "where": {"p_partkey": "$items.sku"}, "get": True, "order": ["p_partkey"]},
    "lines": {"from": "lines", "where": {"sku": "$products.p_partkey"}},
    "orders": {"from": "orders", "where": {"o_orderkey": "$lines.order_no"}, "get": True, "order": ["o_orderkey"]},
    "buyers": {"from": "customer", "where": {"c_custkey": "$orders.o_custkey"}, "get": True, "order": ["c_custkey"]},
    "returns": {"from": "returns", "where": {"order_no": "$lines.order_no"}},
    "same": {"from": "returns", "where": {"order_no": "$returns.order_no", "buyer": "$buyers.c_custkey"}},
}


def _recall_tables(spark, sf_dir):
    lines = order_lines(spark, sf_dir).select("order_no", "line_no", "sku", "loc", "qty", "day", "returned").distinct()
    lot = F.col("loc") * 1000 + F.floor(F.col("day") / 30)
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    returns = lines.where("returned").groupBy("order_no").agg(F.count(F.lit(1)).alias("n")).join(orders, F.col("order_no") == F.col("o_orderkey"))
    return {
        "items": lines.select(lot.alias("lot"), "sku").distinct(), "part": table(spark, sf_dir, "part").select("p_partkey", "p_brand"),
        "lines": lines.select("order_no", "line_no", "sku", "loc", "qty", "day"), "orders": orders, "customer": table(spark, sf_dir, "customer").select("c_custkey", "c_name"),
        "returns": returns.select("order_no", F.col("o_custkey").alias("buyer"), "n"),
    }


_RECALL_SQL = """dl AS (SELECT DISTINCT order_no, line_no, sku, loc, qty, day, returned FROM lines), items AS (SELECT DISTINCT loc * 1000 + day // 30 AS lot, sku FROM dl),
rt AS (SELECT order_no, o_custkey AS buyer, count(*) AS n FROM dl JOIN orders ON o_orderkey = order_no WHERE returned GROUP BY ALL),
i AS (SELECT sku FROM items WHERE lot = 7020), p AS (SELECT p_partkey FROM i JOIN part ON p_partkey = sku), l AS (SELECT d.order_no, d.line_no, d.sku, d.loc, d.qty, d.day FROM p JOIN dl d ON d.sku = p_partkey),
o AS (SELECT l.*, o_custkey FROM l JOIN orders ON o_orderkey = order_no), b AS (SELECT o.*, c_custkey FROM o JOIN customer ON c_custkey = o_custkey), r AS (SELECT l.*, rt.n FROM l JOIN rt USING (order_no))"""


@query(with_images("lines", sql=f"""{_RECALL_SQL}
SELECT l.sku, count(*) AS lines, count(DISTINCT l.order_no) AS orders, count(DISTINCT b.c_custkey) AS buyers, count(r.n) AS returns FROM l LEFT JOIN b USING (order_no, line_no, sku, loc, qty, day) LEFT JOIN r USING (order_no, line_no, sku, loc, qty, day) GROUP BY 1"""))
def lot_recall(spark, sf_dir):
    out = compile_request(_recall_tables(spark, sf_dir), RECALL, {"lot": 7020})
    buyers = out["buyers"].select("lines", F.col("buyers.c_custkey").alias("buyer"))
    returns = out["returns"].select("lines", F.col("returns.n").alias("n"))
    rows = out["lines"].select("lines").join(buyers, "lines", "left").join(returns, "lines", "left")
    return rows.groupBy(F.col("lines.sku").alias("sku")).agg(F.count(F.lit(1)).alias("lines"), F.countDistinct("lines.order_no").alias("orders"), F.countDistinct("buyer").alias("buyers"), F.count("n").alias("returns"))


@query(with_images("lines", sql=f"""{_RECALL_SQL}, pairs AS (SELECT r.order_no AS back, b.c_custkey AS buyer FROM r JOIN b USING (order_no, line_no, sku, loc, qty, day)),
cross_ AS (SELECT r.order_no AS back, b.c_custkey AS buyer FROM r, b)
SELECT count(*) AS n, count(DISTINCT c.back) AS orders FROM cross_ c JOIN rt ON rt.order_no = c.back AND rt.buyer = c.buyer"""))
def several_parents(spark, sf_dir):
    """A block with two parent blocks: rows of both cross, and its condition decides which pairs have rows."""
    out = compile_request(_recall_tables(spark, sf_dir), RECALL, {"lot": 7020})["same"]
    return out.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("same.order_no").alias("orders"))


_HOP = "SELECT '{b}' AS block, {d} AS depth, {parents} AS parents, quantile_cont(n, 0.5)::DOUBLE AS median, max(n) AS most, sum(n)::BIGINT AS rows, count(*) FILTER (WHERE n = 0) AS absent, round((count(*) FILTER (WHERE n = 0))::DOUBLE / count(*), 9) AS absent_share FROM ({per})"


@query(with_images("lines", sql=f"""{_RECALL_SQL}, ib AS (SELECT DISTINCT sku FROM i), q AS (
{_HOP.format(b='products', d=2, parents='count(*)', per='SELECT i.sku, count(p_partkey) AS n FROM i LEFT JOIN part ON p_partkey = i.sku GROUP BY 1')}
UNION ALL {_HOP.format(b='lines', d=3, parents='count(*)', per='SELECT p.p_partkey, count(d.order_no) AS n FROM p LEFT JOIN dl d ON d.sku = p.p_partkey GROUP BY 1')}
UNION ALL {_HOP.format(b='orders', d=4, parents='count(*)', per='SELECT l.order_no, l.line_no, l.sku, l.loc, l.qty, l.day, count(o_orderkey) AS n FROM l LEFT JOIN orders ON o_orderkey = l.order_no GROUP BY ALL')}
UNION ALL {_HOP.format(b='buyers', d=5, parents='count(*)', per='SELECT o.order_no, o.line_no, o.sku, o.loc, o.qty, o.day, count(c_custkey) AS n FROM o LEFT JOIN customer ON c_custkey = o.o_custkey GROUP BY ALL')}
UNION ALL {_HOP.format(b='returns', d=4, parents='count(*)', per='SELECT l.order_no, l.line_no, l.sku, l.loc, l.qty, l.day, count(rt.n) AS n FROM l LEFT JOIN rt ON rt.order_no = l.order_no GROUP BY ALL')})
SELECT block, depth::BIGINT AS depth, parents, median, most, rows, absent, absent_share, 6::BIGINT AS read_hops, 5::BIGINT AS dependent_hops FROM q"""))
def join_descriptors(spark, sf_dir):
    blocks = {name: b for name, b in RECALL.items() if name != "same"}
    return descriptors(compile_request(_recall_tables(spark, sf_dir), blocks, {"lot": 7020}), blocks)
