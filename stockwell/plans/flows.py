"""Queries of the order flow: guarded stock, outcomes of requests, idempotence, uniqueness, invariants."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockwell.operators import flow, versions
from stockwell.plans.registry import Registry
from stockwell.sources.tables import movements, order_lines, table, with_images

_r = Registry()
QUERIES, ORACLES = _r.queries, _r.oracles
query = _r.query

INITIAL = 400
_ORDER = ["order_no", "line_no", "loc", "qty", "day"]
_FOLD = """list_reduce(list_prepend({{'left': {initial}::BIGINT, 'taken': 0::BIGINT, 'refused': 0::BIGINT, 'q': 0::BIGINT}},
  list({{'left': 0::BIGINT, 'taken': 0::BIGINT, 'refused': 0::BIGINT, 'q': qty}} ORDER BY {order})),
  lambda a, x: {{'left': CASE WHEN a.left >= x.q THEN a.left - x.q ELSE a.left END, 'taken': a.taken + CASE WHEN a.left >= x.q THEN 1 ELSE 0 END,
                'refused': a.refused + CASE WHEN a.left >= x.q THEN 0 ELSE 1 END, 'q': 0::BIGINT}})"""


@query(with_images("lines", sql=f"""f AS (SELECT sku, {_FOLD.format(initial=INITIAL, order=', '.join(_ORDER))} AS s FROM lines GROUP BY sku)
SELECT sku, s.taken AS taken, s.refused AS refused, s.left AS on_hand FROM f"""))
def guarded_stock(spark, sf_dir):
    return flow.guarded_fold(order_lines(spark, sf_dir), ["sku"], _ORDER, "qty", INITIAL)


def requests(lines):
    """The order lines as requests: one of ten buyers is unknown, and order numbers repeat over every third line."""
    rows = lines.select(*_ORDER, "sku").distinct()
    number = F.format_string("O%08d-%d", F.col("order_no"), (F.col("line_no") + F.col("sku")) % 3)
    key = F.concat_ws("|", *[F.lpad(F.col(c).cast("string"), 12, "0") for c in (*_ORDER, "sku")])
    return rows.select(key.alias("seq"), number.alias("order_no"), "sku", "qty", (F.col("order_no") % 10 != 3).alias("customer_known"))


def _outcomes(lines):
    return flow.outcomes(requests(lines), FLOW_INITIAL).select("seq", "order_no", "sku", "qty", "status")


_REQUESTS = """req AS (SELECT concat_ws('|', lpad(order_no::VARCHAR, 12, '0'), lpad(line_no::VARCHAR, 12, '0'), lpad(loc::VARCHAR, 12, '0'), lpad(qty::VARCHAR, 12, '0'), lpad(day::VARCHAR, 12, '0'), lpad(sku::VARCHAR, 12, '0')) AS seq,
 'O' || lpad(order_no::VARCHAR, 8, '0') || '-' || ((line_no + sku) % 3) AS order_no, sku, qty, order_no % 10 <> 3 AS customer_known
 FROM (SELECT DISTINCT order_no, line_no, loc, qty, day, sku FROM lines)),
firsts AS (SELECT order_no, min(seq) AS seq, true AS first FROM req WHERE customer_known GROUP BY order_no),
marked AS (SELECT r.*, CASE WHEN NOT customer_known THEN 'skipped' WHEN first IS NULL THEN 'rejected' END AS early FROM req r LEFT JOIN firsts f ON r.order_no = f.order_no AND r.seq = f.seq)"""
_WALK = """walk AS (SELECT sku, list(seq ORDER BY seq) AS seqs, list(qty ORDER BY seq) AS qtys FROM marked WHERE early IS NULL GROUP BY sku),
lefts AS (SELECT sku, seqs, qtys, list_reduce(list_prepend({'left': 100::BIGINT, 'q': 0::BIGINT, 'said': ['']}, list_transform(qtys, lambda q: {'left': 0::BIGINT, 'q': q, 'said': ['']})),
  lambda a, x: {'left': CASE WHEN a.left >= x.q THEN a.left - x.q ELSE a.left END, 'q': 0::BIGINT, 'said': list_append(a.said, CASE WHEN a.left >= x.q THEN 'ok' ELSE 'backorder' END)}) AS s FROM walk),
late AS (SELECT unnest(seqs) AS seq, unnest(s.said[2:]) AS status FROM lefts),
outcome AS (SELECT m.seq, m.order_no, m.sku, m.qty, coalesce(m.early, l.status) AS status FROM marked m LEFT JOIN late l ON m.seq = l.seq AND m.early IS NULL)"""
FLOW_INITIAL = 100


@query(with_images("lines", sql=f"{_REQUESTS},\n{_WALK}\nSELECT seq, order_no, sku, qty, status FROM outcome"))
def order_flow_outcomes(spark, sf_dir):
    return _outcomes(order_lines(spark, sf_dir))


@query(with_images("lines", sql=f"{_REQUESTS},\n{_WALK}\nSELECT status, count(*) AS requests, count(DISTINCT order_no) AS orders, sum(qty)::BIGINT AS qty FROM outcome GROUP BY 1"))
def order_flow_summary(spark, sf_dir):
    done = _outcomes(order_lines(spark, sf_dir))
    return done.groupBy("status").agg(F.count(F.lit(1)).alias("requests"), F.countDistinct("order_no").alias("orders"), F.sum("qty").alias("qty"))


_FULL = _REQUESTS.replace("order_no % 10 <> 3 AS customer_known", "order_no % 10 <> 3 OR order_no % 20 = 13 AS customer_known, CASE WHEN order_no % 10 <> 3 THEN 'find' WHEN order_no % 20 = 13 THEN 'else' END AS found").replace("THEN 'rejected' END", "THEN 'rejected' WHEN sku % 7 = 0 THEN 'backorder' END")


@query(with_images("lines", sql=f"""{_FULL},
{_WALK.replace("m.sku, m.qty, coalesce", "m.sku, m.qty, m.found, coalesce")},
every AS (SELECT seq, seq AS id, status, found, false AS again FROM outcome UNION ALL SELECT 'z' || seq, seq, status, found, true FROM outcome WHERE qty % 5 = 0)
SELECT seq, id, CASE WHEN again AND status IN ('ok', 'backorder') THEN 'skipped' WHEN status = 'skipped' THEN 'empty' ELSE found END AS cust, CASE status WHEN 'backorder' THEN 'failed' ELSE status END AS take,
 CASE WHEN status = 'backorder' THEN 'ok' END AS otherwise, CASE WHEN status IN ('ok', 'backorder') THEN id END AS commit FROM every"""))
def order_flow_blocks(spark, sf_dir):
    """Every case of the flow: a second customer lookup, missing stock, repeats of identical requests."""
    rows = requests(order_lines(spark, sf_dir))
    number = F.substring("seq", 1, 12).cast("long")
    found = F.when(number % 10 != 3, "find").when(number % 20 == 13, "else")
    stock = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("sku")).where("sku % 7 <> 0").withColumn("stocked", F.lit(True))
    rows = rows.withColumn("found", found).withColumn("customer_known", F.col("found").isNotNull()).join(stock, "sku", "left").fillna(False, ["stocked"])
    done = flow.outcomes(rows, FLOW_INITIAL).select("seq", "qty", "status", "found")
    again = done.where("qty % 5 = 0").select(F.concat(F.lit("z"), "seq").alias("seq"), F.col("seq").alias("id"))
    return flow.replayed(done.drop("qty"), again)


_RULES = """orders_ AS (SELECT order_no, sku, qty FROM outcome WHERE status = 'ok'), backorders_ AS (SELECT order_no, sku, qty FROM outcome WHERE status = 'backorder'),
moves_ AS (SELECT order_no, sku, -qty AS delta FROM orders_), stock_ AS (SELECT sku, s.left AS on_hand FROM lefts),
cells_ AS (SELECT s.sku, s.on_hand, coalesce(g.moved, 0) AS moved FROM stock_ s LEFT JOIN (SELECT sku, sum(delta) AS moved FROM moves_ GROUP BY 1) g ON g.sku = s.sku),
n_ AS (SELECT (SELECT count(*) FROM moves_) AS m, (SELECT count(*) FROM orders_) AS o, (SELECT count(*) FROM backorders_) AS b, (SELECT count(*) FROM outcome WHERE status = 'skipped') AS s,
  (SELECT count(*) FROM outcome WHERE status = 'rejected') AS r, (SELECT count(*) FROM req) AS q, (SELECT sum(delta) FROM moves_) AS d, (SELECT sum(qty) FROM orders_) AS t,
  (SELECT sum(on_hand) FROM stock_) AS h, (SELECT count(*) FROM stock_) AS c, (SELECT count(DISTINCT sku) FROM outcome WHERE status IN ('ok', 'backorder')) AS k)
SELECT 'on_hand_matches_movements' AS "check", count(*) AS violations FROM cells_ WHERE on_hand <> 100 + moved
UNION ALL SELECT 'on_hand_non_negative', count(*) FROM stock_ WHERE on_hand < 0
UNION ALL SELECT 'cell_count', abs(c - k) FROM n_
UNION ALL SELECT 'no_duplicate_order_no', count(*) FROM (SELECT order_no FROM (SELECT order_no FROM orders_ UNION ALL SELECT order_no FROM backorders_) GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'movement_count_is_committed_takes', abs(m - o) FROM n_
UNION ALL SELECT 'order_count_is_committed_takes', abs(o - (q - b - s - r)) FROM n_
UNION ALL SELECT 'backorder_count_is_committed_fallbacks', abs(b - (q - o - s - r)) FROM n_
UNION ALL SELECT 'every_order_flow_accounted', abs(q - (o + b + s + r)) FROM n_
UNION ALL SELECT 'no_skipped_take', s FROM n_
UNION ALL SELECT 'movement_deltas_match_order_lines', count(*) FROM moves_ m LEFT JOIN orders_ o ON o.order_no = m.order_no WHERE o.order_no IS NULL OR o.qty <> -m.delta OR o.sku <> m.sku
UNION ALL SELECT 'movement_delta_sum', abs(d + t)::BIGINT FROM n_
UNION ALL SELECT 'stock_decrements_match_orders', abs(h - (100 * c - t))::BIGINT FROM n_"""


@query(with_images("lines", sql=f"{_REQUESTS},\n{_WALK},\n{_RULES}"))
def flow_invariants(spark, sf_dir):
    asked = requests(order_lines(spark, sf_dir))
    done = flow.outcomes(asked, FLOW_INITIAL)
    orders = done.where("status = 'ok'").select("order_no", "sku", "qty")
    backorders = done.where("status = 'backorder'").select("order_no", "sku", "qty")
    # The stock by a fold of its own, not from what the outcomes say.
    live = done.where("status in ('ok', 'backorder')").select("sku", "seq", "qty")
    stock = flow.guarded_fold(live, ["sku"], ["seq"], "qty", FLOW_INITIAL).select("sku", "on_hand")
    moves = orders.select("order_no", "sku", (-F.col("qty")).alias("delta"))
    return flow.invariants(stock, moves, orders, backorders, done.groupBy("status").agg(F.count(F.lit(1)).alias("n")), asked, FLOW_INITIAL)


@query(with_images("lines", "movements", sql="""g AS (SELECT sku, loc, sum(delta)::BIGINT AS moved FROM movements GROUP BY ALL)
SELECT p_partkey AS sku, s_suppkey AS loc, coalesce(moved, 0) AS moved, coalesce(moved, 0) + 1000 AS on_hand FROM (SELECT p_partkey, p_partkey % 10 AS s_suppkey FROM part) LEFT JOIN g ON g.sku = p_partkey AND g.loc = s_suppkey"""))
def stock_reconcile(spark, sf_dir):
    stock = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("sku"), (F.col("p_partkey") % 10).alias("loc"))
    return flow.reconcile(stock, movements(spark, sf_dir), ["sku", "loc"], 1000).select("sku", "loc", "moved", "on_hand")


@query(with_images("lines", sql="""m AS (SELECT order_no AS block, row_number() OVER (PARTITION BY order_no ORDER BY line_no, sku, loc, qty, day) > 1 AS replay FROM lines)
SELECT block, count(*) AS submitted, count(*) FILTER (WHERE NOT replay) AS committed, count(*) FILTER (WHERE replay) AS replays FROM m GROUP BY 1"""))
def idempotent_blocks(spark, sf_dir):
    rows = order_lines(spark, sf_dir).withColumnRenamed("order_no", "block")
    marked = flow.committed_once(rows, "block", ["line_no", "sku", "loc", "qty", "day"])
    return marked.groupBy("block").agg(F.count(F.lit(1)).alias("submitted"), F.sum((~F.col("replay")).cast("long")).alias("committed"), F.sum(F.col("replay").cast("long")).alias("replays"))


@query(with_images("lines", sql="SELECT 'Order' AS entity, 'order_no' AS field, order_no::VARCHAR AS value, count(DISTINCT sku) AS owners FROM lines WHERE sku % 5 <> 0 GROUP BY order_no HAVING count(DISTINCT sku) > 1"))
def unique_conflicts(spark, sf_dir):
    rows = order_lines(spark, sf_dir).select(F.lit("Order").alias("entity"), F.lit("order_no").alias("field"), F.col("order_no").cast("string").alias("value"), F.col("sku").alias("owner"))
    # One block puts every row, then releases the owners divisible by 5.
    ops = rows.distinct().withColumn("seq", F.lit(1)).withColumn("deleted", F.lit(False))
    ops = ops.unionByName(ops.where("owner % 5 = 0").withColumn("seq", F.lit(2)).withColumn("deleted", F.lit(True)))
    return versions.net_conflicts(rows.limit(0), ops)


@query("SELECT l_orderkey AS order_no, count(*) AS n FROM (SELECT l_orderkey FROM lineitem WHERE l_quantity > 25 UNION ALL SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity <= 25) GROUP BY 1 HAVING count(*) > 1")
def duplicate_orders(spark, sf_dir):
    lines = order_lines(spark, sf_dir)
    both = lines.where("qty > 25").select("order_no").unionByName(lines.where("qty <= 25").select("order_no").distinct())
    return both.groupBy("order_no").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
