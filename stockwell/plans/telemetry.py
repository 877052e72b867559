"""Queries of windowed telemetry: `events` by time, region = event type, latency = value."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stockwell.operators import aggregates, layout, quantiles, sequences
from stockwell.plans.registry import Registry
from stockwell.sources.tables import table
from stockwell.streaming import bandit, windows

_r = Registry()
QUERIES, ORACLES = _r.queries, _r.oracles
query = _r.query

HOUR = 3600


def telemetry(spark, sf_dir):
    """event_id, at (hour number from the epoch), region, user_id, value, ns."""
    e = table(spark, sf_dir, "events")
    hour = F.floor(F.unix_timestamp("ts") / HOUR).cast("long")
    return e.select("event_id", "ts", hour.alias("at"), F.col("event_type").alias("region"), "user_id", "value", F.round(F.col("value") * 1000).cast("long").alias("ns"))


_T = "t AS (SELECT event_id, ts, floor(epoch(ts) / 3600)::BIGINT AS \"at\", event_type AS region, user_id, value, round(value * 1000)::BIGINT AS ns FROM events)"


@query(f"WITH {_T} SELECT region, count(*) AS probes, sum(CASE WHEN value < 10 THEN 1 ELSE 0 END)::BIGINT AS misses, sum(ns)::BIGINT AS bytes, round(avg(value), 9) AS mean FROM t GROUP BY 1")
def region_rollup(spark, sf_dir):
    return telemetry(spark, sf_dir).groupBy("region").agg(F.count(F.lit(1)).alias("probes"), F.sum(F.when(F.col("value") < 10, 1).otherwise(0)).cast("long").alias("misses"), F.sum("ns").alias("bytes"), F.round(F.avg("value"), 9).alias("mean"))


_BOUNDS = "[" + ", ".join(map(str, aggregates.bucket_bounds())) + "]"
_HIST = f"h AS (SELECT region, len(list_filter({_BOUNDS}, lambda b: b <= ns)) - 1 AS bucket, count(*) AS n FROM t GROUP BY ALL)"


@query(f"WITH {_T}, {_HIST} SELECT region, bucket::BIGINT AS bucket, n FROM h")
def latency_histogram(spark, sf_dir):
    return aggregates.histogram(telemetry(spark, sf_dir), ["region"], "ns")


@query(f"""WITH {_T}, {_HIST},
c AS (SELECT *, sum(n) OVER (PARTITION BY region ORDER BY bucket) AS cum, greatest(1, ceil(0.99 * sum(n) OVER (PARTITION BY region))) AS rank FROM h),
f AS (SELECT region, bucket, (rank - (cum - n))::DOUBLE / n AS share FROM c WHERE cum >= rank AND cum - n < rank)
SELECT region, round(CASE WHEN bucket = 0 THEN share * 100.0 ELSE ({_BOUNDS}::DOUBLE[])[bucket + 1] * pow(1.15, share) END, 6)::DOUBLE AS p99 FROM f""")
def histogram_p99(spark, sf_dir):
    hist = aggregates.histogram(telemetry(spark, sf_dir), ["region"], "ns")
    return aggregates.histogram_quantile(hist, ["region"], 0.99, "p99").withColumn("p99", F.round("p99", 6))


@query(f"""WITH {_T}, f AS (SELECT user_id, min(event_id) AS first FROM t GROUP BY 1 ORDER BY first, user_id::VARCHAR LIMIT 20)
SELECT CASE WHEN f.user_id IS NULL THEN 'other' ELSE t.user_id::VARCHAR END AS pattern, count(*) AS n, sum(ns)::BIGINT AS ns FROM t LEFT JOIN f ON f.user_id = t.user_id GROUP BY 1""")
def cap_and_fold(spark, sf_dir):
    rows = telemetry(spark, sf_dir).withColumn("pattern", F.col("user_id").cast("string"))
    return aggregates.cap_and_fold(rows, "pattern", "event_id", 20, [F.count(F.lit(1)).alias("n"), F.sum("ns").alias("ns")])


@query(f"WITH {_T} SELECT region, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM t GROUP BY 1")
def nearest_rank(spark, sf_dir):
    return quantiles.exact(telemetry(spark, sf_dir), ["region"], "value", nearest={"p50": 0.5, "p95": 0.95, "p99": 0.99})


@query(f"""WITH {_T} SELECT region, user_id % 5 AS rung, round(quantile_cont(value, 0.5), 9) AS median, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 9) AS iqr,
 array_to_string(list_sort(list(DISTINCT user_id % 7)), ',') AS kinds FROM t GROUP BY ALL""")
def arm_quartiles(spark, sf_dir):
    rows = telemetry(spark, sf_dir).withColumn("rung", F.col("user_id") % 5)
    q = quantiles.exact(rows, ["region", "rung"], "value", linear={"median": 0.5, "q1": 0.25, "q3": 0.75})
    kinds = rows.groupBy("region", "rung").agg(F.array_join(F.array_sort(F.collect_set(F.col("user_id") % 7)), ",").alias("kinds"))
    return q.join(kinds, ["region", "rung"]).select("region", "rung", F.round("median", 9).alias("median"), F.round(F.col("q3") - F.col("q1"), 9).alias("iqr"), "kinds")


_W = "w AS (SELECT \"at\", count(*) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.99) AS p99, max(value) > 250 AS bad, floor(count(*) / 4)::BIGINT AS rung FROM t GROUP BY 1)"


def _windows(spark, sf_dir):
    p = lambda q: F.expr(f"percentile_disc({q}) within group (order by value)")
    w = telemetry(spark, sf_dir).groupBy("at").agg(F.count(F.lit(1)).alias("n"), p(0.5).alias("p50"), p(0.99).alias("p99"), (F.max("value") > 250).alias("bad"))
    return w.withColumn("rung", F.floor(F.col("n") / 4).cast("long"))


@query(f"""WITH {_T}, {_W}, c AS (SELECT rung, count(*) AS windows, sum(n)::BIGINT AS requests, bool_and(bad) AS none_valid, sum(CASE WHEN bad THEN 1 ELSE 0 END)::BIGINT AS rejected,
 round(quantile_cont(p50, 0.5) FILTER (WHERE NOT bad), 9) AS v50, max(p99) FILTER (WHERE NOT bad) AS v99, round(quantile_cont(p50, 0.5), 9) AS a50, max(p99) AS a99 FROM w GROUP BY 1)
SELECT rung, windows, requests, rejected, CASE WHEN none_valid THEN a50 ELSE v50 END AS p50, CASE WHEN none_valid THEN a99 ELSE v99 END AS p99, rejected = 0 AS sustained FROM c""")
def capacity_curve(spark, sf_dir):
    ok = ~F.col("bad")
    c = _windows(spark, sf_dir).groupBy("rung").agg(
        F.count(F.lit(1)).alias("windows"), F.sum("n").alias("requests"), F.sum(F.col("bad").cast("long")).alias("rejected"),
        F.coalesce(F.percentile(F.when(ok, F.col("p50")), F.lit(0.5)), F.percentile("p50", F.lit(0.5))).alias("p50"), F.coalesce(F.max(F.when(ok, F.col("p99"))), F.max("p99")).alias("p99"))
    return c.select("rung", "windows", "requests", "rejected", F.round("p50", 9).alias("p50"), "p99", (F.col("rejected") == 0).alias("sustained"))


@query(f"""WITH {_T}, {_W}, s AS (SELECT rung, sum(CASE WHEN bad THEN 1 ELSE 0 END) * 4 <= count(*) AS ok FROM w WHERE "at" % 2 = 0 GROUP BY 1), r AS (SELECT rung, sum(CASE WHEN bad THEN 1 ELSE 0 END) * 4 <= count(*) AS ok FROM w WHERE "at" % 2 = 1 GROUP BY 1)
SELECT s.rung FROM s JOIN r USING (rung) WHERE s.ok AND r.ok""")
def common_levels(spark, sf_dir):
    w = _windows(spark, sf_dir)
    arm = lambda k: w.where(F.col("at") % 2 == k).groupBy("rung").agg((F.sum(F.col("bad").cast("long")) * 4 <= F.count(F.lit(1))).alias("ok")).where("ok").select("rung")
    return arm(0).intersect(arm(1))


@query(f"""WITH {_T}, c AS (SELECT region, user_id % 4 AS candidate, count(*) AS n, round(sum(ns)::DOUBLE / count(*), 6) AS mean FROM t GROUP BY ALL),
m AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY mean, candidate) AS k FROM c) SELECT region, candidate, n, mean FROM m WHERE k = 1""")
def cheapest_candidate(spark, sf_dir):
    c = telemetry(spark, sf_dir).groupBy("region", (F.col("user_id") % 4).alias("candidate")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("ns") / F.count(F.lit(1)), 6).alias("mean"))
    best = c.groupBy("region").agg(F.min(F.struct("mean", "candidate", "n")).alias("b"))
    return best.select("region", "b.candidate", "b.n", "b.mean")


@query(f"""WITH {_T}, d AS (SELECT region, "at", count(*) AS n, sum(CASE WHEN value > 60 THEN 1 ELSE 0 END) AS over FROM t GROUP BY ALL)
SELECT region, "at", CASE WHEN over = 0 THEN NULL ELSE round(n::DOUBLE / over, 12) END AS value, CASE WHEN over = 0 THEN 'zero denominator' END AS reason FROM d""")
def ratios_with_reasons(spark, sf_dir):
    d = telemetry(spark, sf_dir).groupBy("region", "at").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("value") > 60, 1).otherwise(0)).alias("over"))
    r = aggregates.ratio(F.col("n"), F.col("over"))
    return d.select("region", "at", F.round(r["value"], 12).alias("value"), r["reason"].alias("reason"))


@query(f"""WITH {_T}, s AS (SELECT "at", region, count(*) AS n FROM t GROUP BY ALL) SELECT "at", region, n, round(n::DOUBLE / sum(n) OVER (PARTITION BY "at"), 12) AS share FROM s""")
def shape_shares(spark, sf_dir):
    s = telemetry(spark, sf_dir).groupBy("at", "region").agg(F.count(F.lit(1)).alias("n"))
    return s.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("at")), 12))


@query(f"""WITH {_T}, w AS (SELECT region, "at", count(*) AS n FROM t GROUP BY ALL), c AS (SELECT region, "at", sum(n) OVER (PARTITION BY region ORDER BY "at") AS completed FROM w)
SELECT region, "at", completed::BIGINT AS completed, (completed - lag(completed, 1, 0) OVER (PARTITION BY region ORDER BY "at"))::BIGINT AS delta, lag("at") OVER (PARTITION BY region ORDER BY "at") AS previous FROM c""")
def cumulative_deltas(spark, sf_dir):
    by = Window.partitionBy("region").orderBy("at")
    w = telemetry(spark, sf_dir).groupBy("region", "at").agg(F.count(F.lit(1)).alias("n"))
    c = w.withColumn("completed", F.sum("n").over(by))
    return c.select("region", "at", "completed", (F.col("completed") - F.lag("completed", 1, 0).over(by)).alias("delta"), F.lag("at").over(by).alias("previous"))


@query(f"""WITH {_T}, w AS (SELECT region, "at", max(value) > 60 AS bad FROM t GROUP BY ALL),
r AS (SELECT *, sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER (PARTITION BY region ORDER BY "at") AS run FROM w)
SELECT region, count(*) AS length, min("at") AS begins FROM r WHERE bad GROUP BY region, run HAVING count(*) >= 3""")
def late_streaks(spark, sf_dir):
    w = telemetry(spark, sf_dir).groupBy("region", "at").agg((F.max("value") > 60).alias("bad"))
    return layout.streaks(w, ["region"], ["at"], F.col("bad"), 3)


@query(f"""WITH {_T}, s AS (SELECT event_id, "at" % 24 AS hour, CASE WHEN "at" % 2 = 0 THEN 200.0 ELSE 400.0 END::DOUBLE AS rate FROM t)
SELECT event_id, coalesce(sum(1000000 / rate) OVER (PARTITION BY hour ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)::DOUBLE AS due_us FROM s""")
def due_times(spark, sf_dir):
    rows = telemetry(spark, sf_dir).select("event_id", (F.col("at") % 24).alias("hour"), F.when(F.col("at") % 2 == 0, 200.0).otherwise(400.0).alias("rate"))
    return layout.schedule(rows, "event_id", "rate", "hour", "due_us").select("event_id", "due_us")


@query(f"""WITH {_T}, c AS (SELECT "at" % 10 AS segment, count(*) AS count FROM t GROUP BY 1)
SELECT segment, count, coalesce(sum(count) OVER (ORDER BY segment ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS starts FROM c""")
def segment_offsets(spark, sf_dir):
    c = telemetry(spark, sf_dir).groupBy((F.col("at") % 10).alias("segment")).agg(F.count(F.lit(1)).alias("count"))
    before = Window.orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)  # ten segments
    return c.withColumn("starts", F.coalesce(F.sum("count").over(before), F.lit(0)).cast("long"))


@query(f"""WITH {_T}, w AS (SELECT "at", count(*) AS requests, sum(CASE WHEN value > 100 THEN 1 ELSE 0 END)::BIGINT AS late FROM t GROUP BY 1),
e AS (SELECT unnest(range(min("at"), max("at") + 1)) AS "at" FROM w)
SELECT e."at", coalesce(requests, 0) AS requests, coalesce(late, 0) AS late FROM e LEFT JOIN w ON w."at" = e."at\"""")
def windows_with_empty(spark, sf_dir):
    w = telemetry(spark, sf_dir).groupBy("at").agg(F.count(F.lit(1)).alias("requests"), F.sum(F.when(F.col("value") > 100, 1).otherwise(0)).cast("long").alias("late"))
    return windows.with_empty(w, "at", 1, ["requests", "late"])


@query(f"""WITH {_T}, w AS (SELECT floor(epoch(ts) / 3600)::BIGINT AS hour, count(*) AS requests, sum(CASE WHEN value > 100 THEN 1 ELSE 0 END)::BIGINT AS late, sum(CASE WHEN region = 'error' THEN 1 ELSE 0 END)::BIGINT AS errors,
 quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.99) AS p99 FROM t GROUP BY 1)
SELECT hour, requests, late, errors, p50, p99, nullif(concat_ws('+', CASE WHEN p99 > 100 THEN 'service_ceiling' END, CASE WHEN errors * 5 > requests THEN 'errors' END), '') AS reject_reason FROM w""")
def window_records(spark, sf_dir):
    out = windows.records(telemetry(spark, sf_dir), "ts", "1 hour", "value", 100.0, F.col("region") == "error")
    return out.select(F.floor(F.unix_timestamp("window_start") / HOUR).cast("long").alias("hour"), "requests", "late", "errors", "p50", "p99", "reject_reason")


@query(f"""WITH {_T}, z AS (SELECT region, "at" AS idx0, sum(ns)::BIGINT AS size FROM t GROUP BY ALL), i AS (SELECT region, row_number() OVER (PARTITION BY region ORDER BY idx0) AS idx, size FROM z),
p AS (SELECT region, idx, size + lead(size) OVER (PARTITION BY region ORDER BY idx) AS total FROM i),
b AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY total > 60000, total, idx) AS k FROM p WHERE total IS NOT NULL)
SELECT region, idx AS start, 2::BIGINT AS length, total FROM b WHERE k = 1""")
def compaction_run(spark, sf_dir):
    return aggregates.cheapest_run(_tiles(spark, sf_dir), 60_000)


def _tiles(spark, sf_dir):
    z = telemetry(spark, sf_dir).groupBy("region", "at").agg(F.sum("ns").alias("size"))
    return z.select("region", F.row_number().over(Window.partitionBy("region").orderBy("at")).cast("long").alias("idx"), "size")


@query()
def compaction_simulation(spark, sf_dir):
    return sequences.simulate_compaction(_tiles(spark, sf_dir), 12, 60_000)


@query()
def compaction_choice(spark, sf_dir):
    return sequences.compaction_choice(_tiles(spark, sf_dir), 60_000, 12)


@query(f"""WITH {_T}, w AS (SELECT region, "at", quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.99) AS p99 FROM t GROUP BY ALL), f AS (SELECT region, min("at") AS first FROM w GROUP BY 1)
SELECT w.region, round(quantile_cont(p50, 0.5), 9) AS p50, max(p99) AS p99 FROM w JOIN f ON f.region = w.region AND w."at" > f.first GROUP BY 1""")
def steady_state(spark, sf_dir):
    p = lambda q: F.expr(f"percentile_disc({q}) within group (order by value)")
    w = telemetry(spark, sf_dir).groupBy("region", "at").agg(p(0.5).alias("p50"), p(0.99).alias("p99"))
    later = w.withColumn("first", F.min("at").over(Window.partitionBy("region"))).where("at > first")
    return later.groupBy("region").agg(F.round(F.percentile("p50", F.lit(0.5)), 9).alias("p50"), F.max("p99").alias("p99"))


@query(f"""WITH {_T}, l(name, page, factor) AS (VALUES ('4k', 4, 1.0), ('16k', 16, 0.8), ('64k', 64, 0.7)),
c AS (SELECT region, avg(value) AS mean, count(*) AS n FROM t GROUP BY 1), s AS (SELECT l.name, sum(n * (mean * factor + page / 8.0)) / sum(n) AS score FROM c, l GROUP BY 1)
SELECT name, round(score, 6)::DOUBLE AS score, row_number() OVER (ORDER BY round(score, 6), name) AS rank FROM s""")
def layout_ranking(spark, sf_dir):
    c = telemetry(spark, sf_dir).groupBy("region").agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n"))
    options = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(p).alias("page"), F.lit(f).alias("factor")) for n, p, f in (("4k", 4, 1.0), ("16k", 16, 0.8), ("64k", 64, 0.7))])
    rows = c.select("mean", "n", F.inline(options))
    s = rows.groupBy("name").agg(F.round(F.sum(F.col("n") * (F.col("mean") * F.col("factor") + F.col("page") / 8.0)) / F.sum("n"), 6).alias("score"))
    return s.withColumn("rank", F.row_number().over(Window.orderBy("score", "name")).cast("long"))  # three layouts


@query(f"WITH {_T} SELECT count(*) AS n, sum(strlen(region))::BIGINT AS bytes FROM t WHERE region IN ('purchase', 'signup')")
def write_ingest(spark, sf_dir):
    return telemetry(spark, sf_dir).where(F.col("region").isin("purchase", "signup")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("region")).cast("long").alias("bytes"))


@query()
def layout_bandit(spark, sf_dir):
    t = telemetry(spark, sf_dir).groupBy("region", F.floor(F.col("at") / 6).cast("long").alias("window")).agg(F.avg("value").alias("cost"), F.max("value").alias("tail"))
    return bandit.replay(t)


@query()
def approximate_sketches(spark, sf_dir):
    return telemetry(spark, sf_dir).groupBy("region").agg(F.approx_count_distinct("user_id").alias("users"), F.percentile_approx("value", 0.99, 10_000).alias("p99"))
