"""Generators, checks, sequences and sinks against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from stockwell.functions import scalars
from stockwell.operators import aggregates, checks, generators, sequences, versions
from stockwell.sources import sinks, traces



def slow_grown(sizes, budget, most, ratio):
    """All intervals around the smallest tile, grown one by one."""
    run = [min(range(len(sizes)), key=lambda i: (sizes[i], i))]
    seed = sizes[run[0]]
    while len(run) < most:
        near = [i for i in (run[0] - 1, run[-1] + 1) if 0 <= i < len(sizes)]
        near = [i for i in near if sum(sizes[j] for j in run) + sizes[i] <= budget and (not ratio or sizes[i] <= ratio * seed)]
        if not near:
            return (run[0], len(run)) if len(run) > 1 else None
        run = sorted([*run, sorted(near, key=lambda i: (sizes[i], i))[0]])
    return run[0], len(run)


def test_compaction_runs(spark):
    rng = random.Random(4)
    for _ in range(300):
        sizes = [rng.randint(0, 30) for _ in range(rng.randint(2, 12))]
        for ratio in (None, 2):
            assert sequences.grown_run(sizes, 60, 5, ratio) == slow_grown(sizes, 60, 5, ratio)
        runs = [(sum(sizes[s : s + n]), s, n) for s in range(len(sizes)) for n in range(2, len(sizes) - s + 1)]
        fit = [r for r in runs if r[0] <= 25] or [(t, s, n) for t, s, n in runs if n == 2]
        start, n = sequences.cheapest_pair(sizes, 25)
        assert sum(sizes[start : start + n]) == min(fit)[0]
    sizes = {"a": [5, 1, 9, 2, 2, 7], "b": [3], "c": [100, 100]}
    df = spark.createDataFrame([(r, i, s) for r, xs in sizes.items() for i, s in enumerate(xs)], "region string, idx long, size long")
    got = {(r.region, r.policy): (r.start, r.length, r.total) for r in sequences.compaction_choice(df, 10, 4).collect()}
    assert got[("a", "budget_prefix")] == (0, 2, 6) and got[("a", "cheapest_pair")] == (3, 2, 4) and got[("c", "ratio_group")] == (0, 2, 200) and ("b", "budget_prefix") not in got
    done = {r.region: r for r in sequences.simulate_compaction(df, 3, 10).collect()}
    # 5,1,9,2: 1 takes 5; 9,2,6,2: 2 (the older) takes 6; 9,8,2... by hand: written = payload + merges
    assert done["a"].payload == 26 and done["a"].left == 3 and done["a"].bytes_written > 26 and done["b"].merges == 0 and done["c"].bytes_written == 200


def test_ready_groups(spark):
    rng = random.Random(2)
    due, rows = 0.0, []
    for i in range(400):
        rows.append(("s", i, due, 200.0 if i < 250 else 400.0))
        due += rng.choice([10.0, 400.0, 3000.0])
    got = sequences.ready_groups(spark.createDataFrame(rows, "server string, seq long, due_us double, rate double"), ["server"], 8, 1500).orderBy("seq").collect()
    now, i, want = 0.0, 0, []
    while i < len(rows):
        now = max(now, rows[i][2])
        end = i
        while end < len(rows) and end < i + 8 and rows[end][2] <= now and rows[end][3] == rows[i][3]:
            end += 1
        want.append((i, end, now))
        i, now = end, now + 1500
    assert [(a, b) for a, b, _ in want] == [(min(x), max(x) + 1) for g in range(len(want)) for x in [[r.seq for r in got if r.group == g]]]
    assert all(r.issued_us == want[r.group][2] for r in got)


def test_index_upkeep(spark):
    rows = [("r", w, 300 * (w + 1), int(w in (2, 9)), 300) for w in range(12)]
    got = sequences.index_upkeep(spark.createDataFrame(rows, "region string, window long, csn long, scans long, changes long")).orderBy("window").collect()
    at, base, delta, want = 0, 0, 0, []
    for _, w, csn, scans, n in rows:
        delta += n
        rebuilt = scans > 0 or csn - at >= 1024
        merged = rebuilt and delta >= min(max(1024, base), 200_000)
        if rebuilt:
            at = csn
        if merged:
            base, delta = base + delta, 0
        want.append((w, rebuilt, merged, base))
    assert [(r.window, r.rebuilt, r.merged, r.base) for r in got] == want and any(x[2] for x in want)


def test_hashes(spark):
    rows = [("123456789",), ("",), (None,), ("a",), ("é" * 40,), ("foobar",)]
    got = spark.createDataFrame(rows, "t string").select("t", scalars.crc32c("t").alias("c"), scalars.fnv1a("t").alias("f")).collect()
    by = {r.t: r for r in got}
    assert by["123456789"].c == 0xE3069283 and by[""].c == 0 and by[None].c is None and by[None].f is None
    assert int(by["foobar"].f) == 0x85944171F73967E8 and int(by["a"].f) == 0xAF63DC4C8601EC8C and int(by[""].f) == scalars.FNV_OFFSET


def test_histogram_buckets_at_their_bounds(spark):
    bounds = aggregates.bucket_bounds()
    values = sorted({max(0, b + d) for b in bounds for d in (-1, 0, 1)} | {10**15})
    got = spark.createDataFrame([(v,) for v in values], "ns long").select("ns", aggregates.bucket_of(F.col("ns")).alias("b")).collect()
    assert all(r.b == max(i for i, b in enumerate(bounds) if b <= r.ns) for r in got)


def test_quantiles(spark):
    import numpy as np

    from stockwell.operators import quantiles

    rng = random.Random(6)
    rows = [(k, round(rng.choice([rng.gauss(0, 5), rng.expovariate(0.01), 0.0, 7.0]), 2)) for k in "abc" for _ in range(rng.randint(1, 900))]
    rows += [("d", 3.5), ("e", None), ("e", float("nan")), ("f", -2.0), ("f", 5.0)]
    got = quantiles.exact(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", {"p50": 0.5, "p99": 0.99, "p0": 0.0}, {"q1": 0.25, "q3": 0.75}).collect()
    assert sorted(r.k for r in got) == ["a", "b", "c", "d", "f"]
    for r in got:
        own = sorted(v for k, v in rows if k == r.k)
        assert (r.p50, r.p99, r.p0) == (own[-(-len(own) // 2) - 1], own[-(-99 * len(own) // 100) - 1], own[0])
        assert abs(r.q1 - np.percentile(own, 25)) < 1e-9 and abs(r.q3 - np.percentile(own, 75)) < 1e-9


def test_zipf(spark):
    w = generators.zipf_weights(spark.range(5, 3005).withColumnRenamed("id", "k"), "k", width=64)
    rows = w.orderBy("rank").collect()
    at = 0
    for i, r in enumerate(rows, 1):
        assert (r.k, r.rank, r.before, r.upto) == (i + 4, i, at, at + max(1, 2**32 // i))
        at = r.upto
    draws = [0, 1, at - 1, at, at + 5, rows[7].before, rows[7].before - 1, rows[2000].upto - 1]
    got = generators.zipf_draws(spark.createDataFrame([(d,) for d in draws], "u long"), "u", w).collect()
    assert all(r.rank == next(x.rank for x in rows if x.before <= r.u % at < x.upto) for r in got) and len(got) == len(draws)


def test_request_checks(spark):
    lines = {
        '{"id":"r","class":{},"blocks":{"q":{"find":{"Customer":{"email":"a"}}}}}': ("customer_lookup", None),
        '{"id":"r","class":{},"blocks":{"q":{"find":{"Customer":{"email":""}}}}}': ("customer_lookup", "text"),
        '{"id":"r","blocks":{"q":{"get":{"Stock":{"where":{"sku":"$s","loc":"l"}}}}}}': ("stock_lookup", "fields+text"),
        '{"id":"r","class":{},"blocks":{"q":{"find":{"StockMovement":{"where":{"order_no":"o"}},"order":["day"],"limit":100}}}}': ("movements_scan", "constant"),
        '{"id":"' + "r" * 70000 + '","class":{},"blocks":{"q":{"find":{"Customer":{"email":"a"}}}}}': ("customer_lookup", "size"),
        '{"id":"r","class":{},"blocks":{"q":{}}}': (None, "fields+text"),
    }
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    got = {r.line: (r.s, r.r) for r in df.select("line", checks.shape_of(F.col("line")).alias("s"), checks.rejections(F.col("line")).alias("r")).collect()}
    assert got == lines


def test_flow_requests(spark):
    import json

    good = {
        "id": "r", "class": {"durability": "batched", "retry_horizon_s": 300}, "params": {"sku": "s", "loc": "l", "qty": 3, "email": "e", "order_no": "o"},
        "blocks": {
            "cust": {"find": {"Customer": {"email": "$email"}}},
            "take": {
                "needs": ["cust"],
                "ops": [
                    {"patch": {"Stock": {"where": {"sku": "$sku", "loc": "$loc", "on_hand": {"$gte": "$qty"}}, "set": {"$inc": {"on_hand": "-$qty"}}}}},
                    {"put": {"StockMovement": {"movement_no": "m1", "sku": "$sku", "loc": "$loc", "delta": "-$qty", "order_no": "$order_no", "stock": {"sku": "$sku", "loc": "$loc"}}}},
                    {"put": {"Order": {"order_no": "$order_no", "buyer": "$cust._ref", "status": "open", "lines": [{"sku": "$sku", "qty": "$qty"}]}}},
                ],
                "else": [{"put": {"Backorder": {"sku": "$sku", "qty": "$qty", "order_no": "$order_no"}}}],
            },
        },
    }

    def changed(path, value):
        out = json.loads(json.dumps(good))
        at = out
        for p in path[:-1]:
            at = at[p]
        at[path[-1]] = value
        return json.dumps(out)

    take = ("blocks", "take")
    want = {
        json.dumps(good): None, json.dumps(good, sort_keys=True): None, changed(("more",), 1): "fields", changed(("params", "email"), ""): "text", changed(("params", "qty"), 0): "qty",
        changed(("class", "durability"), "none"): "class", changed((*take, "needs"), []): "constant", changed((*take, "ops", 2, "put", "Order", "status"), "shut"): "constant",
        changed((*take, "ops", 0, "patch", "Stock", "set"), {"$inc": {"on_hand": "$qty"}}): "constant", changed((*take, "ops", 1, "put", "StockMovement", "movement_no"), "$m"): "text",
        changed(("id",), "r" * 2000): "size", changed((*take, "ops"), good["blocks"]["take"]["ops"][:2]): "fields+constant",
    }
    df = spark.createDataFrame([(x,) for x in want], "line string")
    assert {r.line: r.r for r in df.select("line", checks.flow_rejections(F.col("line")).alias("r")).collect()} == want


def test_log_frames(spark, tmp_path):
    sums = {r.t: r.c for r in spark.createDataFrame([("one",), ("two two",), ("three",)], "t string").select("t", scalars.crc32c("t").alias("c")).collect()}
    frames = [f"{i} {sums[t]:08x} {t}" for i, t in enumerate(sums)]
    (tmp_path / "log").write_text("\n".join([*frames, "3 00000000 tor"]))
    assert [(r.seq, r.payload) for r in traces.log_frames(spark, str(tmp_path / "log")).orderBy("seq").collect()] == [(0, "one"), (1, "two two"), (2, "three")]
    (tmp_path / "bad").write_text("\n".join([frames[0], "1 00000000 two two", frames[2]]))
    with pytest.raises(Exception, match="bad frame"):
        traces.log_frames(spark, str(tmp_path / "bad")).collect()


def test_puts_and_bounds(spark):
    ok = spark.createDataFrame([("{}",)], "doc string")
    assert checks.puts(ok, "doc").count() == 1
    for bad in ("", None, "x" * 70000):
        with pytest.raises(Exception, match="empty or oversized"):
            checks.puts(spark.createDataFrame([(bad,)], "doc string"), "doc").collect()
    assert checks.within_bytes(ok, F.octet_length("doc"), 2).count() == 1
    with pytest.raises(ValueError):
        checks.within_bytes(ok, F.octet_length("doc"), 1)


def test_hints_and_entries(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "handle long, name string")
    hints = spark.createDataFrame([("a", 1), ("b", 1), ("c", None)], "name string, hint long")
    assert {(r.name, r.handle, r.by_hint) for r in checks.hinted(hints, docs, "name", "handle").collect()} == {("a", 1, True), ("b", 2, False), ("c", 3, False)}
    entries = spark.createDataFrame([(1, "a"), (2, "x"), (9, "c")], "handle long, value string")
    assert {(r.handle, r.said) for r in checks.agreement(entries, docs, "handle", "value", "name").collect()} == {(1, "agreed"), (2, "different"), (9, "dangling")}


def test_allocation_and_regions(spark):
    rows = spark.createDataFrame([("b",), ("a",)], "k string")
    assert {(r.k, r.handle) for r in versions.allocate(rows, 7, ["k"]).collect()} == {("a", 8), ("b", 9)}
    names = spark.createDataFrame([("P|Stock",), ("U|",), ("X|Stock",)], "n string")
    assert [r[0] for r in names.select(scalars.is_region(F.col("n"))).collect()] == [True, False, False]


def test_sinks(spark, tmp_path):
    at = lambda name: str(tmp_path / name)
    tiles = spark.createDataFrame([("r", 3, "c"), ("r", 1, "a"), ("s", 1, "x")], "region string, k long, v string")
    sinks.write_tiles(tiles, at("tiles"), "region", "k")
    assert spark.read.parquet(at("tiles")).count() == 3
    with pytest.raises(Exception, match="two entries"):
        sinks.write_tiles(tiles.unionByName(tiles.limit(1)), at("twice"), "region", "k")
    spark.range(10).withColumnRenamed("id", "csn").write.parquet(at("log"))
    sinks.rotate_log(spark, at("log"), at("log2"), 6)
    assert sorted(r.csn for r in spark.read.parquet(at("log2")).collect()) == [7, 8, 9]
    sinks.write_results(spark.createDataFrame([(1, "r", {"q": "ok"}, 5)], "line long, id string, blocks map<string,string>, more long"), at("out"))
    assert [r.value for r in spark.read.text(at("out")).collect()] == ['{"blocks":{"q":"ok"},"id":"r","line":1}']
    sinks.write_windows(spark.createDataFrame([(2, 1)], "window long, errors long"), at("win"))
    assert spark.read.text(at("win")).first().value == '{"errors":1,"window":2}'
    sinks.bulk_load(tiles, at("bulk"))
    sinks.bulk_load(tiles, at("bulk"))
    assert spark.read.parquet(at("bulk")).count() == 6
    sinks.write_policy(spark, {"default": {"page": 4}, "P|Stock": {"page": 8}}, at("policy"))
    held = sinks.PolicyReload(spark, at("policy"), {"page": 1})
    assert held.window()["P|Stock"] == {"page": 8}
    (tmp_path / "policy" / "part-bad.txt").write_text("not json")
    assert held.window()["P|Stock"] == {"page": 8} and held.refused == 1


def test_seed_blocks_and_run_records(spark, tmp_path):
    (tmp_path / "seed.json").write_text('{"block":"b1","docs":[{"entity":"Customer","doc":"{\\"email\\":\\"e\\"}","unique":{"field":"email","value":"e"}}]}\n')
    assert traces.seed_blocks(spark, str(tmp_path / "seed.json")).first().unique_value == "e"
    (tmp_path / "wrong.json").write_text('{"block":"b1","docs":[{"entity":"Customer","doc":"{\\"email\\":\\"x\\"}","unique":{"field":"email","value":"e"}}]}\n')
    with pytest.raises(Exception, match="differs"):
        traces.seed_blocks(spark, str(tmp_path / "wrong.json")).collect()
    run = tmp_path / "block-2" / "rung-300"
    run.mkdir(parents=True)
    (run / "run-1.json").write_text('{"achieved": 3}')
    from pyspark.sql import types as T

    row = traces.run_records(spark, str(tmp_path / "block-*" / "rung-*" / "run-*.json"), T.StructType([T.StructField("achieved", T.LongType())])).first()
    assert (row.block, row.rung, row.achieved) == (2, 300, 3)


def test_policy_reload_in_a_stream(spark, tmp_path):
    sinks.write_policy(spark, {"default": {"page": 4}}, str(tmp_path / "policy"))
    held, seen = sinks.PolicyReload(spark, str(tmp_path / "policy"), {"page": 1}), []
    spark.range(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    run = stream.writeStream.foreachBatch(held.sink(lambda batch, p: seen.append((batch.count(), p["default"]["page"])))).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert sum(n for n, _ in seen) == 3 and {p for _, p in seen} == {4}


def test_sketches_are_near_exact(spark, sf_dir):
    from bisect import bisect_left, bisect_right

    from stockwell.plans import telemetry

    exact = {}
    for r in telemetry.telemetry(spark, sf_dir).collect():
        exact.setdefault(r.region, []).append((r.user_id, r.value))
    got = {r.region: r for r in telemetry.approximate_sketches(spark, sf_dir).collect()}
    assert got.keys() == exact.keys()
    for region, rows in exact.items():
        users = len({u for u, _ in rows})
        assert abs(got[region].users - users) <= 0.15 * users + 1  # three standard errors of 5 %
        values = sorted(v for _, v in rows)
        low, high = bisect_left(values, got[region].p99), bisect_right(values, got[region].p99)
        assert low < high and low - 1 <= 0.99 * len(values) + len(values) / 10_000 and high + 1 >= 0.99 * len(values) - len(values) / 10_000
