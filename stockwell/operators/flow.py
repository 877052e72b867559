"""Order flow: guarded decrements, outcomes of requests, and the invariants that committed state must keep."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def guarded_fold(requests: DataFrame, keys: list[str], order: list[str], qty: str, initial: int) -> DataFrame:
    """keys, taken, refused, on_hand: each request, in order, takes its quantity if enough is left.

    A sequential fold per key, as a later smaller request may succeed after a larger one fails: sorted
    partitions are streamed, so a key may have any number of requests. Keys must not be null.
    """
    types = dict(requests.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", taken long, refused long, on_hand long"

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, taken, refused, left = None, 0, 0, initial
        for pdf in parts:
            out = []
            for *k, q in pdf[[*keys, qty]].itertuples(index=False, name=None):
                if k != key:
                    if key is not None:
                        out.append((*key, taken, refused, left))
                    key, taken, refused, left = k, 0, 0, initial
                if left >= q:
                    taken, left = taken + 1, left - q
                else:
                    refused += 1
            yield pd.DataFrame(out, columns=[*keys, "taken", "refused", "on_hand"])
        if key is not None:
            yield pd.DataFrame([(*key, taken, refused, left)], columns=[*keys, "taken", "refused", "on_hand"])

    rows = requests.select(*keys, *[c for c in order if c not in keys], *([] if qty in (*keys, *order) else [qty]))
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(fold, schema)


def outcomes(requests: DataFrame, initial: int) -> DataFrame:
    """requests (seq unique, order_no, sku, qty, customer_known) with a status for each.

    skipped: no such customer, nothing is written; rejected: the order number is in use, by an order or a
    backorder; ok: stock was taken; backorder: it was not enough, or (where a column `stocked` says so) there
    is no such stock. Whether a number is free does not depend
    on stock, so it is the first known request of its number; the guard is a fold per sku, streamed in
    order through sorted partitions.
    """
    known = requests.where("customer_known")
    first = known.groupBy("order_no").agg(F.min("seq").alias("seq")).withColumn("first", F.lit(True))
    marked = requests.join(first, ["order_no", "seq"], "left")
    status = F.when(~F.col("customer_known"), "skipped").when(F.col("first").isNull(), "rejected")
    if "stocked" in requests.columns:
        status = status.when(~F.col("stocked"), "backorder")
    marked = marked.withColumn("status", status).drop("first")
    schema = ", ".join(f"{n} {t}" for n, t in marked.dtypes)

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sku, left = object(), 0
        for pdf in parts:
            out = []
            for s, q in zip(pdf["sku"], pdf["qty"], strict=True):
                if s != sku:
                    sku, left = s, initial
                ok = left >= q
                left -= q if ok else 0
                out.append("ok" if ok else "backorder")
            yield pdf.assign(status=out)

    live = marked.where("status is null").withColumn("status", F.lit(""))
    folded = live.repartition("sku").sortWithinPartitions("sku", "seq").mapInPandas(fold, schema)
    return folded.unionByName(marked.where("status is not null"))


def replayed(done: DataFrame, again: DataFrame) -> DataFrame:
    """seq, id, cust, take, otherwise, commit of requests and of their repeats.

    done: seq, status (see outcomes) and found (which customer lookup did: find, else, or null). again: seq, id,
    the seq of the identical request that it repeats. A committed request gets its commit back and changes
    nothing; one that wrote nothing is judged anew, with the same result, as a number in use stays in use.
    """
    committed = F.col("status").isin("ok", "backorder")
    first = done.withColumn("id", F.col("seq")).withColumn("repeat", F.lit(False))
    later = again.join(done.withColumnRenamed("seq", "id"), "id").withColumn("repeat", F.lit(True))
    rows = first.unionByName(later)
    cust = F.when(F.col("repeat") & committed, "skipped").when(F.col("status") == "skipped", "empty").otherwise(F.col("found"))
    take = F.when(F.col("status") == "backorder", "failed").when(F.col("status") == "ok", "ok").otherwise(F.col("status"))
    return rows.select("seq", "id", cust.alias("cust"), take.alias("take"), F.when(F.col("status") == "backorder", "ok").alias("otherwise"), F.when(committed, F.col("id")).alias("commit"))


def invariants(stock: DataFrame, moves: DataFrame, orders: DataFrame, backorders: DataFrame, counted: DataFrame, requests: DataFrame, initial: int) -> DataFrame:
    """check, violations: rows (or the size of the difference) that break each rule of the committed state; zero where it holds.

    stock: sku, on_hand. moves: order_no, sku, delta. orders, backorders: order_no, sku, qty. counted: status, n,
    what the flow says it did. requests: what was asked of it.
    """
    count = F.count(F.lit(1)).alias("violations")
    rule = lambda name, df: df.agg(count).select(F.lit(name).alias("check"), "violations")
    sums = moves.groupBy("sku").agg(F.sum("delta").alias("moved"))
    cells = stock.join(sums, "sku", "left").withColumn("expected", initial + F.coalesce("moved", F.lit(0)))
    numbers = orders.select("order_no").unionByName(backorders.select("order_no"))
    o = orders.select(F.col("order_no").alias("_no"), F.col("sku").alias("_sku"), "qty")
    pairs = moves.join(o, moves.order_no == o._no, "left")
    size = lambda df, name, what=count: df.agg(what.alias("v")).select(F.lit(name).alias("k"), F.col("v").cast("long").alias("v"))
    totals = [
        size(moves, "m"), size(orders, "o"), size(backorders, "b"), size(requests, "q"), size(stock, "c"), size(moves, "d", F.sum("delta")), size(orders, "t", F.sum("qty")),
        size(stock, "h", F.sum("on_hand")), size(requests.where("not customer_known"), "u"),
        size(orders.select("sku").unionByName(backorders.select("sku")).distinct(), "k"), counted.select(F.col("status").alias("k"), F.col("n").alias("v")),
    ]
    told = totals[0]
    for t in totals[1:]:
        told = told.unionByName(t)
    n = told.groupBy(F.lit(1)).agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("n"))  # a few numbers
    v = lambda k: F.coalesce(F.col("n")[k], F.lit(0))
    differences = {
        "cell_count": v("c") - v("k"),
        "movement_count_is_committed_takes": v("m") - v("ok"),
        "order_count_is_committed_takes": v("o") - v("ok"),
        "backorder_count_is_committed_fallbacks": v("b") - v("backorder"),
        "every_order_flow_accounted": v("q") - (v("ok") + v("backorder") + v("skipped") + v("rejected")),
        "no_skipped_take": v("u"),
        "movement_delta_sum": v("d") + v("t"),
        "stock_decrements_match_orders": v("h") - (initial * v("c") - v("t")),
    }
    entries = F.array(*[F.struct(F.lit(name).alias("check"), F.abs(x).cast("long").alias("violations")) for name, x in differences.items()])
    out = n.select(F.inline(entries))
    for check in (
        rule("on_hand_matches_movements", cells.where("on_hand <> expected")),
        rule("on_hand_non_negative", stock.where("on_hand < 0")),
        rule("no_duplicate_order_no", numbers.groupBy("order_no").count().where("count > 1")),
        rule("movement_deltas_match_order_lines", pairs.where("_no is null or qty <> -delta or sku <> _sku")),
    ):
        out = out.unionByName(check)
    return out


def reconcile(stock: DataFrame, moves: DataFrame, keys: list[str], initial: int) -> DataFrame:
    sums = moves.groupBy(*keys).agg(F.sum("delta").alias("moved"))
    return stock.join(sums, keys, "left").withColumn("moved", F.coalesce("moved", F.lit(0))).withColumn("on_hand", F.col("moved") + initial)


def committed_once(requests: DataFrame, block: str, order: list[str]) -> DataFrame:
    """Requests by block id: the first one commits, replays get its position back."""
    w = Window.partitionBy(block).orderBy(*order)
    return requests.withColumn("replay", F.row_number().over(w) > 1)
