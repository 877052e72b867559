"""Checks: requests, puts, size bounds, hints and index entries against documents, associations of fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bytes of a request, of its id and of a document at most; the limit and the order of a movement scan.
MOST_REQUEST, MOST_ID, MOST_DOC = 65_536, 1024, 65_536
SCAN_LIMIT, SCAN_ORDER = "100", '["movement_no"]'


#: What an order flow must say at these places, and the fields of its objects (the movement's number is its own).
FLOW_SAYS = {
    "$.blocks.take.needs": '["cust"]',
    "$.blocks.take.ops[0].patch.Stock.where.sku": "$sku",
    "$.blocks.take.ops[0].patch.Stock.where.loc": "$loc",
    "$.blocks.take.ops[0].patch.Stock.where.on_hand.$gte": "$qty",
    "$.blocks.take.ops[0].patch.Stock.set.$inc.on_hand": "-$qty",
    "$.blocks.take.ops[1].put.StockMovement.sku": "$sku",
    "$.blocks.take.ops[1].put.StockMovement.loc": "$loc",
    "$.blocks.take.ops[1].put.StockMovement.delta": "-$qty",
    "$.blocks.take.ops[1].put.StockMovement.order_no": "$order_no",
    "$.blocks.take.ops[1].put.StockMovement.stock.sku": "$sku",
    "$.blocks.take.ops[1].put.StockMovement.stock.loc": "$loc",
    "$.blocks.take.ops[2].put.Order.order_no": "$order_no",
    "$.blocks.take.ops[2].put.Order.buyer": "$cust._ref",
    "$.blocks.take.ops[2].put.Order.status": "open",
    "$.blocks.take.ops[2].put.Order.lines[0].sku": "$sku",
    "$.blocks.take.ops[2].put.Order.lines[0].qty": "$qty",
    "$.blocks.take.else[0].put.Backorder.sku": "$sku",
    "$.blocks.take.else[0].put.Backorder.qty": "$qty",
    "$.blocks.take.else[0].put.Backorder.order_no": "$order_no",
    "$.class.retry_horizon_s": "300",
}
FLOW_FIELDS = {
    "$": ["id", "class", "params", "blocks"],
    "$.class": ["durability", "retry_horizon_s"],
    "$.params": ["sku", "loc", "qty", "email", "order_no"],
    "$.blocks": ["cust", "take"],
    "$.blocks.take": ["needs", "ops", "else"],
    "$.blocks.take.ops[0].patch.Stock": ["where", "set"],
    "$.blocks.take.ops[0].patch.Stock.where": ["sku", "loc", "on_hand"],
    "$.blocks.take.ops[1].put.StockMovement": ["movement_no", "sku", "loc", "delta", "order_no", "stock"],
    "$.blocks.take.ops[2].put.Order": ["order_no", "buyer", "status", "lines"],
    "$.blocks.take.else[0].put.Backorder": ["sku", "qty", "order_no"],
}


def flow_rejections(line: Column) -> Column:
    """Why an order flow is not accepted, joined by +: fields, size, text, constant, class, qty; null if it is."""
    at = lambda path: F.get_json_object(line, path.replace("$inc", "['$inc']").replace("$gte", "['$gte']").replace(".['", "['") if path != "$" else path)
    every = lambda tests: F.coalesce(F.forall(F.array(*tests), lambda t: F.coalesce(t, F.lit(False))), F.lit(False))
    counts = [F.coalesce(F.json_array_length(at(f"$.blocks.take.{part}")), F.lit(0)) == n for part, n in (("ops", 3), ("else", 1))]
    lookups = has_exactly(at("$.blocks.cust"), ["find"]) | has_exactly(at("$.blocks.cust"), ["find", "else"])
    fields = every([*[has_exactly(at(path) if path != "$" else line, names) for path, names in FLOW_FIELDS.items()], *counts, lookups])
    texts = every([*[F.length(at(f"$.params.{p}")) > 0 for p in ("sku", "loc", "email", "order_no")], is_text(at("$.blocks.take.ops[1].put.StockMovement.movement_no")), F.length(at("$.id")) > 0])
    said = F.concat_ws(
        "+", F.when(~fields, "fields"), F.when((F.octet_length(line) > MOST_REQUEST) | (F.octet_length(at("$.id")) > MOST_ID), "size"), F.when(~texts, "text"),
        F.when(~every([at(path) == value for path, value in FLOW_SAYS.items()]), "constant"), F.when(~F.coalesce(at("$.class.durability").isin("batched", "durable"), F.lit(False)), "class"),
        F.when(~F.coalesce((at("$.params.qty").try_cast("long") > 0), F.lit(False)), "qty"),
    )
    return F.nullif(said, F.lit(""))


def has_exactly(json: Column, fields: list[str]) -> Column:
    """Whether a JSON object has these keys and no others."""
    return F.coalesce(F.array_sort(F.json_object_keys(json)) == F.array(*[F.lit(f) for f in sorted(fields)]), F.lit(False))


def is_text(value: Column) -> Column:
    """Not empty, without a zero character, and no expression."""
    return F.coalesce((F.length(value) > 0) & ~F.contains(value, F.lit("\0")) & ~value.startswith("$") & ~value.startswith("-$"), F.lit(False))


def shape_of(line: Column) -> Column:
    """The shape of a request, null if it has none."""
    at = lambda path: F.get_json_object(line, path).isNotNull()
    shape = F.when(at("$.blocks.take"), "order_flow").when(at("$.blocks.q.get"), "stock_lookup")
    return shape.when(at("$.blocks.q.find.Customer"), "customer_lookup").when(at("$.blocks.q.find.StockMovement"), "movements_scan")


def rejections(line: Column) -> Column:
    """Why a request is not accepted, joined by +: fields, size, text, constant; null if it is."""
    at = lambda path: F.get_json_object(line, path)
    shape = shape_of(line)
    text = F.coalesce(at("$.blocks.q.get.Stock.where.sku"), at("$.blocks.q.find.Customer.email"), at("$.blocks.q.find.StockMovement.where.order_no"), at("$.blocks.cust.find.Customer.email"))
    blocks = F.when(shape == "order_flow", has_exactly(at("$.blocks"), ["cust", "take"])).otherwise(has_exactly(at("$.blocks"), ["q"]))
    inner = F.when(shape == "stock_lookup", has_exactly(at("$.blocks.q.get.Stock.where"), ["sku", "loc"])).when(shape == "movements_scan", has_exactly(at("$.blocks.q.find"), ["StockMovement", "order", "limit"])).otherwise(True)
    constant = (shape == "movements_scan") & ((at("$.blocks.q.find.limit") != SCAN_LIMIT) | (at("$.blocks.q.find.order") != SCAN_ORDER))
    said = F.concat_ws(
        "+", F.when(~(has_exactly(line, ["id", "class", "blocks"]) & blocks & inner) | shape.isNull(), "fields"),
        F.when((F.octet_length(line) > MOST_REQUEST) | (F.octet_length(at("$.id")) > MOST_ID), "size"), F.when(~is_text(text), "text"), F.when(constant, "constant"),
    )
    return F.nullif(said, F.lit(""))


def puts(docs: DataFrame, doc: str) -> DataFrame:
    """The documents to put; an empty or missing one fails the query, and one over MOST_DOC bytes does too."""
    size = F.coalesce(F.octet_length(doc), F.lit(0))
    return docs.where(F.assert_true((size > 0) & (size <= MOST_DOC), "empty or oversized document").isNull())


def within_bytes(rows: DataFrame, size: Column, most: int) -> DataFrame:
    """The rows, refused as a whole if their sizes sum up to more than `most`. The sum is one number, computed first."""
    total = rows.agg(F.sum(size).alias("_sum")).first()[0] or 0
    if total > most:
        raise ValueError(f"{total} bytes are more than {most}")
    return rows


def hinted(hints: DataFrame, docs: DataFrame, value: str, handle: str) -> DataFrame:
    """value, handle, by_hint: the document a hint names if it has the value, else the one that has it."""
    named = docs.select(F.col(handle).alias("_h"), F.col(value).alias("_v"))
    tried = hints.join(named, (F.col("hint") == F.col("_h")) & (F.col(value) == F.col("_v")), "left").select(value, F.col("_h").alias("found"))
    return tried.join(docs, value).select(value, F.coalesce("found", handle).alias(handle), F.col("found").isNotNull().alias("by_hint"))


def agreement(entries: DataFrame, docs: DataFrame, handle: str, value: str, field: str) -> DataFrame:
    """Index entries with what they are: agreed, dangling (no such document) or different (it has another value)."""
    named = docs.select(F.col(handle).alias("_h"), F.col(field).alias("_f"))
    met = entries.join(named, F.col(handle) == F.col("_h"), "left")
    said = F.when(F.col("_h").isNull(), "dangling").when(F.col("_f").eqNullSafe(F.col(value)), "agreed").otherwise("different")
    return met.withColumn("said", said).drop("_h", "_f")


def associations(rows: DataFrame, a: str, b: str) -> DataFrame:
    """a, b, n, support, confidence (of b given a), lift, information (the pair's share of the mutual information, in bits)."""
    n = rows.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    of = lambda *by: F.sum("n").over(Window.partitionBy(*by)).cast("double")  # noqa: E731  one row per pair of values
    n = n.withColumns({"_a": of(a), "_b": of(b), "_t": of()})
    lift = F.col("n") * F.col("_t") / (F.col("_a") * F.col("_b"))
    share = F.col("n") / F.col("_t")
    return n.select(a, b, "n", F.round(share, 9).alias("support"), F.round(F.col("n") / F.col("_a"), 9).alias("confidence"), F.round(lift, 9).alias("lift"), F.round(share * F.log2(lift), 9).alias("information"))
