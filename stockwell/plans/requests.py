"""Requests as a table-free plan: a DAG of named read blocks compiled to joins.

A block reads one table: {"from": table, "where": {field: condition}, "limit": n, "order": [fields],
"get": bool}. A condition is a literal, "$param", "$block.field", or {"$gte": ...} with $gt, $gte, $lt, $lte.
Equality holds for two nulls; comparisons with null do not. Fields of the same parent block come from the
same parent row, limits apply per parent row, and duplicate parents give duplicate children.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_COMPARE = {"$gt": lambda a, b: a > b, "$gte": lambda a, b: a >= b, "$lt": lambda a, b: a < b, "$lte": lambda a, b: a <= b}


def parents(block: dict) -> list[str]:
    """Blocks that a block's conditions refer to, in order of first mention."""
    found = []
    for cond in block.get("where", {}).values():
        for value in cond.values() if isinstance(cond, dict) else [cond]:
            if isinstance(value, str) and value.startswith("$") and "." in value:
                name = value[1:].split(".")[0]
                if name not in found:
                    found.append(name)
    return found


def topological(blocks: dict[str, dict]) -> list[str]:
    order: list[str] = []
    left = dict(blocks)
    while left:
        ready = [n for n, b in left.items() if all(p in order for p in parents(b))]
        if not ready:
            raise ValueError("blocks refer to each other in a circle or to unknown blocks")
        order += ready
        for n in ready:
            del left[n]
    return order


def _value(value, params: dict) -> Column:
    if isinstance(value, str) and value.startswith("$"):
        name = value[1:]
        return F.col(name) if "." in name else F.lit(params[name])
    return F.lit(value)


def compile_request(tables: dict[str, DataFrame], blocks: dict[str, dict], params: dict) -> dict[str, DataFrame]:
    """For each block a DataFrame with a struct column per block on its path (its parents and itself)."""
    out: dict[str, DataFrame] = {}
    for name in topological(blocks):
        block = blocks[name]
        rows = tables[block["from"]]
        rows = rows.select(F.struct(*rows.columns).alias(name))
        on = F.lit(True)
        for field, cond in block.get("where", {}).items():
            own = F.col(f"{name}.{field}")
            if isinstance(cond, dict):
                for op, value in cond.items():
                    on = on & _COMPARE[op](own, _value(value, params))
            else:
                on = on & own.eqNullSafe(_value(cond, params))
        above = parents(block)
        limit = 1 if block.get("get") else block.get("limit")
        by = [F.col(f"{name}.{f}") for f in block.get("order", [])] or [F.col(name)]
        if not above:
            rows = rows.where(on)
            out[name] = rows.orderBy(*by).limit(limit) if limit else rows
            continue
        parent = _joined([out[p] for p in above])
        if not limit:
            out[name] = parent.join(rows, on)
            continue
        keys = parent.columns
        parent = parent.withColumn("_copy", F.row_number().over(Window.partitionBy(*keys).orderBy(*keys)))
        w = Window.partitionBy(*keys, "_copy").orderBy(*by)
        met = parent.join(rows, on).withColumn("_n", F.row_number().over(w))
        out[name] = met.where(F.col("_n") <= limit).drop("_n", "_copy")
    return out


def _joined(parents: list[DataFrame]) -> DataFrame:
    """The rows of several parent blocks together: every combination, whatever ancestors they have in common.

    The conditions of the block that reads from them are equalities on their fields as a rule, which the
    optimizer moves into these joins; without any it is the product that the request asks for.
    """
    out = parents[0]
    for k, p in enumerate(parents[1:]):
        again = [c for c in p.columns if c in out.columns]
        out = out.join(p.withColumnsRenamed({c: f"{c}__{k}" for c in again}), F.lit(True))
    return out


def depths(blocks: dict[str, dict]) -> dict[str, int]:
    """Reads on the longest way from a root to each block, itself included."""
    out: dict[str, int] = {}
    for name in topological(blocks):
        out[name] = 1 + max((out[p] for p in parents(blocks[name])), default=0)
    return out


def descriptors(found: dict[str, DataFrame], blocks: dict[str, dict]) -> DataFrame:
    """One row per dependent block: depth, parents, rows per parent row (median, most, all), parent rows without any, and the request's hops.

    found: compile_request's result, where each row has the structs of its ancestors. A block has one parent here.
    """
    deep, hops = depths(blocks), [n for n in blocks if parents(blocks[n])]
    rows = None
    for name in hops:
        above = parents(blocks[name])[0]
        keys = found[above].columns
        per = found[above].select(F.struct(*keys).alias("key")).distinct()
        n = found[name].groupBy(F.struct(*keys).alias("key")).agg(F.count(F.lit(1)).alias("n"))
        per = per.join(n, "key", "left").fillna(0, ["n"])
        absent = F.count_if(F.col("n") == 0)
        one = per.agg(
            F.lit(name).alias("block"), F.lit(deep[name]).cast("long").alias("depth"), F.count(F.lit(1)).alias("parents"), F.percentile("n", F.lit(0.5)).alias("median"), F.max("n").alias("most"),
            F.sum("n").alias("rows"), absent.alias("absent"), F.round(absent / F.count(F.lit(1)), 9).alias("absent_share"), F.lit(len(blocks)).cast("long").alias("read_hops"), F.lit(len(hops)).cast("long").alias("dependent_hops"),
        )
        rows = one if rows is None else rows.unionByName(one)
    return rows


def fan_out(requests: DataFrame, hop: DataFrame, request: str) -> DataFrame:
    """Rows of a hop per request: the largest, the median and the sum over requests, absent ones as 0."""
    per = requests.select(request).distinct().join(hop.groupBy(request).agg(F.count(F.lit(1)).alias("n")), request, "left").fillna(0, ["n"])
    return per.agg(F.max("n").alias("most"), F.percentile("n", F.lit(0.5)).alias("median"), F.sum("n").alias("total"), F.sum(F.when(F.col("n") == 0, 1).otherwise(0)).cast("long").alias("absent"))
