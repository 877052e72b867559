"""Sharding by balanced label propagation.

Documents with equal texts are linked; a group of them is a community, and one larger than a shard's quota is
cut into parts of a whole quota. Every document starts on a shard by hash. Then communities move as a whole
to the shard where most of their documents are, as far as its quota allows: the few large ones first, one by
one, the others in rounds of joins. What a shard refuses is offered another one with room in the next round,
until nothing moves. Documents without links, and those of communities that fit nowhere, fill what is free.
Law `rows`: the counts of the shards differ by one at most.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stockwell.llm.common import SUB_BUCKETS, Scratch, materialize, ranked

#: A community with more than this part of a quota is large: there are LARGE communities for each shard at most.
LARGE = 16


def _bucket(*cols, n=SUB_BUCKETS):
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")


def _communities(base: DataFrame, groups: DataFrame, whole: int) -> DataFrame:
    """The linked rows of `base` with c, their community: the group g, or a part of `whole` rows of it."""
    linked = base.join(groups, "g")
    over = linked.where(F.col("n") > whole).withColumn("b", _bucket("doc_id", "text_crc32"))
    over = ranked(over, ["g"], ["b"], F.lit(""), ["doc_id", "text_crc32"], "at")
    rows = linked.where(F.col("n") <= whole).withColumn("part", F.lit(0).cast("long"))
    rows = rows.unionByName(over.withColumn("part", F.floor((F.col("at") - 1) / F.lit(whole))).drop("at", "b"))
    return rows.withColumn("c", F.concat_ws("-", "g", F.col("part").cast("string"))).drop("g", "n", "part")


def _place_large(pull: DataFrame, free: list[int]) -> list[tuple[str, int]]:
    """(c, shard) of the communities of `pull`, largest first, each where most of its rows are among the shards with room; `free` shrinks."""
    out = []
    for r in sorted(pull.collect(), key=lambda r: (-r.n, r.c)):
        there = {p.start: p.m for p in r.pulls}
        rooms = [s for s, room in enumerate(free) if room >= r.n]
        if rooms:
            best = max(rooms, key=lambda s: (there.get(s, 0), free[s], -s))
            free[best] -= r.n
            out.append((r.c, best))
    return out


def _propagate(pending: DataFrame, free: list[int]) -> list[DataFrame]:
    """(c, shard) tables of the communities of `pending` (c, n, pulls) that find room; `free` shrinks. The driver sees a sum per shard and round."""
    placed, turn = [], 0
    while True:
        room = F.array(*[F.lit(x) for x in free])
        fits = F.filter("pulls", lambda p: F.element_at(room, p["start"] + 1) >= F.col("n"))
        best = F.array_max(F.transform(fits, lambda p: F.struct(p["m"], F.xxhash64("c", p["start"], F.lit(turn)), p["start"])))["start"]
        # Without room where its rows are: a shard by lot, in proportion to the room, or else the one with the most.
        draw = F.pmod(F.xxhash64("c", F.lit(turn)), F.lit(max(1, sum(free))))
        lot = F.size(F.filter(F.array(*[F.lit(x) for x in accumulate(free)]), lambda e: e <= draw))
        most = max(range(len(free)), key=free.__getitem__)
        other = F.when(F.element_at(room, F.least(lot, F.lit(len(free) - 1)) + 1) >= F.col("n"), lot).when(F.lit(free[most]) >= F.col("n"), F.lit(most))
        asked = pending.withColumn("shard", F.coalesce(best, other)).where("shard is not null").withColumn("one", F.lit(0))
        asked = materialize(asked, "shard-asked")
        # Rows that are admitted before: of larger communities, then of equally large ones by hash.
        before = Window.partitionBy("shard").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
        larger = asked.groupBy("shard", "n").agg(F.sum("n").alias("rows")).select("shard", "n", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("larger"))
        order = ranked(asked, ["shard", "n"], ["one"], _bucket("c"), ["c"], "at").join(materialize(larger, "shard-larger"), ["shard", "n"])
        limit = F.element_at(room, F.col("shard") + 1)
        order = materialize(order.select("c", "n", "pulls", "shard", (F.col("larger") + F.col("at") * F.col("n") <= limit).alias("in")), "shard-round")
        for r in order.where("in").groupBy("shard").agg(F.sum("n").alias("n")).collect():
            free[r.shard] -= r.n
        placed.append(order.where("in").select("c", "shard"))
        pending, turn = order.where("not in").select("c", "n", "pulls"), turn + 1
        if not pending.head(1):
            return placed


def shard(docs: DataFrame, shards=24, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of `docs`.

    size: UTF-8 bytes plus 8; a null text has no bytes and the checksum of the empty text, and is linked to
    other null texts. Repeated rows are documents of their own. An empty table gives an empty result.
    Other columns are ignored. Counts per shard, and LARGE communities a shard at most, reach the driver.
    """
    text = F.col(text_col)
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.coalesce(F.md5(text.cast("binary")), F.lit("null")).alias("g"),
    )
    base = materialize(base.withColumn("start", _bucket("doc_id", "text_crc32", n=shards)), "shard-base")
    total = base.count()
    free = [total // shards + (s < total % shards) for s in range(shards)]
    whole = max(1, total // shards)
    groups = materialize(base.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shard-groups")
    linked = materialize(_communities(base, groups, whole), "shard-linked")
    counts = linked.groupBy("c", "start").agg(F.count(F.lit(1)).alias("m"))
    pull = materialize(counts.groupBy("c").agg(F.sum("m").alias("n"), F.collect_list(F.struct("m", "start")).alias("pulls")), "shard-pull")
    placed = docs.sparkSession.createDataFrame(_place_large(pull.where(F.col("n") * LARGE > whole), free), "c string, shard int")
    for more in _propagate(pull.where(F.col("n") * LARGE <= whole), free):
        placed = placed.unionByName(more)
    linked = linked.join(materialize(placed, "shard-placed"), "c", "left")
    linked = Scratch(linked.select("doc_id", "size", "text_crc32", "c", "shard"), "shard-moved")
    # What is left of a community stays together as far as the order of filling allows.
    pool = base.join(groups, "g", "left_anti").select("doc_id", "size", "text_crc32", F.lit(1).alias("o"), F.lit("").alias("c"), _bucket("doc_id", "text_crc32").alias("b"))
    pool = pool.unionByName(linked.df.where("shard is null").select("doc_id", "size", "text_crc32", F.lit(0).alias("o"), "c", _bucket("c").alias("b")))
    pool = ranked(materialize(pool, "shard-pool"), [], ["o", "b"], F.col("c"), ["doc_id", "text_crc32"], "at")
    ends = F.array(*[F.lit(x) for x in accumulate(free)])
    pool = pool.withColumn("shard", F.size(F.filter(ends, lambda e: e < F.col("at"))).cast("int"))
    done = pool.select("doc_id", "size", "text_crc32", "shard").unionByName(linked.df.where("shard is not null").drop("c"))
    done = materialize(done, "shard-done").withColumn("b", _bucket("doc_id", "text_crc32"))
    done = ranked(done, ["shard"], ["b"], F.lit(""), ["doc_id", "text_crc32"], "at")
    return done.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("at") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
