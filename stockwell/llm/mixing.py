"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies, target / source size. Prefix sums of
it over the source's documents, shifted by one random offset per source, cross as many integer
boundaries as the document is emitted times. Documents are ordered by size first, so that every size is
sampled at the same rate and the words taken stay close to the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stockwell.llm.common import WORD, materialize, ranked

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
SEED = "mix-1"


def source_targets(sized: DataFrame, weights=WEIGHTS, most=MOST_COPIES) -> DataFrame:
    """One row per source: source, source_size, target.

    Sources in code point order, null last, take `weights` in turn and share the total size by them; a
    target stops at `most` times its source's size and the excess goes to the others by weight. The
    fixed point is found at once: sources sorted by cap per weight are capped up to the first whose
    cap exceeds its share of what is left. There is one row per source here, never one per document.
    """
    by = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    at = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((at - 1) % len(weights) + 1).cast("int"))
    by = by.withColumn("w", weight).withColumn("cap", F.col("source_size") * float(most))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    by = by.withColumn("share", left / F.sum("w").over(rest)).withColumn("capped", F.col("cap") / F.col("w") <= F.col("share"))
    level = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("w"), F.col("share").alias("share")))).over(everything)["share"]
    return by.select("source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(level * F.col("w")).alias("target"))


def mix(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", seed=SEED, weights=WEIGHTS, most=MOST_COPIES, row: Column | None = None) -> DataFrame:
    """doc_id, size, source, source_size, target, copies, taken for every row of `docs`, and `row` if given, an expression over `docs`.

    Null texts have size 0; a null source is a source of its own, last in order; documents of a source
    without words get no copies. Rows with equal doc_id and size are numbered in any order, which changes
    no total. An empty table gives an empty result. Other columns are ignored.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    carried = [] if row is None else [row.alias("row")]
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), *carried)
    sized = materialize(sized, "mix-sizes")
    text_id = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    keyed = sized.withColumn("skey", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")))
    rows = ranked(keyed, ["skey"], ["size"], F.substring(F.md5(text_id), 1, 3), ["doc_id"], "at")
    name = F.concat(F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")), F.lit(seed))
    targets = source_targets(sized, weights, most).select(
        F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("skey"), "source_size", "target",
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("rate"),
        (F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)).alias("u"),
    )
    cross = lambda k: F.floor(k * F.col("rate") + F.col("u"))
    copies = (cross(F.col("at")) - cross(F.col("at") - 1)).cast("int")
    return rows.join(targets, "skey").select("doc_id", "size", "source", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"), *(["row"] if carried else []))


def emit(docs: DataFrame, id_col="doc_id", **options) -> DataFrame:
    """The mix itself: each row of `docs` as many times as mix() has copies of it. Rows equal in all columns share theirs."""
    row = F.struct(F.col(id_col).alias("id"), F.xxhash64(*docs.columns).alias("x"), F.xxhash64(F.lit(1), *docs.columns).alias("y"))
    copies = mix(docs, id_col, row=row, **options).where("copies > 0").groupBy("row").agg(F.sum("copies").cast("int").alias("copies"))
    rows = docs.select(row.alias("row"), F.struct(*docs.columns).alias("doc")).join(copies, "row").dropDuplicates(["row"])
    return rows.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc.*")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
by_source AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source ASC NULLS LAST)) - 1) % 3 + 1]::DOUBLE AS w,
         source_size * 3.0::DOUBLE AS cap FROM by_source),
shared AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, source ASC NULLS LAST
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
         / sum(w) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share
  FROM weighted),
level AS (SELECT arg_min(share, cap / w) AS level FROM shared WHERE NOT cap / w <= share),
targets AS (
  SELECT source, source_size, CASE WHEN cap / w <= share THEN cap ELSE (SELECT level FROM level) * w END AS target,
         ('0x' || substr(md5(coalesce('s' || source, 'n') || 'mix-1'), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u
  FROM shared),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 3), doc_id) AS n
  FROM sized),
rated AS (
  SELECT n.doc_id, n.size, t.source_size, t.target, n.n, t.u,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END::DOUBLE AS rate
  FROM numbered n JOIN targets t ON n.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, ((floor(n * rate + u) - floor((n - 1) * rate + u)) * size)::BIGINT AS taken FROM rated
"""
