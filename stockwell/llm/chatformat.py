"""Chat formatting with cumulative-snapshot collapse.

Loggers often store a conversation again after each turn. Rolling hashes over the turns, position by
position, give every prefix of a conversation an identity; a conversation whose whole is a proper prefix
of another one, or the repeat of one with a smaller id, is dropped by anti-joins, and only maximal
conversations are rendered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BEGIN, END = "<|im_start|>", "<|im_end|>"


def _turn_text(role, text):
    """A turn as rendered. Markers inside a text lose their bar characters, so that no text can end its turn."""
    clean = lambda c: F.replace(F.replace(c, F.lit(BEGIN), F.lit("<im_start>")), F.lit(END), F.lit("<im_end>"))
    return F.concat(F.lit(BEGIN), clean(F.coalesce(role, F.lit("unknown"))), F.lit("\n"), clean(F.coalesce(text, F.lit(""))), F.lit(END + "\n"))


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id, turns: the conversations that are kept. `turns`: conv_id, at (1-based position), item (what a turn is compared by)."""
    cell = lambda seed: F.xxhash64(F.lit(seed), "at", "item").cast("decimal(38,0)")
    so_far = Window.partitionBy("conv_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    # Sums of position-dependent hashes: a prefix of k turns has the same sums wherever it occurs.
    prefixes = turns.select("conv_id", "at", F.sum(cell(1)).over(so_far).alias("h1"), F.sum(cell(2)).over(so_far).alias("h2"), F.lead("at").over(Window.partitionBy("conv_id").orderBy("at")).isNull().alias("whole"))
    wholes = prefixes.where("whole").groupBy("h1", "h2", "at").agg(F.min("conv_id").alias("conv_id"))
    proper = prefixes.where("not whole").select("h1", "h2", "at").distinct()
    return wholes.join(proper, ["h1", "h2", "at"], "left_anti").select("conv_id", F.col("at").cast("long").alias("turns"))


def collapse(conversations: DataFrame) -> DataFrame:
    """conv_id, turns, rendered: one row per maximal conversation of `conversations` (conv_id, turn, role, text).

    Turns are in order of (turn, role, text), nulls first; repeated rows are turns of their own. A null
    role or text is compared as such and rendered as `unknown` and as an empty text. Rows with a null
    conv_id are one conversation, which counts as larger than all others. An empty table gives an empty
    result. Other columns are ignored.
    """
    rows = conversations.select("conv_id", "turn", "role", "text")
    by = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    item = F.concat_ws("|", F.coalesce(F.length("role"), F.lit(-1)).cast("string"), "role", F.coalesce(F.length("text"), F.lit(-1)).cast("string"), "text")
    turns = rows.select("conv_id", F.row_number().over(by).alias("at"), item.alias("item"), _turn_text(F.col("role"), F.col("text")).alias("said"))
    kept = maximal(turns.select("conv_id", "at", "item"))
    parts = turns.select("conv_id", "at", "said").join(kept.withColumnRenamed("conv_id", "id"), F.col("conv_id").eqNullSafe(F.col("id")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "said"))), lambda s: s["said"]), "")
    return parts.groupBy("conv_id").agg(F.first("turns").alias("turns"), text.alias("rendered"))


ORACLE = f"""
WITH t AS (
  SELECT conv_id, turn, role, text, coalesce(len(role), -1) || '|' || coalesce(role, '') || '|' || coalesce(len(text), -1) || '|' || coalesce(text, '') AS item,
         '{BEGIN}' || replace(replace(coalesce(role, 'unknown'), '{BEGIN}', '<im_start>'), '{END}', '<im_end>') || chr(10)
         || replace(replace(coalesce(text, ''), '{BEGIN}', '<im_start>'), '{END}', '<im_end>') || '{END}' || chr(10) AS said
  FROM conversations),
c AS (
  SELECT conv_id, list(md5(item) ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS items,
         string_agg(said, '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS rendered FROM t GROUP BY conv_id),
proper AS (SELECT DISTINCT array_to_string(list_slice(items, 1, k), ',') AS p FROM (SELECT items, unnest(range(1, len(items))) AS k FROM c)),
firsts AS (SELECT array_to_string(items, ',') AS p, min(conv_id) AS conv_id FROM c GROUP BY 1)
SELECT c.conv_id, len(c.items)::BIGINT AS turns, c.rendered FROM c JOIN firsts f ON c.conv_id IS NOT DISTINCT FROM f.conv_id
WHERE f.p NOT IN (SELECT p FROM proper)
"""
