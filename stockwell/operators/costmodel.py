"""The service-time model of page size and filter bits, the score of a layout, and placement of keys in tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stockwell.functions import scalars

#: Fixed values, measured on the device: microseconds of a dependent read by page size, of a batched read, of a filter
#: check; MiB/s of the device; the share of it that a scan of 4 KiB pages reaches.
DEPENDENT_US = [(4096.0, 96.3), (16384.0, 117.4), (65536.0, 185.8)]
BATCHED_US, CHECK_US, DEVICE_MIB_S, SCAN_SHARE = 4.9, 0.15, 831.0, 605.0 / 831.0
#: How much a tail exceeds a mean, an objective the tail of the layout in use, and that layout.
TAIL, INFLATION, IN_USE = 1.26, 2.0, (4096, 10)
#: Name, share, dependent reads, parallel reads, bytes, probes filters, scans.
PATTERNS = [
    ("order_create", 0.25, 3, 4, 4096, True, False),
    ("order_by_no", 0.30, 2, 0, 2048, True, False),
    ("stock_by_sku", 0.30, 2, 0, 2048, True, False),
    ("movements_scan", 0.15, 0, 0, 524288, False, True),
]
#: The layouts that are compared, and the write amplification of the one in use.
PAGES, BITS, WRITE_AMP = (4096, 16384, 65536), (0, 10, 14), 3.92


def service_us(pattern: tuple, page: Column, bits: Column, tiles: Column, gain: Column) -> Column:
    """Microseconds of a request of a pattern: dependent and batched reads, the transfer of a scan, filter probes of all tiles."""
    _, _, dependent, parallel, size, probes, scans = pattern
    read = scalars.log_linear(page.cast("double"), DEPENDENT_US)
    out = dependent * read + F.lit(-(-parallel // 32) * BATCHED_US)
    if scans:
        share = F.when(page <= 4096, F.lit(SCAN_SHARE)).otherwise(F.least(F.lit(1.0), SCAN_SHARE * F.pow(gain, F.log2(page / 4096))))
        out = out + F.lit(size / (1024 * 1024) * 1e6) / (DEVICE_MIB_S * share)
    if probes:
        out = out + tiles * (CHECK_US + scalars.false_positive_rate(bits.cast("double")) * read)
    return out


def score(page: Column, bits: Column, tiles: Column, gain: Column) -> Column:
    """The weighted penalty of the patterns' tails against objectives set by the layout in use. 0 is best, 1 worst."""
    total = F.lit(0.0)
    for p in PATTERNS:
        objective = INFLATION * TAIL * service_us(p, F.lit(IN_USE[0]), F.lit(IN_USE[1]), tiles, gain)
        total = total + p[1] * scalars.penalty(TAIL * service_us(p, page, bits, tiles, gain), objective)
    return total


def headroom(loads: DataFrame, keys: list[str], tiles: str, gain: str) -> DataFrame:
    """keys, page, bits, score, gain_pct against the layout in use, rank: every layout under every load of `loads`."""
    layouts = F.array(*[F.struct(F.lit(p).alias("page"), F.lit(b).alias("bits")) for p in PAGES for b in BITS])
    rows = loads.withColumn("base", score(F.lit(IN_USE[0]), F.lit(IN_USE[1]), F.col(tiles), F.col(gain)))
    rows = rows.select("*", F.inline(layouts)).withColumn("score", score(F.col("page"), F.col("bits"), F.col(tiles), F.col(gain)))
    rows = rows.withColumn("gain_pct", (F.col("base") - F.col("score")) / F.col("base") * 100).withColumn("score", F.round("score", 9))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("score", "page", "bits")).cast("long")  # nine rows each
    return rows.select(*keys, "page", "bits", "score", F.round("gain_pct", 6).alias("gain_pct"), rank.alias("rank"))


def breakeven(loads: DataFrame, keys: list[str], tiles: str, gain: str, weight: float, shares: list[float]) -> DataFrame:
    """keys, share, write_amp, gain_pct: what keeping a slow family of bytes apart saves in all, if it is never rewritten."""
    base = score(F.lit(IN_USE[0]), F.lit(IN_USE[1]), F.col(tiles), F.col(gain))
    best = score(F.lit(4096), F.lit(14), F.col(tiles), F.col(gain))
    rows = loads.select(*keys, base.alias("base"), best.alias("best"), F.explode(F.array(*[F.lit(s) for s in shares])).alias("share"))
    amp = F.lit(WRITE_AMP) * (1 - F.col("share"))
    before, after = F.col("base") + weight * WRITE_AMP, F.col("best") + weight * amp
    return rows.select(*keys, "share", F.round(amp, 9).alias("write_amp"), F.round((before - after) / before * 100, 6).alias("gain_pct"))


def ranked_keys(keys: DataFrame, order: list, buckets: Column, out: str) -> DataFrame:
    """0-based position of each key in a total order whose first part is `buckets`, a column that few keys share: counts of
    buckets are prefix-summed and keys numbered within one."""
    rows = keys.withColumn("_b", buckets)
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = rows.groupBy("_b").agg(F.count(F.lit(1)).alias("_n")).select("_b", before.alias("_off"))
    number = F.row_number().over(Window.partitionBy("_b").orderBy(*order))
    return rows.join(offsets, "_b").withColumn(out, F.col("_off") + number - 1).drop("_b", "_off")
