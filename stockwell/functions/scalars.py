"""Scalar functions of the domain, as column expressions unless they need 64-bit wrapping arithmetic."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: SplitMix64 increment and multipliers, FNV-1a offset and prime.
GAMMA, MIX1, MIX2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
#: The share of the penalty below the objective.
EPSILON = 0.05


def padded(prefix: str, n: Column, width: int) -> Column:
    return F.concat(F.lit(prefix), F.lpad(n.cast("string"), width, "0"))


def number_of(name: Column) -> Column:
    return F.substring(name, 2, 64).cast("long")


def region(family: Column, entity: Column) -> Column:
    return F.concat_ws("|", family, entity)


def is_region(name: Column) -> Column:
    return name.rlike(r"^[PUR]\|.+")


def length_prefixed(name: Column) -> Column:
    return F.concat(F.length(name).cast("string"), F.lit(":"), name, F.lit(":"))


def json_key(*parts: Column) -> Column:
    return F.to_json(F.array(*[p.cast("string") for p in parts]))


def saturating_sub(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0), a - b)


def false_positive_rate(bits_per_key: Column) -> Column:
    k = F.greatest(F.lit(1.0), F.round(bits_per_key * float(np.log(2))))
    return F.when(bits_per_key <= 0, F.lit(1.0)).otherwise(F.pow(F.lit(0.5), k))


def penalty(x: Column, objective: Column) -> Column:
    """Linear up to EPSILON at the objective, then a rescaled sigmoid up to 1; continuous there."""
    over = 1 / (1 + F.exp(-(x - objective) / (objective / 2.0)))
    return F.when(x < objective, EPSILON * (x / objective)).otherwise(EPSILON + (1 - EPSILON) * (over - 0.5) / 0.5)


def log_linear(x: Column, points: list[tuple[float, float]]) -> Column:
    """Between measured points linear in log x; constant outside."""
    out = F.when(x <= points[0][0], F.lit(points[0][1]))
    for (a, ya), (b, yb) in zip(points, points[1:], strict=False):
        out = out.when(x <= b, ya + F.ln(x / a) / float(np.log(b / a)) * (yb - ya))
    return out.otherwise(F.lit(points[-1][1]))


def reject_reason(service: Column, lag: Column, saturated: Column, errors: Column) -> Column:
    said = F.concat_ws("+", F.when(service, "service_ceiling"), F.when(lag, "lag_ceiling"), F.when(saturated & ~lag, "lag_saturation"), F.when(errors, "errors"))
    return F.nullif(said, F.lit(""))


def big_endian(n: Column) -> Column:
    """The eight bytes of a bigint that is not negative; they sort as the number does."""
    return F.unhex(F.lpad(F.hex(n), 16, "0"))


def document_key(entity: Column, handle: Column, version: Column) -> Column:
    """P, entity, zero byte, handle, inverted version: sorts by entity and handle, the newest version first."""
    zero = F.unhex(F.lit("00"))
    return F.concat(F.lit("P").cast("binary"), entity.cast("binary"), zero, big_endian(handle), big_endian(F.lit(2**63 - 1) - version))


def merge_threshold(base: Column) -> Column:
    """Entries that a delta has when it is merged into a base."""
    return F.least(F.greatest(F.lit(1024), base), F.lit(200_000))


def region_cost(count: Column, mean_ns: Column, written: Column, rate: float) -> Column:
    """Service time plus the priced bytes that were written, in ns."""
    return count * mean_ns + F.lit(rate) * written


def deficit(slower: Column, own: Column) -> Column:
    return F.try_divide(slower.cast("double"), own.cast("double"))


def whole_if_whole(x: Column) -> Column:
    """A number as text, without a fraction if it has none."""
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))


#: Fixed value: the reflected polynomial of CRC-32C.
CRC32C = 0x82F63B78


def _crc_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(CRC32C), out >> 1)
    return out.astype(np.uint32)


@F.pandas_udf(T.LongType())
def crc32c(text: pd.Series) -> pd.Series:
    """CRC-32C of the UTF-8 bytes; null stays null. All rows of a batch go through their nth byte together."""
    table, data = _crc_table(), [b"" if t is None else t.encode() for t in text]
    sizes = np.array([len(d) for d in data], np.int64)
    flat, at = np.frombuffer(b"".join(data), np.uint8), np.cumsum(sizes) - sizes
    crc = np.full(len(data), 0xFFFFFFFF, np.uint32)
    rows = np.argsort(-sizes, kind="stable")
    for nth in range(int(sizes.max(initial=0))):
        rows = rows[: np.searchsorted(-sizes[rows], -nth, "left")]
        crc[rows] = table[(crc[rows] ^ flat[at[rows] + nth]) & 0xFF] ^ (crc[rows] >> np.uint32(8))
    return pd.Series((crc ^ np.uint32(0xFFFFFFFF)).astype(np.int64)).where(text.notna().to_numpy()).astype("Int64")


@F.pandas_udf(T.DecimalType(20, 0))
def split_mix(seed: pd.Series, nth: pd.Series) -> pd.Series:
    """The nth (from 1) output of SplitMix64 from a seed, unsigned."""
    from decimal import Decimal

    with np.errstate(over="ignore"):
        z = seed.to_numpy().astype(np.int64).view(np.uint64) + nth.to_numpy().astype(np.uint64) * np.uint64(GAMMA)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(MIX1)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(MIX2)
        z = z ^ (z >> np.uint64(31))
    return pd.Series([Decimal(int(x)) for x in z])


@F.pandas_udf(T.DecimalType(20, 0))
def fnv1a(text: pd.Series) -> pd.Series:
    """FNV-1a of the UTF-8 bytes, 64 bits, unsigned; null stays null. All rows of a batch go through their nth byte together."""
    from decimal import Decimal

    data = [b"" if t is None else t.encode() for t in text]
    sizes = np.array([len(d) for d in data], np.int64)
    flat, at = np.frombuffer(b"".join(data), np.uint8).astype(np.uint64), np.cumsum(sizes) - sizes
    h = np.full(len(data), FNV_OFFSET, np.uint64)
    rows = np.argsort(-sizes, kind="stable")
    for nth in range(int(sizes.max(initial=0))):
        rows = rows[: np.searchsorted(-sizes[rows], -nth, "left")]
        h[rows] = (h[rows] ^ flat[at[rows] + nth]) * np.uint64(FNV_PRIME)
    return pd.Series([None if t is None else Decimal(x) for t, x in zip(text, h.tolist(), strict=True)], dtype=object)
