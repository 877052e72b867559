"""Improbable-feature digests of documents.

Every window of some bytes has a collision entropy, -log2 of the chance that two of its bytes are equal. How
rare each entropy level is in the whole corpus ranks the windows; a window that is the rarest of many runs of
neighbours is a feature. Features go into a chain of Bloom filters, and two digests are compared filter by
filter by their common bits, normalised between chance and identity.

Texts of 256 bytes or more have features of 64 bytes. Shorter ones would have hardly any, so texts of up to
512 bytes have features of 12 bytes. Those between have both, in filters of their own, so that texts meet in
one kind or the other unless one is over twice as long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stockwell.llm.common import materialize

FILTER_BITS, FILTER_FEATURES, HASHES = 2048, 160, 5
CHUNK = 1 << 18


@dataclass(frozen=True)
class Scale:
    """Features of `window` bytes, of texts of `least` to `most` bytes."""

    window: int
    #: Neighbours in a run, a power of two, and the runs that a window must win to be a feature.
    run: int
    popular: int
    #: Windows with more equal pairs of bytes say nothing.
    most_equal: int
    least: int
    most: int

    @property
    def levels(self) -> int:
        """Entropy levels: the possible numbers of equal pairs of bytes in a window."""
        return self.window * (self.window - 1) // 2 + 1

    def takes(self, text: bytes) -> bool:
        return max(self.least, self.window) <= len(text) <= self.most


COARSE = Scale(window=64, run=64, popular=16, most_equal=1000, least=256, most=1 << 62)
FINE = Scale(window=12, run=8, popular=2, most_equal=33, least=0, most=512)
SCALES = (COARSE, FINE)

Ranks = tuple[np.ndarray, ...]  # of the levels of each scale


def equal_pairs(x: np.ndarray, window: int) -> np.ndarray:
    """For each window of x (uint8, at least a window long) its number of pairs of equal bytes, in window - 1 passes over x."""
    ahead, behind = np.zeros(len(x), np.uint8), np.zeros(len(x), np.uint8)
    for lag in range(1, window):
        same = (x[lag:] == x[:-lag]).view(np.uint8)
        ahead[:-lag] += same
        behind[lag:] += same
    change = behind[window:].astype(np.int32) - ahead[: len(x) - window]
    return np.concatenate([[0], np.cumsum(change)]) + int(behind[:window].sum(dtype=np.int64))


def _chunks(texts: list[bytes], some: list[int]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """(numbers of texts out of `some`, their joint bytes, where each begins), CHUNK bytes or one text at a time."""
    part, size = [], 0
    for i in some:
        part.append(i)
        size += len(texts[i])
        if size >= CHUNK or i == some[-1]:
            yield part, np.frombuffer(b"".join(texts[j] for j in part), np.uint8), np.cumsum([0, *(len(texts[j]) for j in part)])
            part, size = [], 0


def level_counts(texts: list[bytes], scale: Scale) -> np.ndarray:
    """How many windows of all texts, short and long, have each level."""
    total = np.zeros(scale.levels, np.int64)
    for _, x, at in _chunks(texts, [i for i, t in enumerate(texts) if len(t) >= scale.window]):
        pairs = equal_pairs(x, scale.window)
        crosses = np.zeros(len(pairs) + 1, bool)
        for b in at[1:-1].tolist():
            crosses[max(0, b - scale.window + 1) : b] = True
        total += np.bincount(pairs[~crosses[:-1]], minlength=scale.levels)
    return total


def rarity(counts: np.ndarray, scale: Scale) -> np.ndarray:
    """The rank of each level: the least frequent first, equal ones by level, levels that say nothing last."""
    level = np.arange(scale.levels)
    ranks = np.empty(scale.levels, np.int64)
    ranks[np.lexsort((level, counts, level > scale.most_equal))] = level
    return ranks


def _features(texts: list[bytes], ranks: np.ndarray, scale: Scale) -> list[list[bytes]]:
    """The features of each text that the scale takes; none of the others."""
    out: list[list[bytes]] = [[] for _ in texts]
    for some, x, at in _chunks(texts, [i for i, t in enumerate(texts) if scale.takes(t)]):
        pairs = equal_pairs(x, scale.window)
        best = key = (ranks[pairs] << 32) + np.arange(len(pairs))
        step = 1
        while step < scale.run:
            if len(best) > step:
                best = np.minimum(best[:-step], best[step:])
            step *= 2
        data = x.tobytes()
        wins = np.zeros(len(x) + 1, np.int64)
        bounds = list(zip(some, at[:-1].tolist(), at[1:].tolist(), strict=True))
        for _, lo, hi in bounds:
            windows = hi - lo - scale.window + 1
            if windows >= scale.run:
                runs = best[lo : lo + windows - scale.run + 1] & 0xFFFFFFFF
                wins[lo : lo + windows] += np.bincount(runs - lo, minlength=windows)
            else:
                wins[lo + int(key[lo : lo + windows].argmin())] = scale.popular
        told = pairs <= scale.most_equal
        chosen = np.flatnonzero((wins[: len(pairs)] >= scale.popular) & told)
        cut = np.searchsorted(chosen, at)
        for (i, _, _), a, b in zip(bounds, cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            out[i] = [data[s : s + scale.window] for s in chosen[a:b].tolist()]
    return out


Digest = list[tuple[int, int]]  # (features, bits of the filter) in order


def digests(texts: list[bytes], ranks: Ranks) -> list[Digest]:
    """A text without any feature, as one shorter than a window, is one feature itself; an empty one has no filter."""
    out = []
    for text, *kinds in zip(texts, *(_features(texts, r, scale) for r, scale in zip(ranks, SCALES, strict=True)), strict=True):
        chain = []
        for features in kinds if any(kinds) else [[text] if text else []]:
            for lo in range(0, len(features), FILTER_FEATURES):
                part = features[lo : lo + FILTER_FEATURES]
                raw = np.frombuffer(b"".join(xxhash.xxh3_128_digest(f) for f in part), "<u2").reshape(len(part), 8)[:, :HASHES]
                bits = np.zeros(FILTER_BITS, np.uint8)
                bits[raw.ravel() % FILTER_BITS] = 1
                chain.append((len(part), int.from_bytes(np.packbits(bits).tobytes(), "big")))
        out.append(chain)
    return out


def render(digest: Digest) -> bytes:
    """One byte for the features and FILTER_BITS / 8 bytes per filter; its hex digits are the fingerprint."""
    return b"".join(bytes([n]) + bits.to_bytes(FILTER_BITS // 8, "big") for n, bits in digest)


def likeness(a: Digest, b: Digest) -> float:
    """0 to 1: for each filter of the shorter chain the best normalised overlap in the other, by features."""
    if not a or not b:
        return float(a == b)
    if a == b:
        return 1.0
    short, long = sorted((a, b), key=len)
    sizes = [x.bit_count() for _, x in long]
    total = 0.0
    for n, x in short:
        own, best = x.bit_count(), 0.0
        for (_, y), size in zip(long, sizes, strict=True):
            chance, most = own * size / FILTER_BITS, min(own, size)
            low = chance + 0.3 * (most - chance)
            if most > low:
                best = max(best, ((x & y).bit_count() - low) / (most - low))
        total += n * min(1.0, max(0.0, best))
    return total / sum(n for n, _ in short)


def fit_rarity(docs: DataFrame, text_col="text") -> Ranks:
    """Ranks of the entropy levels over every window of every text; one sum per level reaches the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros(scale.levels, np.int64) for scale in SCALES]
        for part in _small(batches):
            texts = [t.encode() for t in part.column(0).to_pylist()]
            for total, scale in zip(totals, SCALES, strict=True):
                total += level_counts(texts, scale)
        for k, total in enumerate(totals):
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(some), pa.int32()), pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["scale", "level", "n"])

    rows = docs.select(F.col(text_col).alias("text")).where("text is not null")
    counts = [np.zeros(scale.levels, np.int64) for scale in SCALES]
    for r in rows.mapInArrow(count, "scale int, level long, n long").groupBy("scale", "level").agg(F.sum("n").alias("n")).collect():
        counts[r.scale][r.level] = r.n
    return tuple(rarity(c, scale) for c, scale in zip(counts, SCALES, strict=True))


def edit(text: str, following: str) -> str:
    """The last quarter of a text replaced by the first as many code points of the next one, or all it has."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _small(batches: Iterator[pa.RecordBatch], rows: int = 128) -> Iterator[pa.RecordBatch]:
    """Batches in slices, so that few texts at a time are Python objects."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


_FIELDS = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def _compare(ids: list, texts: list[str], last: str, ranks: Ranks) -> list[list]:
    """Columns of _FIELDS for documents in a row, the last one followed by the text `last`."""
    edited = [edit(t, n).encode() for t, n in zip(texts, [*texts[1:], last], strict=True)]
    own = digests([*(t.encode() for t in texts), last.encode()], ranks)
    changed = digests(edited, ranks)
    return [
        ids, [len(t) for t in texts], [hashlib.sha256(e).hexdigest() for e in edited], [render(d) for d in own[:-1]], [render(d) for d in changed],
        [likeness(a, b) for a, b in zip(own, changed, strict=False)], [likeness(a, b) for a, b in zip(own, own[1:], strict=False)],
    ]


def edited_likeness(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row of `docs`.

    The next document follows in ascending order of (doc_id, null ids last; then a hash of the text); the
    first follows the last, itself if alone. Null texts are empty. Repeated rows stay. An empty table gives
    an empty result. Other columns are ignored. Range partitions are gone through in order; the
    last row of each meets the first of the next one that has rows by a join of one row per partition.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(fit_rarity(docs, text_col))

    fields = [*_FIELDS, ("text", pa.string()), ("kind", pa.int32()), ("pid", pa.int32())]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """kind 0: results; 1: the partition's first document; 2: its last one, which waits for the next partition."""
        pid, held = TaskContext.get().partitionId(), None

        def batch(columns: list[list], kind: int) -> pa.RecordBatch:
            n = len(columns[0])
            columns = [*columns, *([[None] * n] if len(columns) == len(_FIELDS) else []), [kind] * n, [pid] * n]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])

        def edge(kind: int, i, t: str) -> pa.RecordBatch:
            return batch([[i], *[[None]] * (len(_FIELDS) - 1), [t]], kind)

        for part in _small(batches):
            ids, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
            if held is None:
                yield edge(1, ids[0], texts[0])
            else:
                ids, texts = [held[0], *ids], [held[1], *texts]
            if len(ids) > 1:
                yield batch(_compare(ids[:-1], texts[:-1], texts[-1], ranks.value), 0)
            held = ids[-1], texts[-1]
        if held is not None:
            yield edge(2, *held)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _small(batches, 1):
            i, t, following = (c.to_pylist() for c in part.columns)
            columns = _compare(i, t, following[0], ranks.value)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, _FIELDS, strict=True)], [n for n, _ in _FIELDS])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = rows.withColumn("x", F.xxhash64("text"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("x")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    made = materialize(ordered.mapInArrow(walk, f"{_OUT}, text string, kind int, pid int"), "digests")
    heads = made.where("kind = 1").select("pid", F.col("text").alias("following"))
    pids = heads.select("pid")
    wrap = F.first("pid").over(Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    follows = pids.select(F.col("pid").alias("tail"), F.coalesce(F.lead("pid").over(Window.orderBy("pid")), wrap).alias("pid"))
    tails = made.where("kind = 2").select("doc_id", "text", F.col("pid").alias("tail")).join(follows, "tail").join(heads, "pid")
    last = tails.select("doc_id", "text", "following").mapInArrow(finish, _OUT)
    done = made.where("kind = 0").select(*last.columns).unionByName(last)
    return done.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})
