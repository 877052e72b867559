"""Substring dedup: windows of consecutive words that also start in an earlier document go.

Pass 1 builds one count-min sketch per stored part of the texts, as a list of what it counts, and merges the
sketches block by block. Counters of a part saturate at two, which is all the question needs. A block has a
fixed size, and there are as many as the texts ask for, so the estimates are as good at every size. Each
block tells each part which of its entries are estimated at two or more. What is counted for a window is its anchor: of the 7-word grams
inside the window the one with the smallest hash. Equal windows have equal anchors, so the count of an
anchor, and the sketch's overestimate of it, is never below the count of a window: no repeated window is
lost, while neighbouring windows mostly share their anchors and a quarter of the positions is counted.
Pass 2 groups only the windows whose anchors the sketch estimates at two or more, exactly, by 96-bit
hashes of their word sequences.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockwell.llm.common import Scratch, materialize, release

WINDOW = 13
GRAM = 7
#: Characters of texts that are stored as one part, and entries of one block of the sketch, both about.
PART_CHARS, BLOCK_ENTRIES = 8_000_000, 1 << 19
ROWS = 2
#: Cells of a row of the sketch for each entry.
CELLS = 8

_POWERS = [np.cumprod(np.full(WINDOW, m, np.uint64)) for m in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)]


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    x = (x ^ np.uint64(seed)) * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(29))


def word_hashes(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter(map(digest, words), np.uint64, len(words))


def _sums(a: np.ndarray, k: int, powers: np.ndarray) -> np.ndarray:
    n = len(a) - k + 1
    out = a[:n] * powers[0]
    for j in range(1, k):
        out += a[j : j + n] * powers[j]
    return out


def anchors(a: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each gram, for each window the position of its anchor: the leftmost smallest gram in it)."""
    grams = _mix(_sums(a, gram, _POWERS[0]), 1)
    inside = window - gram + 1
    n = len(a) - window + 1
    at, low = np.arange(n), grams[:n].copy()
    for j in range(1, inside):
        other = grams[j : j + n]
        less = other < low
        low[less] = other[less]
        at[less] = np.flatnonzero(less) + j
    return grams, at


def sketch_blocks(chars: int) -> int:
    """Bits of the number of blocks, 64 at least: a word has six characters or so and a quarter of the words is an anchor."""
    return max(6, int(np.ceil(np.log2(max(1, chars / 24 / BLOCK_ENTRIES)))))


def _entries(grams: np.ndarray, bits: int) -> np.ndarray:
    """The number of the block of each gram, and 32 more bits: what a part is told about."""
    return grams >> np.uint64(32 - bits)


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, str]]:
    for lo in range(0, batch.num_rows, 256):
        yield from enumerate(batch.column(column).slice(lo, 256).to_pylist(), lo)


def _sketches(batches: Iterator[pa.RecordBatch], window: int, gram: int, bits: int) -> Iterator[pa.RecordBatch]:
    """(block, g, once, twice) of every part g in batches of (g, text): the entries that it counts once, and twice or more."""

    def told(g: int, found: list[np.ndarray]) -> pa.RecordBatch:
        entries, n = np.unique(np.concatenate(found), return_counts=True)
        rows = []
        block = (entries >> np.uint64(32)).astype(np.int64)
        starts = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
        low = (entries & np.uint64(0xFFFFFFFF)).astype("<u4")
        for lo, hi in zip(starts, [*starts[1:], len(entries)], strict=True):
            many = n[lo:hi] > 1
            rows.append((int(block[lo]), g, low[lo:hi][~many].tobytes(), low[lo:hi][many].tobytes()))
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)]
        return pa.RecordBatch.from_arrays(columns, ["block", "g", "once", "twice"])

    part, found = None, []
    for batch in batches:
        parts = batch.column(0).to_pylist()
        for k, text in _texts(batch, 1):
            if parts[k] != part:
                if found:
                    yield told(part, found)
                part, found = parts[k], []
            words = text.encode().split()
            if len(words) >= window:
                grams, at = anchors(word_hashes(words), window, gram)
                found.append(_entries(grams[np.unique(at)], bits))
    if found:
        yield told(part, found)


def _merge(table: pa.Table) -> pa.Table:
    """The sketches of one block merged: (g, block, entries), the entries of each part that are estimated at two or more."""
    lists = [[np.frombuffer(x, "<u4") for x in table.column(c).to_pylist()] for c in ("once", "twice")]
    entries, weights = np.concatenate([*lists[0], *lists[1]]), np.repeat([1, 2], [sum(map(len, x)) for x in lists])
    bits = max(4, int(np.ceil(np.log2(max(1, len(entries)) * CELLS))))
    cell = lambda x, row: (_mix(x.astype(np.uint64), 0x51ED270B + row) >> np.uint64(64 - bits)).astype(np.int64)
    rows = [np.minimum(np.bincount(cell(entries, r), weights, 1 << bits), 2).astype(np.uint8) for r in range(ROWS)]
    often = lambda x: x[np.min([c[cell(x, r)] for r, c in enumerate(rows)], axis=0) > 1] if len(x) else x
    out = [np.sort(np.concatenate([often(a), b])).tobytes() for a, b in zip(*lists, strict=True)]
    return pa.table({"g": table.column("g"), "block": table.column("block"), "entries": pa.array(out, pa.binary())})


def _candidates(texts: pa.Table, told: pa.Table, window: int, gram: int, bits: int) -> pa.Table:
    """h1, h2, d, x, pos of the windows of one part's texts (d, x, text) whose anchors are among its `told` entries."""
    often = [np.frombuffer(e, "<u4").astype(np.uint64) | np.uint64(b) << np.uint64(32) for b, e in zip(told.column("block").to_pylist(), told.column("entries").to_pylist(), strict=True)]
    often = np.unique(np.concatenate(often)) if often else np.zeros(0, np.uint64)
    h1, h2, row, pos = ([np.zeros(0, t)] for t in (np.int64, np.int32, np.int64, np.int32))
    for batch, lo in _numbered(texts):
        for k, text in _texts(batch, batch.schema.get_field_index("text")):
            words = text.encode().split()
            if len(words) < window or not len(often):
                continue
            a = word_hashes(words)
            grams, at = anchors(a, window, gram)
            entries = _entries(grams, bits)
            found = np.minimum(np.searchsorted(often, entries), len(often) - 1)
            where = np.flatnonzero((often[found] == entries)[at])
            if len(where):
                one, two = (_mix(_sums(a, window, p), 7)[where] for p in _POWERS)
                h1.append(one.view(np.int64))
                h2.append((two >> np.uint64(32)).astype(np.uint32).view(np.int32))
                row.append(np.full(len(where), lo + k))
                pos.append(where.astype(np.int32))
    at = pa.array(np.concatenate(row))
    return pa.table({"h1": np.concatenate(h1), "h2": np.concatenate(h2), "d": texts.column("d").take(at), "x": texts.column("x").take(at), "pos": np.concatenate(pos)})


def _numbered(table: pa.Table) -> Iterator[tuple[pa.RecordBatch, int]]:
    lo = 0
    for batch in table.to_batches():
        yield batch, lo
        lo += batch.num_rows


def repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col="doc_id", text_col="text", carry=()) -> DataFrame:
    """One row (doc_id, text, carried, starts, whole) per row of `docs`.

    starts: where windows begin whose word sequence also begins in a document with a smaller id (null if
    none do). whole: a smaller id has the same text, and every word goes if there is a window at all. A null
    text has no words; a null id counts as larger than all others; rows with equal ids are one document as
    far as "smaller" goes, each judged on its own text. Columns
    named in `carry` come along in the struct `carried`; others are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.struct(F.lit(0).alias("_"), *carry).alias("carried"))
    rows = rows.withColumns({"d": F.col("doc_id"), "x": F.xxhash64("text")})
    ids = materialize(rows.select("d", "x", F.md5(F.col("text").cast("binary")).alias("h"), F.length("text").alias("chars")), "sub-ids")
    firsts = ids.groupBy("h").agg(F.min("d").alias("first"), F.max("chars").alias("chars"), F.count(F.lit(1)).alias("n"))
    firsts = materialize(firsts, "sub-first")
    single_chars, texts = firsts.agg(F.sum("chars"), F.count(F.lit(1))).first()
    bits, part_rows = sketch_blocks(single_chars or 0), max(1, PART_CHARS * texts // max(1, single_chars or 0))
    # Null ids come after all others.
    after = lambda least: F.coalesce(F.col("d") > least, least.isNotNull())
    one = lambda a, b, *more: [a.d.eqNullSafe(b.d), *[a[c] == b[c] for c in more]]
    later = ids.join(firsts.where("n > 1").select("h", "first"), "h").where(after(F.col("first"))).select("d", "x", F.lit(True).alias("whole"))
    several = materialize(ids.groupBy("d").count().where("count > 1").select("d"), "sub-several")
    same = ids.join(several, one(ids, several), "left_semi").select("d", "x", F.lit(False).alias("whole"))
    notes = later.unionByName(same.withColumn("same", F.lit(True)), allowMissingColumns=True)
    notes = notes.groupBy("d", "x").agg(F.max("whole").alias("whole"), F.coalesce(F.max("same"), F.lit(False)).alias("same"))
    notes = materialize(notes, "sub-notes")
    flagged = rows.join(notes, one(rows, notes, "x"), "left").drop(notes.d, notes.x).withColumn("whole", F.coalesce("whole", F.lit(False)))
    # The hash of a text is part of a row's identity only where several rows have its id.
    flagged = flagged.withColumn("x", F.when(F.col("same"), F.col("x")).otherwise(F.lit(0))).drop("same")
    # g: the part a row is stored in.
    at = F.monotonically_increasing_id()
    part = F.shiftleft(F.shiftright(at, 33), 32) + F.floor(at.bitwiseAND(F.lit((1 << 33) - 1)) / F.lit(part_rows)).cast("long")
    flagged = materialize(flagged.withColumn("g", part), "sub-texts")
    release(docs.sparkSession)
    # Later copies are not looked into. An id's repeated rows with equal texts are: they give equal windows.
    single = flagged.where("not whole")
    id_type = dict(single.dtypes)["d"]
    sketches = single.select("g", "text").mapInArrow(lambda batches: _sketches(batches, window, gram, bits), "block int, g long, once binary, twice binary")
    told = materialize(sketches.groupBy("block").applyInArrow(_merge, "g long, block int, entries binary"), "sub-told")
    release(docs.sparkSession)
    met = single.select("g", "d", "x", "text").groupBy("g").cogroup(told.groupBy("g"))
    found = met.applyInArrow(lambda left, right: _candidates(left, right, window, gram, bits), f"h1 long, h2 int, d {id_type}, x long, pos int")
    found = Scratch(found, "sub-found")
    release(docs.sparkSession)
    least = found.df.groupBy("h1", "h2").agg(F.min("d").alias("least"), F.max("d").alias("most"), F.max(F.isnull("d")).alias("some"))
    least = Scratch(least.where("least < most or least is not null and some").select("h1", "h2", "least"), "sub-least")
    release(docs.sparkSession)
    hits = found.df.join(least.df, ["h1", "h2"]).where(after(F.col("least"))).groupBy("d", "x").agg(F.collect_set("pos").alias("starts"))
    hits = materialize(hits, "sub-hits")
    found.drop()
    least.drop()
    release(docs.sparkSession)
    done = flagged.join(hits, one(flagged, hits, "x"), "left")
    return done.select("doc_id", "text", "carried", "starts", "whole")


def kept_words(words: list[bytes], starts, whole: bool, window: int) -> list[bytes]:
    if len(words) < window:
        return words
    if whole:
        return []
    if starts is None or not len(starts):
        return words
    cover = np.zeros(len(words) + 1, np.int64)
    at = np.asarray(starts)
    np.add.at(cover, at, 1)
    np.add.at(cover, np.minimum(at + window, len(words)), -1)
    return [w for w, c in zip(words, np.cumsum(cover[:-1]).tolist(), strict=True) if not c]


def strip(docs: DataFrame, window: int = WINDOW, id_col="doc_id", text_col="text", carry=()) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, text and the columns of `carry` for every row of `docs`.

    text: the whole text where nothing goes, else the words kept, joined by one space. Nulls, ties and
    other columns as in repeats(). An empty table gives an empty result.
    """
    marked = repeats(docs, window, id_col=id_col, text_col=text_col, carry=carry)

    @F.pandas_udf("n_words long, n_removed long, kept_sha256 string, text string")
    def cut(texts: pd.Series, all_starts: pd.Series, wholes: pd.Series) -> pd.DataFrame:
        out = []
        for text, starts, whole in zip(texts, all_starts, wholes, strict=True):
            words = text.encode().split()
            kept = kept_words(words, starts, whole, window)
            line = b" ".join(kept)
            out.append((len(words), len(words) - len(kept), hashlib.sha256(line).hexdigest(), text if len(kept) == len(words) else line.decode()))
        return pd.DataFrame(out, columns=["n_words", "n_removed", "kept_sha256", "text"], dtype=object)

    done = marked.select("doc_id", "carried", cut("text", "starts", "whole").alias("r"))
    return done.select("doc_id", "r.*", *[F.col("carried")[c].alias(c) for c in carry])
