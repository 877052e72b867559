"""SentencePiece encoding and decoding over a relational lattice.

A text is cut into units between which no piece reaches. The bounded-length substrings of a unit are
exploded and joined to the piece table; the matches are the unit's edges, grouped by unit and folded with
a higher-order aggregate: for a unigram piece table by Viterbi, the best path by score. The tokenizer file at
hand is a BPE model: its result is not the best path but that of merging, so there the fold goes through the
edges by merge rank and joins the two pieces that an edge spans at that moment.

Frequent units, MOST_CACHED at most, are encoded once and sent to the executors as sorted 128-bit hashes
and ids. One pass over the texts turns them into packed ids with holes for all other units; those units
are dealt out beside their document's packed ids, go through the lattice there, and fill the holes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stockwell.llm.common import Scratch, materialize, release

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Each takes 17 bytes and its ids, about 35 MB in all.
MOST_CACHED = 1 << 20
#: Beginnings of pieces that tell how long a piece may get.
PREFIX = 4
#: Bytes of the texts that a worker goes through at a time, about, and units that it counts together.
CHUNK, COUNTED = 2 << 20, 500_000
#: Units of up to so many code points keep their boundaries in the bits of one bigint.
SHORT = 62


class Pieces:
    """A vocabulary: ids and scores of the pieces, ids of bytes (none without byte fallback) and of what is unknown.

    In a BPE model the scores are the negated ranks of the merges; other scores are those of a unigram model.
    """

    def __init__(self, ids: dict[str, int], scores: dict[str, float], of_bytes: dict[int, int], unknown: int, n: int):
        self.ids, self.scores, self.bytes, self.unknown, self.size = ids, scores, of_bytes, unknown, n
        self.unigram = any(s != int(s) for s in scores.values())
        #: What a code point that is no piece counts in a unigram model.
        self.penalty = min(scores.values(), default=0.0) - 10.0
        #: How ids are packed, and the number that stands for a unit that is not encoded yet.
        self.dtype = np.dtype("<u2" if n < 0xFFFF else "<u4")
        self.hole = int(np.iinfo(self.dtype).max)
        self._mark = f"[{''.join(map(re.escape, self._marks()))}]"
        self._unit = re.compile(rf"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")

    @classmethod
    def of_file(cls, path: str = MODEL) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        of_bytes = {int(model.id_to_piece(i)[1:-1], 16): i for i in range(n) if model.is_byte(i)}
        return cls({model.id_to_piece(i): i for i in plain}, {model.id_to_piece(i): model.get_score(i) for i in plain}, of_bytes, model.unk_id(), n)

    def _marks(self) -> list[str]:
        """Characters that no piece has after a letter. Pieces must not reach over a space after something else or a line feed."""
        marks = {c for c in map(chr, range(33, 127)) if not c.isalnum()}
        for p in self.ids:
            for a, b in zip(p, p[1:], strict=False):
                if a.isalpha():
                    marks.discard(b)
                if b == SPACE and a != SPACE or "\n" in (a, b):
                    raise ValueError(f"a piece reaches over the end of a unit: {p!r}")
        return sorted(marks)

    def table(self, spark: SparkSession) -> DataFrame:
        """piece, rank (1 is merged first), score: of a BPE model the pieces of two code points or more; at most as many rows as the vocabulary has."""
        several = sorted((p for p in self.ids if self.unigram or len(p) > 1), key=lambda p: (-self.scores[p], self.ids[p]))
        rows = pd.DataFrame({"piece": several, "rank": np.arange(1, len(several) + 1, dtype=np.int32), "score": [float(self.scores[p]) for p in several]})
        return spark.createDataFrame(rows, "piece string, rank int, score double")

    def ids_of(self, piece: str) -> list[int]:
        found = self.ids.get(piece)
        if found is not None:
            return [found]
        return [self.bytes[b] if b in self.bytes else self.unknown for b in piece.encode()] if self.bytes else [self.unknown]

    def texts(self) -> list[bytes]:
        """What each id stands for: nothing for control pieces and the unknown."""
        out = [b""] * self.size
        for p, i in self.ids.items():
            out[i] = p.replace(SPACE, " ").encode()
        for b, i in self.bytes.items():
            out[i] = bytes([b])
        return out

    def words(self, text: str) -> list[str]:
        """The words of a text, with the leading space that the model adds; joined they are the text. Empty: none.

        A word begins at the first of some spaces, at a line feed and after it.
        """
        if not text:
            return []
        if "  " in text or text[0] == " " or SPACE in text:
            return self._unit.findall(SPACE + text.replace(" ", SPACE))
        spaced = SPACE + text.replace(" ", " " + SPACE)
        return [w for w in spaced.replace("\n", " \n ").split(" ") if w] if "\n" in spaced else spaced.split(" ")

    def word_arrays(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray]]:
        """(rows, their words in a row, the number of words of each): words() of many texts, in two parts."""
        odd = pc.or_(pc.or_(pc.match_substring(texts, "  "), pc.match_substring(texts, SPACE)), pc.starts_with(texts, " "))
        odd = odd.to_numpy(zero_copy_only=False)
        for spaces in (False, True):
            rows = np.flatnonzero(odd == spaces)
            if not len(rows):
                continue
            some = texts.take(pa.array(rows))
            if spaces:
                marked = pc.replace_substring_regex(pc.replace_substring(some, " ", SPACE), f"({SPACE}+)", r" \1")
                marked = pc.if_else(pc.starts_with(marked, " "), pc.binary_join_element_wise(f" {SPACE}", pc.utf8_slice_codeunits(marked, 1), ""), pc.binary_join_element_wise(SPACE, marked, ""))
            else:
                marked = pc.if_else(pc.equal(some, ""), "", pc.binary_join_element_wise(SPACE, pc.replace_substring(some, " ", f" {SPACE}"), ""))
            lists = pc.split_pattern(pc.replace_substring(marked, "\n", " \n "), " ")
            words = lists.flatten()
            real = pc.not_equal(words, "")
            upto = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
            ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            yield rows, words.filter(real), np.diff(upto[ends])

    def unit_arrays(self, words: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The units of words in a row, and the number of each word's: one begins at each mark after a letter as well."""
        lists = pc.split_pattern(pc.replace_substring_regex(words, rf"(\p{{L}})({self._mark})", r"\1 \2"), " ")
        return lists.flatten(), np.diff(lists.offsets.to_numpy())

    def units(self, text: str) -> list[str]:
        return self.unit_arrays(pa.array(self.words(text), pa.string()))[0].to_pylist()


def _once(value: Column, use) -> Column:
    """use(value) with the value computed once, however often the lambda functions in `use` read it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def merge_fold(edges: Column, n: Column) -> Column:
    """Boundaries (array of int, 0 and n included) after merging, for n <= SHORT. edges: sorted array of pack()ed bigints.

    Merges happen in the order of their ranks, and from left to right: a merge of a lower rank than the last
    one cannot come up later, as the parts of a piece are pieces of lower ranks than itself. An edge joins
    if both its ends are boundaries and one boundary is between them. Boundaries are the bits of a bigint.
    """
    one = F.lit(1).cast("long")
    bit = lambda i: F.call_function("shiftleft", one, i)

    def step(m: Column, x: Column) -> Column:
        s = F.shiftright(x, 16).bitwiseAND(F.lit(0xFFFF)).cast("int")
        last = bit(x.bitwiseAND(F.lit(0xFFFF)).cast("int"))
        inner = m.bitwiseAND(last - bit(s + 1))
        joins = (F.bit_count(inner) == 1) & (m.bitwiseAND(last) != 0) & (m.bitwiseAND(bit(s)) != 0)
        return F.when(joins, m.bitwiseXOR(inner)).otherwise(m)

    mask = F.aggregate(edges, bit(n + 1) - 1, step)
    return _once(mask, lambda m: F.filter(F.sequence(F.lit(0), n), lambda i: m.bitwiseAND(bit(i)) != 0))


def pack(rank: Column, s: Column, e: Column) -> Column:
    return F.shiftleft(rank.cast("long"), 32) + F.shiftleft(s, 16) + e


def long_merge_fold(edges: Column, n: Column) -> Column:
    """The same for units of any length. edges: sorted array of (rank, s, e). Boundaries are a string of 0 and 1."""

    def step(m: Column, x: Column) -> Column:
        at = lambda i, size: F.substring(m, i + 1, size)
        width = x["e"] - x["s"] - 1
        joins = (at(x["s"], F.lit(1)) == "1") & (at(x["e"], F.lit(1)) == "1") & (F.length(F.replace(at(x["s"] + 1, width), F.lit("0"), F.lit(""))) == 1)
        return F.when(joins, F.overlay(m, F.repeat(F.lit("0"), width), x["s"] + 2)).otherwise(m)

    marks = F.aggregate(edges, F.repeat(F.lit("1"), n + 1), step)
    return _once(marks, lambda m: F.filter(F.sequence(F.lit(0), n), lambda i: F.substring(m, i + 1, F.lit(1)) == "1"))


def viterbi_fold(edges: Column) -> Column:
    """Boundaries of the path of the highest total score. edges: array of (e, s, score), sorted, one of each position at least.

    Ties go to the edge that starts first. The state is, per position, the best score and path so far.
    """
    start = F.array(F.struct(F.lit(0.0).alias("score"), F.array(F.lit(0)).alias("path")))

    def step(best: Column, x: Column) -> Column:
        before = F.element_at(best, x["s"] + 1)
        new = F.struct((before["score"] + x["score"]).alias("score"), F.concat(before["path"], F.array(x["e"])).alias("path"))
        known = F.size(best) > x["e"]
        better = F.when(new["score"] > F.element_at(best, -1)["score"], F.concat(F.slice(best, 1, F.size(best) - 1), F.array(new))).otherwise(best)
        return F.when(known, better).otherwise(F.concat(best, F.array(new)))

    return F.element_at(F.aggregate(edges, start, step), -1)["path"]


def lattice(rows: DataFrame, keys: list[str], pieces: DataFrame, penalty: float | None = None) -> DataFrame:
    """The edges of the units of `rows`: keys, n, rank, score, s, e, and in one row of each unit all other columns of `rows`.

    That row has no edge where the unit's first two code points are no piece, and where `unit` is null; units
    of one code point have no edges. With a `penalty` (unigram), every code point is an edge, of that score if it
    is no piece. The other columns are null in the other rows. Nothing is shuffled.
    """
    least = 2 if penalty is None else 1
    others = [c for c in rows.columns if c not in (*keys, "unit")]
    cut = rows.withColumn("n", F.length("unit"))
    cut = cut.select(*keys, "unit", "n", *others, F.explode_outer(F.when(F.col("n") > 1, F.sequence(F.lit(0), F.col("n") - least))).alias("s"))
    # No piece begins with a prefix that no piece has: few beginnings need all lengths looked up.
    prefix = F.substring(F.col("unit"), F.col("s") + 1, F.lit(PREFIX))
    reach = pieces.where(F.length("piece") >= PREFIX).groupBy(F.substring("piece", 1, PREFIX).alias("_prefix")).agg(F.max(F.length("piece")).alias("_reach"))
    cut = cut.withColumn("_prefix", prefix).join(F.broadcast(reach), "_prefix", "left")
    size = F.least(F.coalesce("_reach", F.lit(PREFIX - 1)), F.col("n") - F.col("s"))
    size = F.when(F.col("s").isNotNull(), F.sequence(F.lit(least), size))
    cut = cut.select(*keys, "unit", "n", *others, "s", F.explode_outer(size).alias("size"))
    cut = cut.withColumn("piece", F.substring(F.col("unit"), F.col("s") + 1, F.col("size")))
    first = F.col("s").isNull() | (F.col("s") == 0) & (F.col("size") == least)
    edges = cut.join(F.broadcast(pieces), "piece", "left")
    if penalty is not None:
        edges = edges.withColumn("score", F.coalesce("score", F.when(F.col("size") == 1, F.lit(penalty))))
    edges = edges.where(F.col("rank").isNotNull() | F.col("score").isNotNull() | first)
    return edges.select(*keys, "n", "rank", "score", "s", (F.col("s") + F.col("size")).alias("e"), *[F.when(first, F.col(c)).alias(c) for c in ["unit", *others]])


def encode_units(rows: DataFrame, keys: list[str], pieces: Pieces) -> DataFrame:
    """The rows of `rows`, keys being unique, with cuts: the boundaries of the pieces of `unit`; null where no merge applies to it."""
    others = [c for c in rows.columns if c not in keys]
    edges = lattice(rows, keys, pieces.table(rows.sparkSession), pieces.penalty if pieces.unigram else None)
    if pieces.unigram:
        path = F.when(F.col("score").isNotNull(), F.struct("e", "s", "score"))
        units = edges.groupBy(*keys).agg(F.array_sort(F.collect_list(path)).alias("path"), *[F.first(c, ignorenulls=True).alias(c) for c in others])
        return units.select(*keys, *others, F.when(F.size("path") > 0, viterbi_fold(F.col("path"))).alias("cuts"))
    few = F.col("n") <= SHORT
    short = F.when(few & F.col("rank").isNotNull(), pack(F.col("rank"), F.col("s"), F.col("e")))
    long = F.when(~few & F.col("rank").isNotNull(), F.struct("rank", "s", "e"))
    carried = [F.first(c, ignorenulls=True).alias(c) for c in others]
    units = edges.groupBy(*keys).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(short)).alias("short"), F.array_sort(F.collect_list(long)).alias("long"), *carried)
    cuts = F.when(F.size("short") > 0, merge_fold(F.col("short"), F.col("n"))).when(F.size("long") > 0, long_merge_fold(F.col("long"), F.col("n")))
    return units.select(*keys, *others, cuts.alias("cuts"))


def cached_units(rows: DataFrame, pieces: Pieces, most: int = MOST_CACHED) -> DataFrame:
    """unit: the most frequent units of the whole table that occur twice at least, `most` at most (ties at the limit stay out).

    No result depends on which units are chosen, only how often a unit is encoded anew.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def together() -> Iterator[pa.RecordBatch]:
            told = pa.concat_tables(held).group_by("unit").aggregate([("n", "sum")])
            yield from told.rename_columns(["unit", "n"]).to_batches(max_chunksize=50_000)

        for part in _chunks(batches, 0):
            for _, words, _ in pieces.word_arrays(part.column(0)):
                several = words.value_counts()
                units, each = pieces.unit_arrays(several.field(0))
                coded = units.dictionary_encode()
                n = np.bincount(coded.indices.to_numpy(), np.repeat(several.field(1).to_numpy(), each), len(coded.dictionary))
                held.append(pa.table({"unit": coded.dictionary, "n": n.astype(np.int64)}))
                size += len(n)
                if size > COUNTED:
                    yield from together()
                    held, size = [], 0
        if held:
            yield from together()

    counts = rows.select("text").mapInArrow(count, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))
    counts = materialize(counts.where("n > 1"), "sp-units")
    levels = counts.groupBy("n").agg(F.count(F.lit(1)).alias("units"))
    above = F.sum("units").over(Window.orderBy(F.desc("n")))
    least = levels.withColumn("above", above).where(F.col("above") <= most).agg(F.min("n")).first()[0]
    return counts.where(F.col("n") >= (least if least is not None else 2**62)).select("unit")


def _chunks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Batches in slices of about CHUNK bytes of the texts in `column`, a longer text alone."""
    for batch in batches:
        upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + CHUNK, "right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


def _hashes(some: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of the 128-bit hashes of units."""
    digest = xxhash.xxh3_128_digest
    both = np.frombuffer(b"".join([digest(u) for u in some]), ">u8").reshape(-1, 2)
    return both[:, 1].astype(np.uint64), both[:, 0].astype(np.uint64)


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions starts[i] to starts[i] + sizes[i], for each i in turn."""
    after = np.cumsum(sizes)
    return np.repeat(starts - (after - sizes), sizes) + np.arange(after[-1] if len(after) else 0)


class Table:
    """Ids of known units: hashes sorted by their first half, where each unit's ids start in `ids`, and how many."""

    def __init__(self, lo: np.ndarray, hi: np.ndarray, sizes: np.ndarray, ids: np.ndarray):
        order = np.argsort(lo, kind="stable")
        starts = np.cumsum(sizes) - sizes
        self.lo, self.hi, self.starts, self.sizes, self.ids = lo[order], hi[order], starts[order].astype(np.int32), sizes[order].astype(np.int32), ids

    def find(self, pieces: Pieces, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where each unit's start in them, how many, which units are unknown and have one hole)."""
        starts, sizes = np.full(len(units), len(self.ids)), np.ones(len(units), np.int64)
        known = np.zeros(len(units), bool)
        if len(self.lo) and units:
            lo, hi = _hashes(units)
            at = np.minimum(np.searchsorted(self.lo, lo), len(self.lo) - 1)
            known = (self.lo[at] == lo) & (self.hi[at] == hi)
            starts[known], sizes[known] = self.starts[at[known]], self.sizes[at[known]]
        more = [pieces.hole]
        for k in np.flatnonzero(~known).tolist():
            if len(units[k]) == 1:
                own = pieces.ids_of(units[k])
                starts[k], sizes[k], known[k] = len(self.ids) + len(more), len(own), True
                more += own
        return np.concatenate([self.ids, np.array(more, pieces.dtype)]), starts, sizes, ~known

    def encode(self, pieces: Pieces, words: pa.Array, counts: np.ndarray) -> Iterator[tuple[bytes, list[int], list[str]]]:
        """For each of some texts, given all their words: packed ids with holes, the number of the unit of each hole, and those units."""
        coded = words.dictionary_encode()
        units, each = pieces.unit_arrays(coded.dictionary)
        units = units.dictionary_encode()
        names, unit_of = units.dictionary.to_pylist(), units.indices.to_numpy()
        word = coded.indices.to_numpy()
        stream = unit_of[_ragged((np.cumsum(each) - each)[word], each[word])]  # all units of all texts
        ends = np.concatenate([[0], np.cumsum(each[word])])[np.cumsum(counts)]
        source, starts, sizes, unknown = self.find(pieces, names)
        ids = source[_ragged(starts[stream], sizes[stream])]
        cuts = np.concatenate([[0], np.concatenate([[0], np.cumsum(sizes[stream])])[ends]]).tolist()
        at = np.flatnonzero(unknown[stream])
        own: dict[int, list[int]] = {}
        for t, u in zip(np.searchsorted(ends, at, "right").tolist(), stream[at].tolist(), strict=True):
            own.setdefault(t, []).append(u)
        for t, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
            here: dict[int, int] = {}
            places = [here.setdefault(u, len(here)) for u in own.get(t, ())]
            yield ids[lo:hi].tobytes(), places, [names[u] for u in here]


def _ids_of_cuts(pieces: Pieces, unit: str, cuts) -> list[int]:
    if cuts is None:
        return [i for c in unit for i in pieces.ids_of(c)]
    return [i for a, b in zip(cuts, cuts[1:], strict=False) for i in pieces.ids_of(unit[a:b])]


def cached_table(rows: DataFrame, pieces: Pieces, most: int = MOST_CACHED) -> Table:
    """The encodings of the most frequent units, packed on the executors and sorted on the driver."""
    frequent = cached_units(rows, pieces, most)
    # Encoding is far more work than reading units, so they are dealt out to many tasks.
    dealt = frequent.repartition(_tasks(rows.sparkSession), "unit")
    encoded = encode_units(dealt.withColumn("u", F.col("unit")), ["u"], pieces)

    def pack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            if len(pdf):
                ids = [_ids_of_cuts(pieces, u, c) for u, c in zip(pdf["unit"], pdf["cuts"], strict=True)]
                lo, hi = _hashes(pdf["unit"].tolist())
                blobs = (lo, hi, np.array([len(x) for x in ids], np.int32), np.array([i for x in ids for i in x], pieces.dtype))
                yield pd.DataFrame([[b.tobytes() for b in blobs]], columns=["lo", "hi", "sizes", "ids"])

    release(rows.sparkSession)
    blobs = Scratch(encoded.select("unit", "cuts").mapInPandas(pack, "lo binary, hi binary, sizes binary, ids binary"), "sp-table")
    columns: list[list[bytes]] = [[], [], [], []]
    for r in blobs.df.collect():
        for c, b in zip(columns, r, strict=True):
            c.append(bytes(b))
    blobs.drop()
    lo, hi = (np.frombuffer(b"".join(c), np.uint64) for c in columns[:2])
    sizes, ids = (np.frombuffer(b"".join(c), t) for c, t in zip(columns[2:], (np.int32, pieces.dtype), strict=True))
    return Table(lo, hi, sizes.astype(np.int64), ids)


def _tasks(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def encode_documents(docs: DataFrame, model: str | Pieces = MODEL, id_col="doc_id", text_col="text", most_cached: int = MOST_CACHED) -> DataFrame:
    """doc_id, n_pieces, ids, decodes for every row of `docs`: the ids of the model's pieces for its whole text.

    decodes: whether the ids, decoded, are the text again (null for a null text). A null text has a null ids array and 0 pieces, an empty one an empty array. The model turns U+2581 into
    a space, as its library does; all else is kept. Repeated rows stay; an empty table gives an empty
    result; other columns are ignored.
    """
    spark = docs.sparkSession
    pieces = model if isinstance(model, Pieces) else Pieces.of_file(model)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = dict(rows.dtypes)["doc_id"]
    shared = spark.sparkContext.broadcast(cached_table(rows.where("text is not null"), pieces, most_cached))
    release(spark)

    def with_holes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row with the packed ids of each text, and one for each of its units that is not in the table."""
        table, small = shared.value, zstandard.ZstdCompressor(level=3)

        def rows_of(part: pa.RecordBatch, coded, marks: list) -> pa.RecordBatch:
            own, numbers, at, units, packed, places, told = [], [], [], [], [], [], []
            for k, (x, (ids, holes, missing), mark) in enumerate(zip(part.column(1).to_pylist(), coded, marks, strict=True)):
                none = [None] * len(missing)
                own += [x] * (1 + len(missing))
                numbers += [k, *none]
                at += [-1, *range(len(missing))]
                units += [None, *missing]
                packed += [None if ids is None else small.compress(ids), *none]
                places += [holes or None, *none]
                told += [mark, *none]
            columns = [pa.array(own, pa.int64()), part.column(0).take(pa.array(numbers, pa.int32())), pa.array(at, pa.int32())]
            columns += [pa.array(units, pa.string()), pa.array(packed, pa.binary()), pa.array(places, pa.list_(pa.int32())), pa.array(told, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["x", "doc_id", "i", "unit", "packed", "places", "mark"])

        for batch in batches:
            gone = batch.filter(batch.column(2).is_null())
            if gone.num_rows:
                yield rows_of(gone, [(None, None, ())] * gone.num_rows, [None] * gone.num_rows)
            for part in _chunks([batch.filter(batch.column(2).is_valid())], 2):
                for rows, words, counts in pieces.word_arrays(part.column(2)):
                    some = part.take(pa.array(rows))
                    marks = [_mark(t.as_buffer()) for t in pc.replace_substring(some.column(2), SPACE, " ")]
                    yield rows_of(some, table.encode(pieces, words, counts), marks)

    # The number of a row, the same when its part of the input is read again.
    numbered = rows.select("doc_id", F.monotonically_increasing_id().alias("x"), "text")
    holed = numbered.mapInArrow(with_holes, f"x long, doc_id {id_type}, i int, unit string, packed binary, places array<int>, mark long")
    # The one shuffle of what texts become: the lattice and both groupings stay inside these partitions.
    filled = encode_units(holed.repartition(_tasks(spark), "x"), ["x", "i"], pieces)
    one = lambda c: F.first(c, ignorenulls=True).alias(c)
    filled = filled.groupBy("x").agg(one("doc_id"), one("packed"), one("places"), one("mark"), F.collect_list(F.when(F.col("i") >= 0, F.struct("i", "unit", "cuts"))).alias("units"))

    def ids_of(packed: bytes, places, units) -> np.ndarray:
        ids = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), pieces.dtype)
        if not places:
            return ids.astype(np.int32)
        own = {u["i"]: np.array(_ids_of_cuts(pieces, u["unit"], u["cuts"]), np.int32) for u in units}
        fill = [own[p] for p in places]
        holes = np.flatnonzero(ids == pieces.hole)
        sizes = np.ones(len(ids), np.int64)
        sizes[holes] = [len(f) for f in fill]
        out = np.repeat(ids.astype(np.int32), sizes)
        begins = (np.cumsum(sizes) - sizes)[holes].tolist()
        for a, f in zip(begins, fill, strict=True):
            out[a : a + len(f)] = f
        return out

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text_of = pieces.texts().__getitem__
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                marks = part.column(4).to_pylist()
                out = [None if b is None else ids_of(b, p, u) for b, p, u in zip(*(part.column(k).to_pylist() for k in (1, 2, 3)), strict=True)]
                sizes = np.array([0 if r is None else len(r) for r in out], np.int64)
                flat = np.concatenate([r for r in out if r is not None] or [np.zeros(0, np.int32)])
                ends = pa.array([None if r is None else e for r, e in zip(out, np.cumsum(sizes) - sizes, strict=True)] + [len(flat)], pa.int32())
                same = [None if r is None else _mark(b"".join(map(text_of, r.tolist()))[1:]) == m for r, m in zip(out, marks, strict=True)]
                columns = [part.column(0), pa.array(sizes), pa.ListArray.from_arrays(ends, pa.array(flat, pa.int32())), pa.array(same, pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_pieces", "ids", "decodes"])

    return filled.select("doc_id", "packed", "places", "units", "mark").mapInArrow(assemble, f"doc_id {id_type}, n_pieces long, ids array<int>, decodes boolean")


def _mark(text) -> int:
    """A hash of the bytes of a text."""
    return xxhash.xxh3_64_intdigest(text) >> 1


def decode_ids(ids: Column, model: str | Pieces = MODEL) -> Column:
    """The text of an array of ids: bytes of the pieces in a row, as UTF-8 (invalid bytes replaced), without the leading space.

    Ids outside the vocabulary, and control pieces, stand for nothing; null stays null.
    """
    pieces = model if isinstance(model, Pieces) else Pieces.of_file(model)
    of = [b.hex() for b in pieces.texts()]
    names = F.array(*[F.lit(h) for h in of]) if len(of) < 256 else F.split(F.lit(",".join(of)), ",", -1)
    text = F.array_join(F.transform(ids, lambda i: F.coalesce(F.get(names, i), F.lit(""))), "")
    whole = F.decode(F.unhex(text), "UTF-8")
    return F.when(F.substring(whole, 1, 1) == " ", F.substring(whole, 2, 2**31 - 1)).otherwise(whole)
