"""SimHash near-duplicate groups through covering locality-sensitive hashing.

Bits of a fingerprint get vectors over GF(2) of radius + 1 dimensions; each non-zero vector v gives one
table, whose mask keeps the bits with an odd product with v. For any `radius` differing bits some v is
orthogonal to all of them, so every pair within the radius agrees under some mask: 2^(radius+1) - 1
tables lose no pair.

Groups without pairs: fingerprints that share a masked key write themselves with none or one of the
unmasked bits flipped. Two fingerprints within two bits of each other meet in one such variant, any that
meet are within two bits, and at most 65 can meet in one; each links to the smallest there. Work is
linear however large a bucket gets.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockwell.llm.common import WORD, materialize
from stockwell.llm.components import components

BITS = 64
#: Shingles unpacked to bits at a time, which bounds memory on very long texts.
BLOCK = 16_384
#: Members of a block when the texts of a large bucket are compared with each other.
BLOCK_MEMBERS = 128
#: Cells whose parities tell unlike sets apart; a power of two and a multiple of 64.
PARITY_BITS = 2048
#: Texts of so few shingles are compared whatever their views are: samples of them agree less often than they are alike.
SHORT = 40


def masks(radius: int, bits: int = BITS) -> list[int]:
    """The bit masks of the tables, as unsigned integers. Bit i has the vector i mod (2^(radius+1)-1) + 1."""
    n = (1 << (radius + 1)) - 1
    odd = lambda x: bin(x).count("1") & 1
    return [sum(1 << i for i in range(bits) if odd((i % n + 1) & v)) for v in range(1, n + 1)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """XXH64 (seed 42) of the k-word shingles of a text, A-Z lower-cased, repeats included, in order.

    Fewer words than k: the whole sequence is one shingle; no words: none.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    n = max(1, len(words) - k + 1)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends[:-1]]
    digest = xxhash.xxh64_intdigest
    k = min(k, len(words))
    return np.fromiter((digest(line[s : e - 1], 42) for s, e in zip(starts, ends[k - 1 :], strict=False)), np.uint64, n)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is set if it is set in over half the hashes; zero without hashes."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), BLOCK):
        part = hashes[at : at + BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint_column(text: Column, k: int) -> Column:
    """The fingerprint as a signed bigint."""

    @F.pandas_udf(T.LongType())
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series([signed(fingerprint(shingle_hashes(t, k))) for t in texts], dtype="int64")

    return simhash(text)


def _shared(keys: DataFrame) -> DataFrame:
    """(table, key, fp) rows of the masked keys that at least two fingerprints have."""
    both = keys.groupBy("t", "key").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi").select("t", "key")
    return keys.join(both, ["t", "key"])


def links(nodes: DataFrame, radius: int = 2) -> DataFrame:
    """a, b: links between the distinct fingerprints `fp` of `nodes` whose closure is that of all pairs within `radius` <= 2 bits."""
    if not 0 <= radius <= 2:
        raise ValueError("radius must be 0, 1 or 2")
    if radius == 0:
        return nodes.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    tables = [signed(m) for m in masks(radius)]
    keyed = nodes.select("fp", F.posexplode(F.array(*[F.lit(m) for m in tables])).alias("t", "m"))
    keyed = keyed.select("t", F.col("fp").bitwiseAND(F.col("m")).alias("key"), "fp")
    members = _shared(keyed)
    flips = [[0, *[signed(1 << i) for i in range(BITS) if not m >> i & 1]] for m in masks(radius)]
    choices = F.array(*[F.array(*[F.lit(x) for x in f]) for f in flips])
    variants = members.select("fp", F.explode(F.element_at(choices, F.col("t") + 1)).alias("flip"))
    variants = variants.select(F.col("fp").bitwiseXOR(F.col("flip")).alias("variant"), "fp", (F.col("flip") == 0).alias("own")).distinct()
    met = variants.groupBy("variant").agg(F.min("fp").alias("lo"), F.collect_set("fp").alias("all"), F.max("own").alias("own")).where("size(all) > 1")
    if radius == 1:  # a link of one bit meets where one end writes itself; two flipped ends are two bits apart
        met = met.where("own").withColumn("lo", F.col("variant"))
    return met.select(F.col("lo").alias("a"), F.explode("all").alias("b")).where("a <> b").distinct()


def groups(docs: DataFrame, shingle: int = 3, radius: int = 2, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, fp (bigint), component_id for every row of `docs`.

    Fingerprints link at `radius` or fewer differing bits; component_id is the smallest doc_id reachable.
    Null and empty texts have the fingerprint zero and link like any other; null doc_ids count only where
    a component has no other. Repeated rows stay repeated. An empty table gives an empty result. Other
    columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), fingerprint_column(F.col(text_col), shingle).alias("fp"))
    rows = materialize(rows, "simhash")
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(nodes.select("fp"), radius))
    named = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    label = materialize(named.join(ids, "root").select("fp", "component_id"), "simhash-label")
    return rows.join(label, "fp").select("doc_id", "fp", "component_id")


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# ------------------------------------------------------------------ groups by similarity of shingle sets

#: Odd multipliers that order the shingles of a document anew for each view: multiples of a rule's output.
def _multipliers(views: int) -> np.ndarray:
    state, out = 0x243F6A8885A308D3, []
    for _ in range(views):
        state = (state * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        out.append((state ^ state >> 29) % (1 << 64) | 1)
    return np.array(out, np.uint64)


def view_fingerprints(hashes: np.ndarray, views: int) -> list[int]:
    """SimHash of the three shingles that come first in each of `views` orders of the distinct shingles.

    Two sets of similarity j choose the same three in one order with a chance of about j^3.
    """
    distinct = np.unique(hashes)
    out = []
    for m in _multipliers(views):
        mixed = distinct * m
        mixed ^= mixed >> np.uint64(32)
        if len(mixed) > 3:
            first = distinct[np.argpartition(mixed, 3)[:3]]
        else:
            first = distinct
        a = [int(x) for x in first]
        out.append(signed((a[0] & a[1]) | (a[1] & a[2]) | (a[0] & a[2]) if len(a) == 3 else fingerprint(first)))
    return out


def linked_pairs(keys: list, labels: list, sets: list[np.ndarray], similarity: float) -> list[tuple]:
    """Links that connect whatever is alike among `sets` and has different labels, each checked exactly.

    Every pair is considered. Parities of the hashes in PARITY_BITS cells differ in no more cells than the sets
    differ in hashes, so pairs whose parities differ too much, or whose sizes do, cannot be alike.
    """
    label = np.unique(labels, return_inverse=True)[1]
    size = np.array([len(x) for x in sets])
    cells = np.zeros((len(sets), PARITY_BITS), np.uint8)
    for row, x in zip(cells, sets, strict=True):
        row[:] = np.bincount((x & (PARITY_BITS - 1)).astype(np.int64), minlength=PARITY_BITS) & 1
    words = np.packbits(cells, axis=1).view(np.uint64)
    out = []
    for i in range(len(sets) - 1):
        rest = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
        small, large = np.minimum(size[rest], size[i]), np.maximum(size[rest], size[i])
        rest = rest[(small > 0) & (small >= similarity * large - 1e-9)]
        apart = np.bitwise_count(words[rest] ^ words[i]).sum(1, dtype=np.int64)
        rest = rest[apart <= (1 - similarity) / (1 + similarity) * (size[rest] + size[i]) + 1e-6]
        for j in rest.tolist():
            if label[j] != label[i]:
                common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if common >= similarity * (size[i] + size[j] - common) - 1e-9:
                    out.append((keys[i], keys[j]))
                    label[label == label[j]] = label[i]
    return out


def _postings(sets: DataFrame, similarity: float) -> DataFrame:
    """h, k: the texts of `sets` (k, s) under those of their shingles that a text alike to them must share.

    Shingles are ordered by the number of sets that have them, rarest first. Of n shingles, two alike sets share
    one of their first n - ceil(similarity * n) + 1. Those of a single set come first and need no row.
    """
    each = sets.select("k", F.size("s").alias("n"), F.explode("s").alias("h"))
    often = materialize(each.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "near-often")
    own = each.join(often, "h").groupBy("k").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("df", "h"))).alias("shared"))
    first = F.size("shared") - F.ceil(F.lit(similarity) * F.col("n") - 1e-9).cast("int") + 1
    rows = own.where(first > 0).select("k", F.explode(F.slice("shared", F.lit(1), first)).alias("e"))
    return materialize(rows.select("e.h", "k"), "near-postings")


def _with_roots(nodes: DataFrame, links: list[DataFrame]) -> DataFrame:
    """k, root of every k of `nodes`: the smallest node that `links` (a, b) reach from it."""
    edges = links[0]
    for more in links[1:]:
        edges = edges.unionByName(more)
    roots = components(edges)
    return materialize(nodes.join(roots, nodes.k == roots.node, "left").select("k", F.coalesce("root", "k").alias("root")), "near-roots")


def _mixed(members: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(h, k, root of `members`; h, n, main, and x, y, a hash of its texts, for each h with texts of several roots)."""
    named = materialize(members.join(roots, "k"), "near-named")
    same = F.bit_xor(F.xxhash64("k")).alias("x"), F.bit_xor(F.xxhash64("k", F.lit(1))).alias("y")
    stats = named.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min_by("root", "k").alias("main"), F.min("root").alias("lo"), F.max("root").alias("hi"), *same)
    return named, materialize(stats.where("lo <> hi").drop("lo", "hi"), "near-mixed")


def _cross_links(named: DataFrame, mixed: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """a, b: links that connect all alike texts of each posting h of `mixed` that have different roots.

    Of postings with the same texts one is compared. In large ones, the texts connected to the smallest
    (main) are not compared among themselves, and all others meet in blocks, of which each pair is a group
    of its own.
    """
    one = mixed.groupBy("n", "x", "y").agg(F.min(F.struct("h", "main")).alias("one")).select("one.*", "n")
    rest = materialize(named.join(materialize(one, "near-one"), "h").withColumn("is_main", F.col("root") == F.col("main")), "near-rest")
    sides = rest.groupBy("h").agg(F.count_if("is_main").alias("m"), F.count_if(~F.col("is_main")).alias("o"))
    blocks = lambda n: F.ceil(F.col(n) / F.lit(BLOCK_MEMBERS)).cast("int")
    rest = rest.join(materialize(sides.select("h", blocks("m").alias("m"), blocks("o").alias("o")), "near-sides"), "h")
    own = F.pmod(F.xxhash64("k"), F.when(F.col("is_main"), F.col("m")).otherwise(F.col("o"))).cast("int")
    cell = lambda kind, x, y: F.struct(F.lit(kind).alias("kind"), x.alias("x"), y.alias("y"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    main = F.transform(upto("o"), lambda j: cell(1, F.col("own"), j))
    other = F.concat(F.transform(upto("m"), lambda i: cell(1, i, F.col("own"))), F.transform(upto("o"), lambda j: cell(2, F.least(j, F.col("own")), F.greatest(j, F.col("own")))))
    where = F.when(F.col("n") <= 2 * BLOCK_MEMBERS, F.array(cell(0, F.lit(0), F.lit(0)))).when(F.col("is_main"), main).otherwise(other)
    rest = rest.withColumn("own", own).select("h", "k", "root", F.explode(where).alias("cell")).join(sets, "k")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(linked_pairs(pdf["k"].tolist(), pdf["root"].tolist(), pdf["s"].tolist(), similarity), columns=["a", "b"], dtype="int64")

    return rest.groupBy("h", "cell.kind", "cell.x", "cell.y").applyInPandas(compare, "a long, b long").distinct()


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The rows (a, b) of `pairs` whose sets are alike."""
    left = pairs.join(sets.select(F.col("k").alias("a"), F.col("s").alias("sa")), "a")
    both = left.join(sets.select(F.col("k").alias("b"), F.col("s").alias("sb")), "b")
    small, large = F.least(F.size("sa"), F.size("sb")), F.greatest(F.size("sa"), F.size("sb"))
    both = both.where((small >= similarity * large - 1e-9) & (small > 0))
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(common >= similarity * (small + large - common) - 1e-9).select("a", "b")


def text_key(text: Column) -> Column:
    """What equal texts, and all texts without words, have in common (bigint)."""
    return F.xxhash64(F.md5(F.when(text.rlike(WORD), text).otherwise("").cast("binary")))


def similar_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, views: int = 16, radius: int = 1, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, component_id, text_key for every row of `docs`: groups of texts whose shingle sets have a Jaccard similarity >= `similarity`.

    Equal texts are grouped first. A text is a candidate if it shares the masked key of a view (see
    view_fingerprints) with another text, or has SHORT shingles or fewer. All pairs among the candidates are then
    decided exactly, through the postings of their rarest shingles (see _postings): every text of a posting is
    compared with its smallest and largest one, and what is then not connected is compared in full. A pair of
    similarity 0.8 with more than SHORT shingles is no pair of candidates with a chance of 0.00001. Texts
    without words count as equal. doc_id null, repeats and other columns as in groups(); an empty table gives an
    empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), text_key(F.col(text_col)).alias("k"))
    ids = materialize(rows.groupBy("k").agg(F.min("doc_id").alias("least")), "near-ids")

    @F.pandas_udf("views array<long>, n int")
    def seen(texts: pd.Series) -> pd.DataFrame:
        hashes = (np.unique(shingle_hashes(t, shingle)) for t in texts)
        return pd.DataFrame([(view_fingerprints(x, views), len(x)) if len(x) else (None, 0) for x in hashes], columns=["views", "n"])

    # Fingerprints of all rows are cheaper than a shuffle of the texts; equal texts then fall together.
    prints = rows.select("k", seen("text").alias("v")).groupBy("k").agg(F.first("v").alias("v"))
    prints = materialize(prints.select("k", "v.views", "v.n"), "near-views")
    tables = F.array(*[F.lit(signed(m)) for m in masks(radius)])
    keys = prints.select("k", F.posexplode("views").alias("view", "fp")).select("k", "view", F.posexplode(tables).alias("t", "m"), "fp")
    keys = keys.select((F.col("view") * F.size(tables) + F.col("t")).alias("t"), F.col("fp").bitwiseAND(F.col("m")).alias("key"), "k")
    shared = keys.groupBy("t", "key").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).where("lo <> hi").select("t", "key")
    crowd = keys.join(materialize(shared, "near-buckets"), ["t", "key"], "left_semi").select("k")
    crowd = materialize(crowd.unionByName(prints.where(f"n between 1 and {SHORT}").select("k")).distinct(), "near-crowd")

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def shingle_set(texts: pd.Series) -> pd.Series:
        return pd.Series([np.unique(shingle_hashes(t, shingle)).view(np.int64) for t in texts])

    hold = rows.select("k", "text").join(crowd, "k", "left_semi").groupBy("k").agg(F.first("text").alias("text"))
    sets = materialize(hold.select("k", shingle_set("text").alias("s")), "near-sets")
    postings = _postings(sets, similarity)
    ends = postings.groupBy("h").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).where("lo <> hi")
    met = postings.join(materialize(ends, "near-ends"), "h")
    pair = lambda end: F.struct(F.least("k", end).alias("a"), F.greatest("k", end).alias("b"))
    pairs = met.select(F.explode(F.array(pair("lo"), pair("hi"))).alias("p")).select("p.*").where("a <> b").distinct()
    links = [materialize(_alike(materialize(pairs, "near-pairs"), sets, similarity), "near-links")]
    members = met.select("h", "k")
    # A text of a crowd is in many postings: it is compared in its largest one first, and in the others if they are still mixed.
    for turn in range(2):
        named, mixed = _mixed(members, _with_roots(sets.select("k"), links))
        mixed = mixed.where("n > 3")  # all pairs of three have been compared
        if not mixed.head(1):
            continue
        if turn == 0:
            largest = named.join(mixed.select("h", "n"), "h").groupBy("k").agg(F.max(F.struct("n", "h"))["h"].alias("h"), F.first("root").alias("root"))
            named = materialize(largest.select("h", "k", "root"), "near-largest")
            named, mixed = _mixed(named.select("h", "k"), named.select("k", "root"))
        links.append(materialize(_cross_links(named, mixed, sets, similarity), "near-cross"))
    named = ids.join(_with_roots(ids.select("k"), links), "k")
    first = named.groupBy("root").agg(F.min("least").alias("component_id"))
    label = materialize(named.join(materialize(first, "near-first"), "root").select("k", "component_id"), "near-label")
    return rows.select("doc_id", "k").join(label, "k").select("doc_id", "component_id", F.col("k").alias("text_key"))
