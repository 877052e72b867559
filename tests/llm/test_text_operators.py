"""Operators against brute force, and the cases of their docstrings: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockwell.llm import annsearch, chatformat, common, fingerprints, langid, lattice, mixing, sharding, simhash, substring, toxicity
from stockwell.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, h string, shard string, k string"


def texts():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeilnorst") for _ in range(rng.randint(1, 8))) for _ in range(400)]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage = make(60)
    out = [None, "", "   \n", "word", "Two words", "!!! 123", "é ü 漢字 ▁x", make(4000), "x" * 3000, "a " * 500]
    for n in (5, 14, 40, 120, 300):
        base = make(n)
        out += [base, base, base.upper(), base + " tail", f"{make(20)} {passage} {make(20)}"]
        words = base.split()
        words[len(words) // 2] = "changed"
        out.append(" ".join(words))
    return out


@pytest.fixture(scope="module")
def rows():
    out = [(i, t, ("en", "de", None)[i % 3], ("a", "b", None)[i % 3] if i % 5 else "hot", 1) for i, t in enumerate(texts())]
    return [*out, out[12], (None, "no id at all", "en", "a", 1), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, "s", "h", "sh", "k") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def ids_and_texts(rows):
    return [(r[0], r[1]) for r in rows]


# ------------------------------------------------------------------ simhash


def slow_print(t):
    import xxhash

    w = [bytes(x) for x in (t or "").encode().lower().split()]
    sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def union_find(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def test_simhash_groups(docs, rows, none):
    got = simhash.groups(docs).collect()
    assert len(got) == len(rows) and simhash.groups(none).count() == 0
    prints = sorted({slow_print(t) for _, t in ids_and_texts(rows)})
    assert {simhash.signed(slow_print(t)) for _, t in ids_and_texts(rows)} == {r.fp for r in got}
    root = union_find(prints, [(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 2])
    least = {}
    for i, t in ids_and_texts(rows):
        if i is not None:
            k = root[slow_print(t)]
            least[k] = min(i, least.get(k, i))
    want = {simhash.signed(p): least.get(root[p]) for p in prints}
    assert all(r.component_id == want[r.fp] for r in got)


@pytest.mark.parametrize("radius", [0, 1, 2])
def test_links_close_over_all_near_pairs(spark, radius):
    rng = random.Random(radius)
    centre = rng.getrandbits(64)
    prints = {centre}
    for _ in range(300):  # one crowd in the same buckets, and strangers
        flips = sum(1 << b for b in rng.sample(range(12), rng.randint(0, 5)))
        prints |= {centre ^ flips, rng.getrandbits(64)}
    prints = sorted(map(simhash.signed, prints))
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    far = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    found = [(r.a, r.b) for r in simhash.links(df, radius).collect()]
    assert all(far(a, b) <= radius for a, b in found)
    want = union_find(prints, [(a, b) for a in prints for b in prints if a < b and far(a, b) <= radius])
    assert union_find(prints, found) == want


def test_covering_masks():
    import itertools

    for radius in (1, 2):
        for bits in itertools.combinations(range(64), radius):
            assert any(not any(m >> b & 1 for b in bits) for m in simhash.masks(radius))


def test_similar_groups(docs, rows, none):
    assert simhash.similar_groups(none).count() == 0
    got = {(r.doc_id, r.text_key): r.component_id for r in simhash.similar_groups(docs).collect()}
    sets = [(i, t or "", frozenset(simhash.shingle_hashes(t, 5).tolist())) for i, t in ids_and_texts(rows)]
    nodes = sorted({t for _, t, _ in sets})
    s = {t: x for _, t, x in sets}
    linked = [(a, b) for a in nodes for b in nodes if a < b and len(s[a] & s[b]) >= 0.8 * len(s[a] | s[b]) - 1e-9]  # texts without words: empty sets
    root = union_find(nodes, linked)
    groups = {}
    for i, t, _ in sets:
        groups.setdefault(root[t], []).append(i)
    want = {i: min((x for x in groups[root[t]] if x is not None), default=None) for i, t, _ in sets if i is not None}
    assert {i: c for (i, _), c in got.items() if i is not None} == want


@pytest.mark.parametrize("members", [256, 8])
def test_similar_groups_of_hubs_chains_and_crowds(spark, monkeypatch, members):
    monkeypatch.setattr(simhash, "BLOCK_MEMBERS", members, raising=False)
    rng = random.Random(5)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]

    def change(words, n):
        at = rng.sample(range(3, len(words), 6), n)
        return [f"x{rng.random()}" if i in at else w for i, w in enumerate(words)]

    made = {}
    for hub in (0, 1000, 2000):  # copies alike to the original, not among themselves
        base = fresh(200)
        made |= {hub + i: " ".join(change(base, 4)) for i in range(120)} | {hub + 500: " ".join(base)}
    for chain in (3000, 4000):  # each version is alike to the one before
        now = fresh(200)
        for i in range(120):
            made[chain + i] = " ".join(now)
            now = change(now, 4)
    passage = fresh(130)  # shared by many that are alike in pairs only
    for i in range(5000, 5120, 2):
        own = passage + fresh(70)
        made |= {i: " ".join(own), i + 1: " ".join(change(own, 2))}
    passage = fresh(260)  # its share is so high that strangers are nearly alike
    for i in range(6000, 6200, 2):
        own = passage + fresh(33)
        made |= {i: " ".join(own), i + 1: " ".join(change(own, 3))}
    short = [fresh(9) for _ in range(60)]
    for k, own in enumerate(short):  # four and five shingles
        made |= {7000 + 2 * k: " ".join(own), 7001 + 2 * k: " ".join(own[:8])}
    s = {i: frozenset(simhash.shingle_hashes(t, 5).tolist()) for i, t in made.items()}
    want = union_find(made, [(a, b) for a in made for b in made if a < b and len(s[a] & s[b]) >= 0.8 * len(s[a] | s[b])])
    df = spark.createDataFrame(list(made.items()), "doc_id long, text string").repartition(4)
    assert {r.doc_id: r.component_id for r in simhash.similar_groups(df).collect()} == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, 2), (2, 3), (9, 9)] + [(500, 500 + i) for i in range(1, 50)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.root for r in components(df).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, 1: 1, 2: 1, 3: 1, **{500 + i: 500 for i in range(50)}}
    assert components(df.limit(0)).count() == 0


# ------------------------------------------------------------------ sharding, mixing, ranks


def test_shards(docs, rows, none):
    got = sharding.shard(docs, shards=4).collect()
    assert len(got) == len(rows) and sharding.shard(none, shards=4).count() == 0
    counts = [sum(r.shard == s for r in got) for s in range(4)]
    assert max(counts) - min(counts) <= 1
    for s in range(4):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    want = sorted((i if i is not None else -1, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in ids_and_texts(rows))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.size, r.text_crc32) for r in got) == want


def _shards_of(spark, groups, shards):
    """The shards of each group of equal texts, and all counts; groups: sizes."""
    rows = [(1000 * g + i, f"text {g}") for g, n in enumerate(groups) for i in range(n)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), shards=shards).collect()
    assert len(got) == len(rows)
    counts = [sum(r.shard == s for r in got) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    by = {}
    for r in got:
        by.setdefault(r.doc_id // 1000, []).append(r.shard)
    return [by[g] for g in range(len(groups))]


def _cut(groups):
    """Pairs of equal texts on different shards."""
    return sum(sum(a != b for a in g for b in g) // 2 for g in groups)


def test_shards_keep_what_fits_whole(spark):
    cases = [[320, *[2] * 160, *[1] * 320], [30] * 8 + [1] * 80, [39] * 8 + [1] * 8, [2] * 480, [3] * 100 + [2] * 100 + [1] * 460]
    for groups, shards in zip(cases, (24, 8, 8, 24, 24), strict=True):
        got = _shards_of(spark, groups, shards)
        quota = sum(groups) // shards
        # The best possible: whole quotas of a large group on shards of their own, and nothing else is cut.
        best = _cut([[i // quota for i in range(n)] for n in groups])
        assert _cut(got) == best


def test_shards_cut_little_where_all_is_linked(spark):
    rng = random.Random(2)
    groups = [rng.randint(2, 9) for _ in range(150)]
    got = _shards_of(spark, groups, 7)
    whole = sum(len(set(g)) == 1 for g in got)
    assert whole >= 150 - 2 * 7  # at most two of a shard's groups are at its ends


def test_mix(spark, docs, rows, none):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and mixing.mix(none).count() == 0
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs).collect()), key=str)
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    total = sum(r.size for r in got)
    by = {r.source: r for r in got}
    assert abs(sum(r.target for r in by.values()) - total) < 1e-6
    assert all(r.target <= 3 * r.source_size + 1e-9 for r in got)
    many = spark.range(6000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 37).cast("int")).alias("text"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"))
    for _, part in mixing.mix(many).toPandas().groupby("source"):
        assert abs(part.taken.sum() - part.target.iloc[0]) < 80
    emitted = mixing.emit(many)
    assert emitted.columns == many.columns and emitted.count() == mixing.mix(many).agg(F.sum("copies")).first()[0]


def test_ranks(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("p"), (F.col("id") % 7).alias("o"), "id")
    got = common.ranked(df, ["p"], ["o"], F.col("id") % 5, ["id"], "n").collect()
    for p in range(3):
        mine = sorted((r for r in got if r.p == p), key=lambda r: r.n)
        assert [r.n for r in mine] == list(range(1, len(mine) + 1))
        assert [(r.o, r.id % 5, r.id) for r in mine] == sorted((r.o, r.id % 5, r.id) for r in mine)


# ------------------------------------------------------------------ substring dedup


def test_sketch_overestimates_only():
    rng = np.random.default_rng(4)
    parts = [np.unique(rng.integers(0, 3000, 400)).astype("<u4") for _ in range(6)]
    twice = [rng.choice(p, 20, replace=False) for p in parts]
    once = [np.setdiff1d(p, t) for p, t in zip(parts, twice, strict=True)]
    table = substring.pa.table({"block": [0] * 6, "g": list(range(6)), "once": [x.tobytes() for x in once], "twice": [x.tobytes() for x in twice]})
    got = {g: set(np.frombuffer(e, "<u4").tolist()) for g, e in zip(*(substring._merge(table).column(c).to_pylist() for c in ("g", "entries")), strict=True)}
    every, n = np.unique(np.concatenate([*once, *twice, *twice]), return_counts=True)
    often = set(every[n > 1].tolist())
    assert all(got[g] >= often & set(parts[g].tolist()) for g in range(6))
    assert sum(map(len, got.values())) < 1.1 * sum(len(often & set(p.tolist())) for p in parts)


@pytest.mark.parametrize("parts", [None, 900])
def test_strip(docs, rows, none, parts, monkeypatch):
    if parts:  # many parts and blocks: the result stays the same
        monkeypatch.setattr(substring, "PART_CHARS", parts)
        monkeypatch.setattr(substring, "BLOCK_ENTRIES", 40)
    assert substring.strip(none).count() == 0
    far = 2**63  # above all ids, of which the largest is among the rows
    rows = [*rows, (far - 1, rows[12][1], "en", "a", 1), (far - 1, rows[20][1], "en", "a", 1)]
    docs = docs.unionByName(docs.where(F.col("doc_id").isin(12, 20)).dropDuplicates(["doc_id"]).withColumn("doc_id", F.lit(far - 1)))
    words = [(far if i is None else i, (t or "").encode().split()) for i, t in ids_and_texts(rows)]
    first = {}
    for d, w in words:
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            first[key] = min(d, first.get(key, d))
    want = []
    for d, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < d:
                gone[k : k + 13] = [True] * 13
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        want.append((d, len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    got = [(far if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring.strip(docs).collect()]
    assert sorted(got) == sorted(want) and any(r[2] for r in want)


def test_strip_carries_and_keeps_untouched_texts(docs):
    got = substring.strip(docs, carry=("lang", "source")).collect()
    before = {r.doc_id: r for r in docs.collect() if r.doc_id is not None}
    for r in got:
        if r.doc_id is not None:
            assert (r.lang, r.source) == (before[r.doc_id].lang, before[r.doc_id].source)
            assert r.n_removed or r.text == (before[r.doc_id].text or "")


# ------------------------------------------------------------------ learned models


def test_language_gradients():
    rng = np.random.default_rng(0)
    w = langid._init(3, rng)
    w = {k: v.astype(np.float64) for k, v in w.items()}
    x, y = rng.integers(0, 256, (6, 2)), np.array([0, 2])

    def loss(w):
        f, _ = langid._run(x, w, "f", False)
        b, _ = langid._run(x[::-1], w, "b", False)
        p = langid._softmax(np.concatenate([f, b[::-1]], -1).astype(np.float64) @ w["O"] + w["o"])
        return -np.log(p[:, np.arange(2), y]).sum()

    f, fs = langid._run(x, w, "f", True)
    b, bs = langid._run(x[::-1], w, "b", True)
    both = np.concatenate([f, b[::-1]], -1)
    d = langid._softmax(both @ w["O"] + w["o"])
    d[:, np.arange(2), y] -= 1
    grads = {k: np.zeros_like(a) for k, a in w.items()}
    back = d @ w["O"].T
    langid._back(x, w, "f", fs, back[..., : langid.HIDDEN], grads)
    langid._back(x[::-1], w, "b", bs, back[::-1, :, langid.HIDDEN :], grads)
    for name in ("Uf", "Vb", "Wf", "cb"):
        at = (1, 2) if w[name].ndim == 2 else (1,)
        up, down = ({k: v.copy() for k, v in w.items()} for _ in range(2))
        up[name][at] += 1e-2
        down[name][at] -= 1e-2
        assert abs((loss(up) - loss(down)) / 2e-2 - grads[name][at]) < 2e-2 * max(1, abs(grads[name][at]))


def test_language_held_out(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    network = langid.fit(docs.where(part != 1))
    told = langid.predict(docs.where(part == 1), network).join(docs.select("doc_id", "lang"), "doc_id")
    assert told.where("lang_pred = lang").count() > 0.97 * told.count()


def test_language_edges(docs, rows, none):
    network = langid.Network(["a", "b"], langid.train([b"aaaa aaa", b"zzz zz z"] * 4, [0, 1] * 4, 2))
    got = langid.predict(docs, network).collect()
    assert len(got) == len(rows) and langid.predict(none, network).count() == 0
    for r, (_, t) in zip(sorted(got, key=str), sorted(ids_and_texts(rows), key=str), strict=False):
        assert 0 <= r.score <= 1
    letters = sum(any(c.isalpha() for c in t or "") for _, t in ids_and_texts(rows))
    assert sum(r.lang_pred == "und" for r in got) == len(rows) - letters
    empty = langid.predict(docs, langid.fit(none)).collect()
    assert {(r.lang_pred, r.score) for r in empty} == {("und", 0.0)}
    long = b"aaaa " * 5000
    whole = langid.document_probabilities([b"zz", long, b""], network.weights)
    assert np.allclose(whole[1], langid.document_probabilities([long], network.weights)[0]) and not whole[2].any()


def slow_label(data, langs, w):
    """Positions of a text one by one, in segments with their context: (language, mean probability)."""
    h, total = langid.HIDDEN, np.zeros(len(langs))

    def cell(state, byte, d):
        a = w["E"][byte] @ w[f"W{d}"] + w[f"c{d}"]
        z, r = (1 / (1 + np.exp(-(state @ w[f"U{d}"][:, k * h : (k + 1) * h] + a[k * h : (k + 1) * h]))) for k in (0, 1))
        n = np.tanh((r * state) @ w[f"V{d}"] + a[2 * h :])
        return state + z * (n - state)

    for lo in range(0, len(data), langid.SEGMENT):
        span = [data[i] if 0 <= i < len(data) else 256 for i in range(lo - langid.CONTEXT, lo + langid.SEGMENT + langid.CONTEXT)]
        forward, backward, state = [], [], np.zeros(h)
        for byte in span:
            forward.append(state := cell(state, byte, "f"))
        state = np.zeros(h)
        for byte in reversed(span):
            backward.append(state := cell(state, byte, "b"))
        backward.reverse()
        for i in range(langid.CONTEXT, langid.CONTEXT + langid.SEGMENT):
            if span[i] < 256:
                p = np.exp(np.concatenate([forward[i], backward[i]]) @ w["O"] + w["o"])
                total += p / p.sum()
    mean = total / len(data)
    return langs[int(mean.argmax())], float(mean.max())


def test_language_predictions_by_brute_force(spark, docs, rows):
    network = langid.fit(spark.createDataFrame([(i, ("der und die das " if i % 2 else "the and of that ") * (3 + i), "de" if i % 2 else "en") for i in range(60)], "doc_id long, text string, lang string"))
    w = {k: v.astype(np.float64) for k, v in network.weights.items()}
    got = {r.doc_id: r for r in langid.predict(docs, network).collect() if r.doc_id is not None}
    for i, t in ids_and_texts(rows):
        if i is not None and len(t or "") < 2500:
            want = slow_label(t.encode(), network.langs, w) if t and any(c.isalpha() for c in t) else ("und", 0.0)
            assert got[i].lang_pred == want[0] and abs(got[i].score - want[1]) < 1e-3


def test_toxicity_scores_by_brute_force(docs, rows):
    import re

    words = sorted({w for _, t in ids_and_texts(rows) for w in re.findall(r"\w+", (t or "").lower())})[::9]
    rng = random.Random(3)
    model = toxicity.Model({w: rng.uniform(-2, 4) for w in words} | {"^" + w[:4]: 1.5 for w in words[::5] if len(w) > 5}, -3.0, -4.0)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect() if r.doc_id is not None}
    told = 0
    for i, t in ids_and_texts(rows):
        if i is None:
            continue
        clean, flagged, best = 1 - 1 / (1 + np.exp(4.0)), 0, 1 / (1 + np.exp(4.0))
        for sentence in re.split(r"[.!?\n]", (t or "").lower()):
            found = {f for w in re.findall(r"\w+", sentence) for f in (w, "^" + w[:4] if len(w) > 5 else w) if f in model.weights}
            if found:
                p = 1 / (1 + np.exp(3.0 - sum(model.weights[f] for f in found)))
                clean, flagged, best = clean * (1 - p), flagged + (p >= 0.5), max(best, p)
        assert abs(got[i].score - (1 - clean)) < 1e-9 and got[i].n_flagged == flagged and abs(got[i].worst_score - best) < 1e-9
        assert got[i].predicted == int(got[i].score >= 0.5)
        told += flagged > 0
    assert told > 5


def test_toxicity(spark, docs, none, rows):
    rng = random.Random(1)
    plain = [f"w{rng.randrange(300)}" for _ in range(5000)]
    bad = ["vile", "nasty", "loathsome"]
    bags = []
    for i in range(400):
        words = [rng.choice(plain) for _ in range(60)]
        words[10::13] = [w + "." for w in words[10::13]]
        if i % 5 == 0:
            words[rng.randrange(60)] = rng.choice(bad)
        bags.append((int(i % 5 == 0), " ".join(words)))
    model = toxicity.train(bags)
    assert sum((toxicity.score_text(t, model)[0] >= 0.5) == bool(y) for y, t in bags) > 395
    score, _, lo, hi, n = toxicity.score_text("All is well. What a vile thing! Fine", model)
    assert score >= 0.5 and "What a vile thing" in "All is well. What a vile thing! Fine"[lo:hi] and n == 1
    assert toxicity.score_text("", model)[0] < 0.5 and toxicity.score_text("w1. " * 3000, model)[0] < 0.5
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) and toxicity.score(none, model).count() == 0
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (5, None), (99999, 1)], "doc_id long, label int")
    assert toxicity.fit(none, labels).weights == {} and toxicity.fit(docs, labels.limit(0)).weights == {}


def test_toxicity_held_out(spark):
    sf_dir = "/root/testdata/sf0.1"
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = common.table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    told = toxicity.score(docs, toxicity.fit(docs, labels.where(part != 0))).join(labels.where(part == 0), "doc_id")
    hit, miss = told.where("label = 1 and predicted = 1").count(), told.where("label = 1 and predicted = 0").count()
    assert hit > 0.8 * (hit + miss)
    assert told.where("label = 0 and predicted = 1").count() < 0.02 * told.count()


# ------------------------------------------------------------------ neighbours, fingerprints


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 16)).round(2)
    x[100:400] = x[100]
    x[400] = 0
    rows = [(i, v.tolist(), "z", "e") for i, v in enumerate(x)]
    rows += [(5000, None, "z", "e"), (5100, [], "z", "e"), (5200, [float("nan")] * 16, "z", "e"), (5300, [None] * 16, "z", "e"), (5400, [1.0], "z", "e"), (None, x[7].tolist(), "z", "e"), (7, x[7].tolist(), "z", "e")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, ids string, cell string")
    got = annsearch.search(df, F.col("vec_id") % 100 == 0).toPandas()
    queries = [i for i in range(0, 3000, 100) if i != 400]
    assert sorted(got.query_id.unique()) == queries
    usable = np.array([i for i in range(3000) if i != 400])
    hits = 0
    for q in queries:
        dist = np.sqrt(((x[usable] - x[q]) ** 2).sum(1))
        order = [i for i in np.lexsort((usable, dist)) if usable[i] != q][:10]
        mine = got[got.query_id == q].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 11)) and mine.score.is_monotonic_increasing
        hits += len(set(mine.vec_id) & set(usable[order]))
    assert hits >= 0.9 * 10 * len(queries)
    assert got[got.query_id == 100].vec_id.tolist() == list(range(101, 111))
    assert annsearch.search(df.limit(0), F.lit(True)).count() == 0
    few = annsearch.search(df.where("vec_id in (0, 1, 2)"), F.col("vec_id") == 0).collect()
    assert sorted(r.vec_id for r in few) == [1, 2]


def test_chi_square():
    assert abs(annsearch.chi_square_quantile(0.95) - 12.5916) < 1e-3


def test_equal_pairs():
    x = np.random.default_rng(0).integers(0, 5, 300).astype(np.uint8)
    for n in (12, 64):
        got = fingerprints.equal_pairs(x, n)
        for s in range(0, len(got), 17):
            w = x[s : s + n]
            assert got[s] == sum(int(w[i] == w[j]) for i in range(n) for j in range(i))


def brute_digests(texts):
    """The ranks that `texts` have, and their digests, window by window."""
    import xxhash

    ranks, kinds = [], []
    for scale in fingerprints.SCALES:
        n = scale.window
        levels = [[sum(t[s + i] == t[s + j] for i in range(n) for j in range(i)) for s in range(len(t) - n + 1)] for t in texts]
        counts = np.bincount([x for p in levels for x in p], minlength=scale.levels)
        assert (sum(fingerprints.level_counts([t], scale) for t in texts) == counts).all() and (fingerprints.level_counts(texts, scale) == counts).all()
        order = sorted(range(scale.levels), key=lambda x: (x > scale.most_equal, counts[x], x))
        rank = {x: i for i, x in enumerate(order)}
        ranks.append(fingerprints.rarity(counts, scale))
        found = []
        for t, p in zip(texts, levels, strict=True):
            wins = [0] * len(p)
            if len(p) >= scale.run:
                for s in range(len(p) - scale.run + 1):
                    wins[min(range(s, s + scale.run), key=lambda i: (rank[p[i]], i))] += 1
            elif p:
                wins[min(range(len(p)), key=lambda i: (rank[p[i]], i))] = scale.popular
            taken = scale.least <= len(t) <= scale.most
            found.append([t[i : i + n] for i in range(len(p)) if taken and wins[i] >= scale.popular and p[i] <= scale.most_equal])
        kinds.append(found)
    want = []
    for t, *found in zip(texts, *kinds, strict=True):
        chain = []
        for features in found if any(found) else [[t] if t else []]:
            for lo in range(0, len(features), fingerprints.FILTER_FEATURES):
                part, bits = features[lo : lo + fingerprints.FILTER_FEATURES], 0
                for f in part:
                    raw = xxhash.xxh3_128_digest(f)
                    for k in range(fingerprints.HASHES):
                        bits |= 1 << (fingerprints.FILTER_BITS - 1 - int.from_bytes(raw[2 * k : 2 * k + 2], "little") % fingerprints.FILTER_BITS)
                chain.append((len(part), bits))
        want.append(chain)
    return tuple(ranks), want


def test_digests_by_brute_force():
    rng = random.Random(7)
    texts = [bytes(rng.choice(b"abcdefgh " if k % 3 else b"ab") for _ in range(rng.randint(0, 700))) for k in range(30)]
    texts += [texts[4], b"", b"abc", b"a" * 300, bytes(rng.choice(b"abcdefgh ") for _ in range(256)), bytes(rng.choice(b"abcdefgh ") for _ in range(513))]
    texts += [texts[7][:400] + texts[8][:200]]
    ranks, want = brute_digests(texts)
    assert fingerprints.digests(texts, ranks) == want
    a, b = want[7], want[-1]
    assert fingerprints.likeness(a, a) == 1.0 and 0 <= fingerprints.likeness(a, b) <= 1 and fingerprints.likeness(a, b) == fingerprints.likeness(b, a)
    ones = lambda x: bin(x).count("1")
    if len(a) == len(b) == 1:
        chance = ones(a[0][1]) * ones(b[0][1]) / fingerprints.FILTER_BITS
        most = min(ones(a[0][1]), ones(b[0][1]))
        low = chance + 0.3 * (most - chance)
        assert abs(fingerprints.likeness(a, b) - min(1, max(0, (ones(a[0][1] & b[0][1]) - low) / (most - low)))) < 1e-12


def test_short_texts_resemble_their_edited_texts():
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(800)]
    texts = [" ".join(rng.choices(words, k=60))[:n] for n in (60, 100, 150, 200, 250, 300, 400, 500, 520, 600) for _ in range(10)]
    rng.shuffle(texts)
    raw = [t.encode() for t in texts]
    ranks = tuple(fingerprints.rarity(fingerprints.level_counts(raw, scale), scale) for scale in fingerprints.SCALES)
    changed = [fingerprints.edit(t, n).encode() for t, n in zip(texts, [*texts[1:], texts[0]], strict=True)]
    own, edited = fingerprints.digests(raw, ranks), fingerprints.digests(changed, ranks)
    assert min(fingerprints.likeness(a, b) for a, b in zip(own, edited, strict=True)) > 0.1
    assert max(fingerprints.likeness(a, b) for a, b in zip(own, own[1:], strict=False)) < 0.1


def test_fingerprints(docs, rows, none):
    assert fingerprints.edited_likeness(none).count() == 0
    got = fingerprints.edited_likeness(docs).collect()
    assert len(got) == len(rows)
    known = sorted({(i, t or "") for i, t in ids_and_texts(rows) if i is not None})
    sha = {}
    for r in got:
        if r.doc_id is not None:
            sha[r.doc_id] = r
    for (i, t), (_, n) in zip(known, known[1:], strict=False):
        if i != 12:  # a repeated row is followed by itself or by the next one
            assert sha[i].edited_sha256 == hashlib.sha256(fingerprints.edit(t, n).encode()).hexdigest()
            assert sha[i].n_chars == len(t)
    by_text = {}
    for r in got:
        if r.doc_id is not None:
            by_text.setdefault(dict(known)[r.doc_id], set()).add(r.fingerprint)
    assert all(len(f) == 1 for f in by_text.values())
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    alone = fingerprints.edited_likeness(docs.where("doc_id = 7")).first()
    assert alone.near_next == 1.0


# ------------------------------------------------------------------ pieces, chats


def test_encoding_equals_the_library(docs, rows, none):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=lattice.MODEL)
    assert lattice.encode_documents(none).count() == 0
    for cached in (20, 1 << 20):
        got = lattice.encode_documents(docs, most_cached=cached).withColumn("back", lattice.decode_ids(F.col("ids"))).collect()
        assert len(got) == len(rows)
        known = {i: t for i, t in ids_and_texts(rows) if i is not None}
        for r in got:
            if r.doc_id is not None:
                t = known[r.doc_id]
                assert r.ids == (None if t is None else model.encode(t))
                assert r.back == (None if t is None else t.replace(lattice.SPACE, " "))
                assert r.decodes is (None if t is None else True)


def test_unigram_pieces_take_the_best_path(spark):
    rng = random.Random(8)
    names = ["▁", *"abcde", *sorted({"".join(rng.choice("▁abcde" if k == 0 else "abcde") for k in range(rng.randint(2, 5))) for _ in range(120)})]
    scores = {p: -rng.random() * 3 * len(p) - 0.5 for p in names}
    for byte in ({}, {b: 1000 + b for b in range(256)}):
        pieces = lattice.Pieces({p: i + 1 for i, p in enumerate(names)}, scores, byte, 0, 1300)
        assert pieces.unigram

        def best(unit, pieces=pieces):
            paths = [(0.0, [])]
            for e in range(1, len(unit) + 1):
                reach = [(paths[s][0] + scores.get(unit[s:e], pieces.penalty if e - s == 1 else -1e9), s) for s in range(e)]
                top = max(reach, key=lambda x: (x[0], -x[1]))  # ties: the edge that starts first
                paths.append((top[0], [*paths[top[1]][1], unit[top[1] : e]]))
            return [i for p in paths[-1][1] for i in pieces.ids_of(p)]

        texts = ["", "a", "x", None, "é abc", *[" ".join("".join(rng.choice("abcdex") for _ in range(rng.randint(1, 9))) for _ in range(12)) for _ in range(40)]]
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        for cached in (5, 1 << 20):
            got = {r.doc_id: r for r in lattice.encode_documents(df, pieces, most_cached=cached).collect()}
            for i, t in enumerate(texts):
                assert got[i].ids == (None if t is None else [x for u in pieces.units(t) for x in best(u)])
                if byte and t is not None:
                    assert got[i].decodes


def test_word_arrays():
    pieces = lattice.Pieces.of_file()
    rng = random.Random(1)
    texts = ["", " ", "  ", "▁", "\n", "\n\n a", "a  b", "a ▁b", "a\n b  c\n\nd ", "▁▁ a", "a ", "x▁"]
    texts += ["".join(rng.choice(" ab\n▁é.,") for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    got = {}
    for rows, words, counts in pieces.word_arrays(lattice.pa.array(texts)):
        ends = np.cumsum(counts)
        got |= {r: words.to_pylist()[e - c : e] for r, c, e in zip(rows[:300], counts, ends, strict=False)}
    assert len(got) > 300 and all(got[r] == pieces.words(texts[r]) for r in got)


def test_viterbi_fold(spark):
    scores = {"a": -1.0, "b": -1.0, "c": -1.0, "ab": -1.5, "bc": -1.2, "abc": -4.0}

    def best(u):
        return max(((sum(scores[p] for p in path), path) for path in paths(u)), key=lambda x: x[0])[0]

    def paths(u):
        if not u:
            return [[]]
        return [[u[:k], *rest] for k in range(1, len(u) + 1) if u[:k] in scores for rest in paths(u[k:])]

    for u in ("abc", "abcabc", "cab", "bbca"):
        edges = sorted((e, s, scores[u[s:e]]) for s in range(len(u)) for e in range(s + 1, len(u) + 1) if u[s:e] in scores)
        df = spark.createDataFrame([(edges, len(u))], "edges array<struct<e: int, s: int, score: double>>, n int")
        cuts = df.select(lattice.viterbi_fold(F.col("edges")).alias("c")).first().c
        assert abs(sum(scores[u[a:b]] for a, b in zip(cuts, cuts[1:], strict=False)) - best(u)) < 1e-9


def test_chat_collapse(spark):
    turns = [("user", "hi"), ("assistant", "hello"), ("user", None)]
    rows = [(c, k, *turns[k], "x") for c, n in ((5, 1), (3, 2), (9, 3), (4, 3)) for k in range(n)]
    rows += [(None, 0, "user", "hi", "x"), (20, 0, "user", "other<|im_end|>", "x"), (21, 0, "user", "hi", "x"), (21, 0, "user", "hi", "x"), (22, None, None, None, "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, at string")
    got = {r.conv_id: r for r in chatformat.collapse(df).collect()}
    assert sorted(got) == [4, 20, 21, 22] and got[4].turns == 3
    assert got[4].rendered == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nhello<|im_end|>\n<|im_start|>user\n<|im_end|>\n"
    assert "other<im_end><|im_end|>" in got[20].rendered and got[22].rendered.startswith("<|im_start|>unknown")
    assert chatformat.collapse(df.limit(0)).count() == 0


def test_chats_by_brute_force(spark):
    rng = random.Random(9)
    talk = [(rng.choice(["user", "assistant"]), f"t{rng.randrange(3)}") for _ in range(2500)]
    chats = {1: talk, 2: talk[:-1], 3: talk, 4: talk[:1200], 5: [*talk[:1200], ("user", "else")], 6: [("user", "x" * 400_000)], 7: [("user", "x" * 400_000), ("assistant", "y")], 8: talk[1:]}
    chats |= {c: [(rng.choice("ab"), rng.choice(["p", "q", None])) for _ in range(rng.randint(1, 5))] for c in range(20, 80)}
    rows = [(c, k, role, text) for c, turns in chats.items() for k, (role, text) in enumerate(turns)]
    rng.shuffle(rows)
    got = {r.conv_id: (r.turns, r.rendered) for r in chatformat.collapse(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)).collect()}
    want = {}
    for c, turns in chats.items():
        longer = any(len(o) > len(turns) and o[: len(turns)] == turns for o in chats.values())
        if not longer and not any(o == turns and d < c for d, o in chats.items()):
            want[c] = (len(turns), "".join(f"<|im_start|>{r}\n{t or ''}<|im_end|>\n" for r, t in turns))
    assert got == want and 5 in want and 2 not in want


def test_mix_emits_rows_not_ids(spark):
    rows = [(i % 40, f"{'w ' * (i % 13)}{i}", "ab"[i % 2], i) for i in range(400)] + [(7, "same same", "a", 1)] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int")
    out, told = mixing.emit(df), mixing.mix(df)
    assert out.columns == df.columns
    by_id = {r.doc_id: r.n for r in told.groupBy("doc_id").agg(F.sum("copies").alias("n")).collect() if r.n}
    assert {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()} == by_id
    assert out.where("text <> 'same same'").groupBy(*out.columns).count().agg(F.max("count")).first()[0] <= 3
