"""Language identification with a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time on windows of labelled documents. It
labels every byte position of a text; a document's probabilities are the mean over its positions. Texts
are cut into segments of SEGMENT bytes that run side by side, each with CONTEXT bytes of its neighbours
on both sides to warm the states up; the labels of those extra positions do not count.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockwell.llm.common import small_batches

SEGMENT, CONTEXT = 112, 8
HIDDEN, EMBED = 8, 8
#: At most SAMPLE documents of each language, and PIECES windows of each, are learned from.
SAMPLE, PIECES = 160, 4
STEPS, BATCH, RATE = 480, 64, 0.02
#: Segments that run side by side.
LANES = 2048


@dataclass
class Network:
    langs: list[str]
    weights: dict[str, np.ndarray]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _init(classes: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    h, e = HIDDEN, EMBED
    w = {"E": rng.normal(0, 0.5, (257, e))}
    for d in "fb":
        w |= {f"W{d}": rng.normal(0, e**-0.5, (e, 3 * h)), f"U{d}": rng.normal(0, h**-0.5, (h, 2 * h)), f"V{d}": rng.normal(0, h**-0.5, (h, h)), f"c{d}": np.zeros(3 * h)}
    w |= {"O": rng.normal(0, (2 * h) ** -0.5, (2 * h, classes)), "o": np.zeros(classes)}
    return {k: v.astype(np.float32) for k, v in w.items()}


def _run(x: np.ndarray, w: dict, d: str, keep: bool):
    """Gated recurrent pass over x (time, lanes) of byte values, 256 for none, in the order given."""
    h = HIDDEN
    table = w["E"] @ w[f"W{d}"] + w[f"c{d}"]
    state = np.zeros((x.shape[1], h), np.float32)
    states, saved = np.empty((x.shape[0], x.shape[1], h), np.float32), []
    U, V = w[f"U{d}"], w[f"V{d}"]
    table[:, : 2 * h] *= 0.5
    U = U * np.float32(0.5)
    table = table.astype(np.float32)
    for t in range(x.shape[0]):
        a = table[x[t]]
        g = state @ U
        g += a[:, : 2 * h]
        np.tanh(g, out=g)
        g *= 0.5
        g += 0.5
        z, r = g[:, :h], g[:, h:]
        rs = r * state
        n = rs @ V
        n += a[:, 2 * h :]
        np.tanh(n, out=n)
        if keep:
            saved.append((state, z.copy(), r.copy(), n.copy(), rs))
        new = n - state
        new *= z
        new += state
        state = states[t] = new
    return states, saved


def _softmax(s: np.ndarray) -> np.ndarray:
    s = np.exp(s - s.max(-1, keepdims=True))
    return s / s.sum(-1, keepdims=True)


def _back(x, w, d, saved, dstates, grads) -> None:
    h = HIDDEN
    U, V = w[f"U{d}"], w[f"V{d}"]
    carry = np.zeros_like(dstates[0])
    emb_grad, W_grad = grads["E"], grads[f"W{d}"]
    for t in range(x.shape[0] - 1, -1, -1):
        state, z, r, n, rs = saved[t]
        ds = dstates[t] + carry
        dn = ds * z * (1 - n * n)
        dz = ds * (n - state) * z * (1 - z)
        drs = dn @ V.T
        dr = drs * state * r * (1 - r)
        dg = np.concatenate([dz, dr], 1)
        grads[f"U{d}"] += state.T @ dg
        grads[f"V{d}"] += rs.T @ dn
        da = np.concatenate([dg, dn], 1)
        grads[f"c{d}"] += da.sum(0)
        e = w["E"][x[t]]
        W_grad += e.T @ da
        np.add.at(emb_grad, x[t], da @ w[f"W{d}"].T)
        carry = ds * (1 - z) + drs * r + dg @ U.T


def train(pieces: list[bytes], labels: list[int], classes: int, seed: int = 7) -> dict[str, np.ndarray]:
    """Adam on the mean cross-entropy of all positions of the pieces (each SEGMENT bytes at most)."""
    rng = np.random.default_rng(seed)
    w = _init(classes, rng)
    m = {k: np.zeros_like(v) for k, v in w.items()}
    v2 = {k: np.zeros_like(v) for k, v in w.items()}
    x_all = np.full((SEGMENT, len(pieces)), 256, np.int64)
    for i, p in enumerate(pieces):
        x_all[: len(p), i] = np.frombuffer(p, np.uint8)
    y_all = np.array(labels)
    for step in range(STEPS):
        pick = rng.integers(0, len(pieces), BATCH)
        x, y = x_all[:, pick], y_all[pick]
        real = (x < 256).astype(np.float32)[..., None]
        f, fs = _run(x, w, "f", True)
        b, bs = _run(x[::-1], w, "b", True)
        both = np.concatenate([f, b[::-1]], -1)
        p = _softmax(both @ w["O"] + w["o"])
        dp = p.copy()
        dp[:, np.arange(BATCH), y] -= 1
        dp *= real / max(1.0, float(real.sum()))
        grads = {k: np.zeros_like(a) for k, a in w.items()}
        grads["O"] = np.tensordot(both, dp, ((0, 1), (0, 1)))
        grads["o"] = dp.sum((0, 1))
        dboth = dp @ w["O"].T
        _back(x, w, "f", fs, dboth[..., :HIDDEN], grads)
        _back(x[::-1], w, "b", bs, dboth[::-1, :, HIDDEN:], grads)
        norm = float(np.sqrt(sum(float((g * g).sum()) for g in grads.values())))
        scale = min(1.0, 1.0 / max(norm, 1e-9))
        rate = RATE * (1 - step / STEPS) + 1e-4
        for k, g in grads.items():
            g = g * scale
            m[k] = 0.9 * m[k] + 0.1 * g
            v2[k] = 0.99 * v2[k] + 0.01 * g * g
            w[k] = (w[k] - rate * (m[k] / (1 - 0.9 ** (step + 1))) / (np.sqrt(v2[k] / (1 - 0.99 ** (step + 1))) + 1e-8)).astype(np.float32)
    return w


def label_positions(x: np.ndarray, w: dict[str, np.ndarray]) -> np.ndarray:
    """Probabilities (time, lanes, classes) of each position of x (time, lanes)."""
    f, _ = _run(x, w, "f", False)
    b, _ = _run(x[::-1], w, "b", False)
    h = HIDDEN
    s = f @ w["O"][:h]
    s += (b @ w["O"][h:])[::-1]
    s += w["o"]
    np.exp(s, out=s)  # states stay within -1 and 1, so scores are small
    s /= s.sum(-1, keepdims=True)
    return s


def document_probabilities(texts: list[bytes], w: dict[str, np.ndarray]) -> np.ndarray:
    """Mean probabilities over all bytes of each text; zeros for an empty one."""
    classes = len(w["o"])
    total = np.zeros((len(texts), classes))
    sizes = np.array([len(t) for t in texts], np.int64)
    # All texts in a row, each with CONTEXT empty positions around it, cut into lanes by index arithmetic.
    gap = np.full(CONTEXT, 256, np.int16)
    flat = np.concatenate([a for t in texts for a in (gap, np.frombuffer(t, np.uint8).astype(np.int16))] + [np.full(CONTEXT + SEGMENT, 256, np.int16)]) if texts else gap
    begin = np.cumsum(sizes + CONTEXT) - sizes
    lanes_of = -(-sizes // SEGMENT)
    owner = np.repeat(np.arange(len(texts)), lanes_of)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(lanes_of) - lanes_of, lanes_of)
    at = begin[owner] + nth * SEGMENT
    stop = begin[owner] + sizes[owner]
    span = np.arange(-CONTEXT, SEGMENT + CONTEXT)[:, None]
    for lo in range(0, len(owner), LANES):
        here = slice(lo, lo + LANES)
        where = at[here] + span
        x = flat[np.minimum(where, len(flat) - 1)]
        x[where >= stop[here]] = 256
        p = label_positions(x, w)[CONTEXT : CONTEXT + SEGMENT]
        p *= (x[CONTEXT : CONTEXT + SEGMENT] < 256)[..., None]
        np.add.at(total, owner[here], p.sum(0))
    return total / np.maximum(sizes, 1)[:, None]


def sample(rows: DataFrame, per_lang: int = SAMPLE) -> list[tuple[str, list[bytes]]]:
    """(lang, windows of PIECES places in a text) of at most `per_lang` texts of each language: the smallest hash of an id in each of so many buckets.

    Minima aggregate before the shuffle, so no language is gathered anywhere, however many rows it has.
    """
    keyed = rows.select("lang", F.xxhash64("doc_id").alias("x"), "text").where("lang is not null and text is not null")
    keyed = keyed.withColumn("bucket", F.pmod("x", F.lit(per_lang)))
    least = keyed.groupBy("lang", "bucket").agg(F.min("x").alias("x"))
    got = keyed.join(F.broadcast(least), ["lang", "bucket", "x"])
    unique = got.groupBy("lang", "x").agg(F.min("text").alias("text"))
    room = F.greatest(F.octet_length("text") - SEGMENT, F.lit(0))
    places = [F.floor(room * k / F.lit(max(1, PIECES - 1))).cast("int") + 1 for k in range(PIECES)]
    windows = F.array(*[F.substring(F.col("text").cast("binary"), at, F.lit(SEGMENT)) for at in places])
    return sorted((r.lang, [bytes(w) for w in r.windows]) for r in unique.select("lang", windows.alias("windows")).collect())


def fit(rows: DataFrame, per_lang: int = SAMPLE) -> Network:
    """Learn from the text and lang of `rows` (doc_id only picks the bounded sample)."""
    got = sample(rows, per_lang)
    langs = sorted({lang for lang, _ in got})
    pieces, labels = [], []
    for lang, windows in got:
        for data in windows:
            if data.strip():
                pieces.append(data)
                labels.append(langs.index(lang))
    return Network(langs if pieces else [], train(pieces, labels, len(langs)) if pieces else {})


def predict(docs: DataFrame, network: Network, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, lang_pred, score for every row of `docs`.

    `und` with score 0 if the text is null or has no letter, or nothing was learned. Ties go to the
    language first in code point order. Every position of a text is labelled, however long. Repeated rows
    stay; an empty table gives an empty result; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(network)

    @F.pandas_udf("lang_pred string, score double")
    def label(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        net = shared.value
        for column, letters in parts:
            texts = [t.encode() if ok else b"" for t, ok in zip(column, letters, strict=True)]
            pred, score = ["und"] * len(texts), np.zeros(len(texts))
            known = [i for i, t in enumerate(texts) if t and net.langs]
            lo = 0
            while lo < len(known):
                hi, size = lo, 0
                while hi < len(known) and size < 1 << 21:
                    size += len(texts[known[hi]])
                    hi += 1
                mean = document_probabilities([texts[i] for i in known[lo:hi]], net.weights)
                for i, p in zip(known[lo:hi], mean, strict=True):
                    pred[i], score[i] = net.langs[int(p.argmax())], min(1.0, float(p.max()))
                lo = hi
            yield pd.DataFrame({"lang_pred": pd.Series(pred, dtype=object), "score": score})

    text = F.col(text_col)
    told = label(F.coalesce(text, F.lit("")), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)))
    return docs.select(F.col(id_col).alias("doc_id"), told.alias("r")).select("doc_id", "r.*")
