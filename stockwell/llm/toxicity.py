"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence with features that were learned has a logistic score from
them, and the document's probability is the noisy-or of these scores and of a leak that every document has,
1 - (1 - leak) * prod(1 - p). A sentence without evidence adds nothing, so length alone makes no text
suspect. Only documents have labels: gradients flow through the noisy-or to the sentences, whose scores then
locate what offends. What is fitted is what scores.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stockwell.llm.common import small_batches

#: At most SAMPLE documents of each label are learned from, all of LONGEST code points at most.
SAMPLE, LONGEST = 2500, 200_000
#: A feature must be in so many documents, and so much more often in one label than chance, to be learned.
LEAST_DOCS, LEAST_Z = 3, 5.0
STEPS, RATE, DECAY = 200, 0.05, 1e-3

_SENTENCE = re.compile(r"[^.!?\n]+")
_TOKEN = re.compile(r"\w+")


@dataclass
class Model:
    weights: dict[str, float]  # of whole words and of "^" + the first four letters
    bias: float  # of every sentence with a feature
    leak: float = -6.0  # log odds


def sentences(text: str) -> list[tuple[int, int]]:
    """(begin, end) of each sentence that has a character other than white space."""
    return [m.span() for m in _SENTENCE.finditer(text) if m.group().strip()]


def features(words) -> set[str]:
    """A sentence's features: its words and the beginnings of longer ones, each once."""
    out = set(words)
    out.update("^" + w[:4] for w in words if len(w) > 5)
    return out


def _tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def sample(rows: DataFrame, labels: DataFrame, per_label: int = SAMPLE) -> list[tuple[int, str]]:
    """At most `per_label` (label, text) of each label 0 and 1: the smallest hash in each of so many buckets of ids.

    `labels`: doc_id, label. The chosen ids are a table of 2 x per_label rows at most, so it is broadcast.
    """
    known = labels.where("label in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    rows = rows.where(F.length("text") <= LONGEST)
    known = known.join(rows.select("doc_id").distinct(), "doc_id", "left_semi")
    keyed = known.withColumn("x", F.xxhash64("doc_id")).withColumn("bucket", F.pmod("x", F.lit(per_label)))
    chosen = keyed.groupBy("label", "bucket").agg(F.min("x").alias("x"), F.min_by("doc_id", "x").alias("doc_id")).select("label", "doc_id")
    got = rows.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where("text is not null")
    got = got.groupBy("doc_id").agg(F.max("label").alias("label"), F.min("text").alias("text"))
    return sorted((r.label, r.text) for r in got.select("label", "text").toLocalIterator())


def train(bags: list[tuple[int, str]]) -> Model:
    """Gradient descent on the likelihood of the documents' labels under the noisy-or."""
    positive = sum(y for y, _ in bags)
    rate = min(max(positive / max(1, len(bags)), 1e-3), 1 - 1e-3)
    in_docs: tuple[Counter, Counter] = (Counter(), Counter())
    for y, text in bags:
        in_docs[y].update(features(_tokens(text)))
    prior = {}
    n = (max(1, len(bags) - positive), max(1, positive))
    for f, a in in_docs[1].items():
        b = in_docs[0][f]
        mean = (a + b) / sum(n)
        if a + b >= LEAST_DOCS and (a / n[1] - b / n[0]) > LEAST_Z * (mean * (1 - mean) * (1 / n[0] + 1 / n[1])) ** 0.5:
            prior[f] = float(np.log((a + 0.5) / (n[1] + 1)) - np.log((b + 0.5) / (n[0] + 1)))
    names = sorted(prior)
    if not positive or positive == len(bags) or not names:
        leak = float(np.log(rate / (1 - rate)) if bags else -5.0)
        return Model({}, leak, leak)
    index = {f: i for i, f in enumerate(names)}
    doc_of, sent_of, feat = [], [], []
    sent = 0
    for d, (_, text) in enumerate(bags):
        for lo, hi in sentences(text):
            known = [index[f] for f in features(_tokens(text[lo:hi])) if f in index]
            if known:
                feat += known
                sent_of += [sent] * len(known)
                doc_of.append(d)
                sent += 1
    doc_of, sent_of, feat = np.array(doc_of, np.int64), np.array(sent_of, np.int64), np.array(feat, np.int64)
    y = np.array([y for y, _ in bags], float)
    # Weights start at, and are drawn to, each feature's log odds: else one word of several explains a document away.
    w0 = np.array([prior[f] for f in names])
    w, b, leak = w0.copy(), -6.0, -6.0
    state = [np.zeros(len(names) + 2), np.zeros(len(names) + 2)]
    for step in range(STEPS):
        s = b + np.bincount(sent_of, w[feat], minlength=sent)
        p, p0 = 1 / (1 + np.exp(-s)), 1 / (1 + np.exp(-leak))
        none = np.bincount(doc_of, np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=len(bags)) + np.log1p(-p0)
        doc = np.clip(-np.expm1(none), 1e-6, 1 - 1e-6)
        # d loss / d score of a sentence = p of it times (1 - y / doc), by the noisy-or's chain rule
        push = (1 - y / doc) / len(bags)
        per_sentence = push[doc_of] * p
        g = np.append(np.bincount(feat, per_sentence[sent_of], minlength=len(names)) + DECAY * (w - w0) / len(names) ** 0.5, [per_sentence.sum(), push.sum() * p0])
        state[0] = 0.9 * state[0] + 0.1 * g
        state[1] = 0.99 * state[1] + 0.01 * g * g
        move = RATE * (state[0] / (1 - 0.9 ** (step + 1))) / (np.sqrt(state[1] / (1 - 0.99 ** (step + 1))) + 1e-9)
        w -= move[:-2]
        b -= move[-2]
        leak -= move[-1]
    return Model({f: float(x) for f, x in zip(names, w, strict=True)}, float(b), float(leak))


def fit(rows: DataFrame, labels: DataFrame, per_label: int = SAMPLE) -> Model:
    """Learn from `rows` (doc_id, text) and `labels` (doc_id, label); doc_id only joins them and picks the bounded sample."""
    return train(sample(rows, labels, per_label))


def score_text(text: str, model: Model) -> tuple[float, float, int, int, int]:
    """(score, highest sentence score, begin and end of that sentence, sentences scored 0.5 or more).

    The score is the fitted noisy-or. Without evidence: the leak, (0, 0), 0.
    """
    weights = model.weights
    base = float(1 / (1 + np.exp(-model.leak)))
    lowered = text.lower()
    if len(lowered) != len(text):  # letters whose lower case is longer: keep positions those of the text
        lowered = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    by_sentence: dict[int, set[str]] = {}
    for m in _TOKEN.finditer(lowered):
        w = m.group()
        hit = (w in weights, len(w) > 5 and "^" + w[:4] in weights)
        if hit[0] or hit[1]:
            lo = max(lowered.rfind(c, 0, m.start()) for c in ".!?\n") + 1
            s = by_sentence.setdefault(lo, set())
            if hit[0]:
                s.add(w)
            if hit[1]:
                s.add("^" + w[:4])
    none, best, begin, flagged = float(np.log1p(-base)), 0.0, 0, 0
    for lo, found in by_sentence.items():
        p = 1 / (1 + np.exp(-(model.bias + sum(weights[f] for f in found))))
        none += np.log1p(-min(p, 1 - 1e-9))
        flagged += p >= 0.5
        if p > best:
            best, begin = p, lo
    end = 0
    if best > 0:
        stop = re.compile(r"[.!?\n]").search(text, begin)
        end = stop.start() if stop else len(text)
    return float(-np.expm1(none)), float(max(best, base)), begin, end, int(flagged)


_RESULT = "score double, worst_score double, worst_begin int, worst_end int, n_flagged int, predicted int"


def score_column(spark: SparkSession, text: Column, model: Model) -> Column:
    """A struct of score, predicted (1 if score >= 0.5) and the worst sentence: see score()."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf(_RESULT)
    def run(texts: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame([score_text(t, shared.value) for t in texts], columns=["score", "worst_score", "worst_begin", "worst_end", "n_flagged"])
        out["predicted"] = (out["score"].astype(float) >= 0.5).astype("int32")
        return out

    return run(F.coalesce(text, F.lit("")))


def score(docs: DataFrame, model: Model, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, score, predicted, worst_score, worst_begin, worst_end, n_flagged for every row of `docs`.

    worst_begin and worst_end span the worst sentence (code points; 0, 0 where none has evidence). Null
    texts score like empty ones. Repeated rows stay; an empty table gives an empty result; other columns
    are ignored.
    """
    told = score_column(docs.sparkSession, F.col(text_col), model)
    return docs.select(F.col(id_col).alias("doc_id"), told.alias("r")).select("doc_id", "r.*")
