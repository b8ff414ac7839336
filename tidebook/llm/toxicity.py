"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.llm.common import keep, map_texts, sampled

#: Labelled documents that the model is fitted on, at most; parts of so many are fitted in parallel and averaged.
SAMPLE_ROWS = 36_000
SHARD_ROWS = 6_000
EPOCHS = 8
ALPHA, BETA, L1, L2 = 1.0, 1.0, 4.0, 0.1
#: Documents of a shard that have to hold a feature for it to take part.
MIN_DOCUMENTS = 5
#: What a clean document taken for a toxic one costs against the reverse, where the threshold is set.
FALSE_ALARM = 2
#: One document in HELD_OUT is never learned from.
HELD_OUT = 5

_NOT_LETTERS = bytes(b for b in range(128) if not chr(b).isalnum())
_TO_WORDS = bytes.maketrans(_NOT_LETTERS, b" " * len(_NOT_LETTERS))


def text_features(text: str) -> np.ndarray:
    """Distinct 64-bit hashes of words, pairs of neighbours, and pairs with one word skipped between them."""
    words = text.encode("utf-8", "surrogatepass").lower().translate(_TO_WORDS).split()
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    return np.unique(np.concatenate(_grams(h)))


def _grams(h: np.ndarray) -> list[np.ndarray]:
    mix = h * np.uint64(0x9E3779B97F4A7C15)
    mix ^= mix >> np.uint64(32)
    pairs = (mix[:-1] + h[1:]) * np.uint64(0xD6E8FEB86659FD93)
    skips = (mix[:-2] + h[2:]) * np.uint64(0xA0761D6478BD642F)
    return [h, pairs ^ (pairs >> np.uint64(29)), skips ^ (skips >> np.uint64(29))]


@dataclass
class Model:
    """Sorted feature hashes with their weights, and the weight of the constant."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float

    def __post_init__(self):
        self.flags = np.zeros(1 << 16, dtype=bool)
        self.flags[(self.keys >> np.uint64(48)).astype(np.int64)] = True

    def logit(self, text: str) -> float:
        """Sum of the weights of the text's features. The flags by leading bits spare the look-up of most of them."""
        words = text.encode("utf-8", "surrogatepass").lower().translate(_TO_WORDS).split()
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
        total = self.bias
        if len(self.keys):
            grams = np.concatenate(_grams(h))
            grams = np.unique(grams[self.flags[(grams >> np.uint64(48)).astype(np.int64)]])
            at = np.searchsorted(self.keys, grams)
            hit = self.keys[np.minimum(at, len(self.keys) - 1)] == grams
            total += float(self.weights[at[hit]].sum())
        return total

    def score(self, text: str) -> float:
        """Probability of label 1."""
        return float(1 / (1 + np.exp(-min(max(self.logit(text), -60.0), 60.0))))


def _frequent(rows: list[np.ndarray]) -> list[np.ndarray]:
    """Features that enough of the rows have: the others could only learn single documents by heart."""
    keys, documents = np.unique(np.concatenate(rows), return_counts=True)
    keys = keys[documents >= MIN_DOCUMENTS]
    if not len(keys):
        return [r[:0] for r in rows]
    return [r[keys[np.minimum(np.searchsorted(keys, r), len(keys) - 1)] == r] for r in rows]


def ftrl(rows: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, float]:
    """Feature hashes with non-zero weight, their weights and the bias, after some passes over the rows in their order.

    Every coordinate has a rate of its own from the squared gradients it has seen; a weight is exactly zero until its
    summed gradients pass the L1 bound. The constant has no such bound.
    """
    keys, inverse = np.unique(np.concatenate(rows), return_inverse=True)
    parts = np.split(inverse, np.cumsum([len(r) for r in rows])[:-1])
    z, n = np.zeros(len(keys) + 1), np.zeros(len(keys) + 1)
    parts = [np.append(p, len(keys)) for p in parts]
    bound = np.full(len(keys) + 1, L1)
    bound[-1] = 0

    def weights(at):
        zi = z[at]
        raw = -(zi - np.sign(zi) * bound[at]) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        return np.where(np.abs(zi) > bound[at], raw, 0.0)

    for _ in range(epochs):
        for at, label in zip(parts, labels, strict=True):
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -60, 60))) - label
            root = np.sqrt(n[at])
            z[at] += g - (np.sqrt(n[at] + g * g) - root) / ALPHA * w
            n[at] += g * g
    w = weights(np.arange(len(keys) + 1))
    used = np.flatnonzero(w[:-1])
    return keys[used], w[used], float(w[-1])


def held_out() -> Column:
    """True for documents that are never learned from; a null id is not held out, and has no label either."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % HELD_OUT == 0, F.lit(False))


def threshold(logits: np.ndarray, labels: np.ndarray) -> float:
    """The cheapest cut between the labels, in the middle of the gap it lies in; 0 if there is one label only."""
    if not 0 < labels.sum() < len(labels):
        return 0.0
    order = np.argsort(logits, kind="stable")
    ordered, toxic = logits[order], labels[order].astype(int)
    missed = np.concatenate([[0], np.cumsum(toxic)])
    alarms = np.concatenate([np.cumsum((1 - toxic)[::-1])[::-1], [0]])
    cost = missed + FALSE_ALARM * alarms
    edges = np.concatenate([[ordered[0] - 1], ordered, [ordered[-1] + 1]])
    best = np.flatnonzero(cost == cost.min())
    widest = best[np.argmax(edges[best + 1] - edges[best])]
    return float((edges[widest] + edges[widest + 1]) / 2)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from at most ``sample_rows`` labelled documents outside the held-out part, chosen by a hash of their id.

    Every shard is fitted in a task of its own from its share of the sample and the weights are averaged. As toxic
    documents are few, a logistic model sets its constant low; it is moved so that a score of one half is the cheapest
    cut between the labels of the sample. Of several labels of a document the highest counts, null ones are left out.
    A shard with one label only adds nothing; without both labels every score is one half.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    sample = keep(sampled(known, sample_rows, "doc_id"), "toxic-sample")
    shards = max(1, math.ceil(sample.count() / SHARD_ROWS))
    rows = docs.select("doc_id", "text").join(sample, "doc_id").select(
        "doc_id", "text", "label", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(shards)).alias("shard")
    )
    rows = keep(rows, "toxic-texts")

    def train(part: pd.DataFrame) -> pd.DataFrame:
        part = part.drop_duplicates("doc_id")
        order = [xxhash.xxh3_64_intdigest(str(i)) for i in part["doc_id"]]
        part = part.iloc[np.argsort(order, kind="stable")]
        y = part["label"].to_numpy()
        if not 0 < y.sum() < len(y):
            return pd.DataFrame({"key": np.zeros(1, np.int64), "weight": 0.0, "bias": 0.0})
        keys, w, bias = ftrl(_frequent([text_features(t or "") for t in part["text"]]), y)
        return pd.DataFrame(
            {"key": np.append(keys.view(np.int64), 0), "weight": np.append(w, 0.0), "bias": np.append(np.zeros(len(w)), bias)}
        )

    found = rows.groupBy("shard").applyInPandas(train, "key long, weight double, bias double")
    # the L1 bound leaves few weights, at most the features of the sample
    merged = found.groupBy("key").agg(F.sum("weight").alias("weight"), F.sum("bias").alias("bias")).toPandas()
    bias = float(merged["bias"].sum()) / shards
    merged = merged[merged["weight"] != 0]
    keys = merged["key"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(keys)
    model = Model(keys[order], merged["weight"].to_numpy(dtype=float)[order] / shards, bias)
    logits = map_texts(rows, lambda: lambda texts: [[model.logit(t) for t in texts]], "logit double")
    seen = logits.join(sample, "doc_id").select("logit", "label").toPandas()
    return replace(model, bias=bias - threshold(seen["logit"].to_numpy(dtype=float), seen["label"].to_numpy(dtype=int)))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every whole text; one row per row of ``docs``.

    A null or empty text gets the score of the constant alone. Only the text is an input of a score.
    """
    found = map_texts(docs, lambda: lambda texts: [[model.score(t) for t in texts]], "score double")
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Fit on the labelled part and score all documents."""
    return scored(docs, fit(docs, labels, sample_rows=sample_rows))
