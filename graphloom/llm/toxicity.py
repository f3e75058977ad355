"""Toxicity by FTRL-proximal logistic regression.

Features are the distinct word unigrams, bigrams and skip-grams (one word left out) of
a whole text, hashed to 2**BITS slots.  Each slot has its own learning rate; L1 keeps
most weights at zero, so what is broadcast is bounded by the slots and in fact small.

The model learns from at most about SAMPLE labelled rows (a documented bound; taken by
a hash of doc_id, so equal inputs give equal models).

Cases: null and empty texts score like a text without features (the bias); null labels
are not learned from; repeated labels of a document count once, the higher one; without
labelled rows every score is 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of, mix64, uniform_hash

BITS = 20
SAMPLE = 12_000
PUNCTUATION = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def slots(text: bytes | None, bits: int = BITS) -> np.ndarray:
    """Slots of all n-grams and skip-grams of a text, with repeats."""
    words = text.lower().translate(PUNCTUATION).split() if text else []
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    a, b, c, d = MULTIPLIERS
    with np.errstate(over="ignore"):
        grams = np.concatenate([h, h[:-1] * a + h[1:] * b, h[:-2] * c + h[2:] * d])
    return (mix64(grams) >> np.uint64(64 - bits)).astype(np.int32)


class FtrlProximal:
    """McMahan et al. 2013, for rows of binary features."""

    def __init__(self, size: int, alpha: float = 2.0, beta: float = 1.0, l1: float = 6.0, l2: float = 0.1):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, features: np.ndarray, label: float) -> float:
        """One step; the last coordinate is the bias."""
        at = np.append(features, len(self.z) - 1)
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
        g = p - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g
        return p


def train(rows: list[tuple[np.ndarray, int]], bits: int = BITS, epochs: int = 4, seed: int = 7) -> tuple[np.ndarray, np.ndarray, float]:
    """(slots with a weight, their weights, bias)."""
    if not rows:
        return np.zeros(0, np.int32), np.zeros(0, np.float32), -35.0
    model = FtrlProximal(1 << bits)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)).tolist():
            model.learn(*rows[k])
    w = model.weights()
    at = np.flatnonzero(w[:-1])
    return at.astype(np.int32), w[at].astype(np.float32), float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, usable=None, sample: int = SAMPLE, bits: int = BITS):
    """A model from labelled rows; usable: a condition on doc_id that rows to learn from must meet."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where("doc_id is not null and toxic is not null")
    if usable is not None:
        known = known.where(usable(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = sample / max(1, known.count())
    some = known.where(uniform_hash(F.col("doc_id"), 6) < share)

    def featurize(batches):
        for b in batches:
            got = [np.unique(slots(t, bits)).astype(np.int32).tobytes() for t in b.column(0).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.binary()), b.column(1), b.column(2)], ["x", "y", "k"])

    kind = labels.schema["toxic"].dataType.simpleString()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(some), "doc_id")  # about `sample` rows
    samples = texts.select("text", "toxic", "doc_id").mapInArrow(featurize, f"x binary, y {kind}, k long")

    def learn(batches):
        rows = sorted((row for b in batches for row in zip(*(b.column(k).to_pylist() for k in (2, 0, 1)))), key=lambda r: r[:2])
        at, w, bias = train([(np.frombuffer(x, np.int32), int(y > 0)) for _, x, y in rows], bits)
        yield pa.RecordBatch.from_pydict({"at": pa.array([at.tobytes()], pa.binary()), "w": pa.array([w.tobytes()], pa.binary()), "bias": [bias]})

    # in one task: the driver gets the weights, not the rows
    for r in samples.repartition(1).mapInArrow(learn, "at binary, w binary, bias double").collect():
        return np.frombuffer(r["at"], np.int32), np.frombuffer(r["w"], np.float32), r["bias"]
    return train([], bits)


def score(docs: DataFrame, model, bits: int = BITS) -> DataFrame:
    """(doc_id, score) of every row of docs."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        at, w, bias = held.value
        dense = np.zeros(1 << bits, np.float32)
        dense[at] = w
        for b in batches:
            out = []
            for t in b.column(1).cast(pa.binary()).to_pylist():
                s = slots(t, bits)
                s = np.unique(s[dense[s] != 0])
                out.append(1 / (1 + np.exp(-np.clip(bias + float(dense[s].sum()), -35, 35))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64())], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def predict_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted): learned from rows whose crc32(doc_id) mod 4 is not 2."""
    model = fit(docs, labels, lambda i: fold_of(i, 4) != 2)
    out = score(docs, model)
    return out.select("doc_id", F.coalesce(fold_of(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
