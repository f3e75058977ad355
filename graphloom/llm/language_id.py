"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads every byte of a text in lower case, as UTF-8: the text is read word
by word (runs of anything but white space, whatever their length), a start byte standing
for the space before each.  Two GRUs run over a word, one each way; every position gets
class probabilities from both states.  A document's probabilities are the mean over all
its positions.  Equal words have equal outputs, so a worker computes each distinct word
once and keeps sums in a bounded cache.

Training (numpy, backpropagation through time, Adam) uses the words, cut every TRAINED
bytes, of at most about PER_LANGUAGE documents of each language, taken by a hash of
doc_id, and of each of them at most SEEN characters (documented bounds of the sample).

Cases: null texts and texts without letters are `und` with score 0; null languages are
not learned from; without any language to learn (as in an empty table) every text is
`und`; words of any length are read whole; repeated rows get equal results; of equal
probabilities the first language in order is taken; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from itertools import chain
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of, text_slices, uniform_hash

PER_LANGUAGE = 300
SEEN = 20_000
TRAINED = 32
HIDDEN = 12
CACHE = 300_000
#: Positions that are computed at a time.
CELLS = 120_000
LETTER = regex.compile(r"\p{L}")


def words_of(text: str | None) -> list[str]:
    """The words of a text; none without a letter."""
    return text.lower().split() if text and LETTER.search(text) else []


def padded(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes after a start byte, padded to the longest; lengths)."""
    lens = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    x = np.zeros((len(parts), int(lens.max()) if len(parts) else 1), np.uint8)
    x[:, 1:][np.arange(1, x.shape[1]) < lens[:, None]] = np.frombuffer(b"".join(parts), np.uint8)
    return x, lens


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.minimum(np.maximum(x, -30), 30)))


def tanh(x: np.ndarray) -> np.ndarray:
    """By exp, which numpy computes several times faster than tanh."""
    return 2 * sigmoid(2 * x) - 1


def reversed_windows(x: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Each window back to front, still aligned left."""
    at = lens[:, None] - 1 - np.arange(x.shape[1])
    return np.where(at >= 0, np.take_along_axis(x, np.maximum(at, 0), 1), 0)


class Gru:
    """One direction.  Gates z, r and candidate n; inputs are rows of `inp` by byte."""

    def __init__(self, rng, hidden: int):
        self.h = hidden
        self.inp = (rng.standard_normal((256, 3 * hidden)) * 0.3).astype(np.float32)
        self.rec = (rng.standard_normal((hidden, 3 * hidden)) / np.sqrt(hidden)).astype(np.float32)

    def params(self):
        return [self.inp, self.rec]

    def forward(self, x: np.ndarray, tape: list | None = None) -> np.ndarray:
        k = self.h
        h = np.zeros((len(x), k), np.float32)
        out = np.empty((x.shape[1], len(x), k), np.float32)
        for t in range(x.shape[1]):
            a, u = self.inp[x[:, t]], h @ self.rec
            g = sigmoid(a[:, : 2 * k] + u[:, : 2 * k])
            z, r = g[:, :k], g[:, k:]
            n = tanh(a[:, 2 * k :] + r * u[:, 2 * k :])
            if tape is not None:
                tape.append((h, z, r, n, u[:, 2 * k :]))
            h = n + z * (h - n)
            out[t] = h
        return out

    def backward(self, x: np.ndarray, tape: list, grad: np.ndarray) -> list[np.ndarray]:
        k = self.h
        d_inp, d_rec = np.zeros_like(self.inp), np.zeros_like(self.rec)
        dh = np.zeros((len(x), k), np.float32)
        for t in range(x.shape[1] - 1, -1, -1):
            h, z, r, n, un = tape[t]
            dh = dh + grad[t]
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (h - n) * z * (1 - z)
            dr = dn * un * r * (1 - r)
            da = np.concatenate([dz, dr, dn], 1)
            du = np.concatenate([dz, dr, dn * r], 1)
            np.add.at(d_inp, x[:, t], da)
            d_rec += h.T @ du
            dh = dh * z + du @ self.rec.T
        return [d_inp, d_rec]


class Network:
    def __init__(self, classes: int, hidden: int = HIDDEN, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.forth, self.back = Gru(rng, hidden), Gru(rng, hidden)
        self.out = (rng.standard_normal((2 * hidden, classes)) * 0.1).astype(np.float32)
        self.bias = np.zeros(classes, np.float32)

    def params(self):
        return [*self.forth.params(), *self.back.params(), self.out, self.bias]

    def positions(self, x: np.ndarray, lens: np.ndarray, tapes: tuple = (None, None)):
        """Class probabilities (time, window, class), the joint states, and the reversed windows."""
        rx = reversed_windows(x, lens)
        f, b = self.forth.forward(x, tapes[0]), self.back.forward(rx, tapes[1])
        at = np.maximum(lens[None, :] - 1 - np.arange(x.shape[1])[:, None], 0)
        states = np.concatenate([f, np.take_along_axis(b, at[:, :, None], 0)], 2)
        logits = states @ self.out + self.bias
        e = np.exp(logits - logits.max(2, keepdims=True))
        return e / e.sum(2, keepdims=True), states, rx, at

    def pooled(self, parts: list[bytes]) -> np.ndarray:
        """Sums of the class probabilities over the positions of each word."""
        out = np.zeros((len(parts), len(self.bias)), np.float32)
        order = sorted(range(len(parts)), key=lambda i: len(parts[i]))
        a = 0
        while a < len(order):
            b = a + 1
            while b < len(order) and (b + 1 - a) * (len(parts[order[b]]) + 1) <= CELLS:
                b += 1
            x, lens = padded([parts[i] for i in order[a:b]])
            p, *_ = self.positions(x, lens)
            mask = np.arange(x.shape[1])[:, None] < lens[None, :]
            out[order[a:b]] = (p * mask[:, :, None]).sum(0)
            a = b
        return out

    def step(self, x: np.ndarray, lens: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Gradients of the mean cross-entropy of all positions."""
        x = x[:, : int(lens.max())]
        tapes: tuple = ([], [])
        p, states, rx, at = self.positions(x, lens, tapes)
        mask = np.arange(x.shape[1])[:, None] < lens[None, :]
        d = p
        d[:, np.arange(len(x)), y] -= 1
        d *= (mask / mask.sum())[:, :, None].astype(np.float32)
        k = self.forth.h
        d_out = np.tensordot(states, d, ((0, 1), (0, 1)))
        d_states = d @ self.out.T
        d_back = np.zeros_like(d_states[:, :, k:])
        # positions beyond a window's end have no gradient, so every place is written once
        w = np.broadcast_to(np.arange(len(x)), mask.shape)[mask]
        d_back[at[mask], w] = d_states[:, :, k:][mask]
        return [*self.forth.backward(x, tapes[0], d_states[:, :, :k]), *self.back.backward(rx, tapes[1], d_back), d_out, d.sum((0, 1))]


def train(windows: list[tuple[np.ndarray, np.ndarray]], steps: int = 450, batch: int = 384, rate: float = 0.01, seed: int = 11) -> Network:
    """windows: for each class its (padded bytes, lengths); classes are drawn evenly."""
    net = Network(len(windows))
    rng = np.random.default_rng(seed)
    params, wide = net.params(), max(x.shape[1] for x, _ in windows)
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for k in range(1, steps + 1):
        y = rng.integers(0, len(windows), batch)
        pick = [int(rng.integers(0, len(windows[c][1]))) for c in y.tolist()]
        x = np.zeros((batch, wide), np.uint8)
        for k_, (c, i) in enumerate(zip(y.tolist(), pick)):
            x[k_, : windows[c][0].shape[1]] = windows[c][0][i]
        lens = np.array([windows[c][1][i] for c, i in zip(y.tolist(), pick)])
        lr = rate * min(1.0, 2 * (1 - k / (steps + 1)))
        for p, g, a, b in zip(params, net.step(x, lens, y), m, v):
            np.clip(g, -1, 1, out=g)
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p -= (lr * (a / (1 - 0.9**k)) / (np.sqrt(b / (1 - 0.99**k)) + 1e-8)).astype(np.float32)
    return net


def fit(docs: DataFrame, usable=None, per_language: int = PER_LANGUAGE) -> tuple[list[str], Network | None]:
    """(languages, network) from the texts and languages of rows for which usable(doc_id) holds."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").where("doc_id is not null and text is not null and lang is not null")
    if usable is not None:
        known = known.where(usable(F.col("doc_id")))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return [], None
    share = F.create_map(*chain.from_iterable((F.lit(k), F.lit(min(1.0, per_language / n))) for k, n in sorted(counts.items())))
    some = known.where(uniform_hash(F.col("doc_id"), 5) < share[F.col("lang")]).withColumn("text", F.left("text", F.lit(SEEN))).distinct()
    texts: dict[str, list] = {k: [] for k in sorted(counts)}
    for r in sorted(some.select("lang", "doc_id", "text").collect(), key=lambda r: (r.doc_id, r.text)):
        texts[r["lang"]].append(r["text"])
    windows, languages = [], []
    for lang, group in texts.items():
        raw = [w.encode() for t in group for w in words_of(t)]
        x, lens = padded([w[a : a + TRAINED] for w in raw for a in range(0, len(w), TRAINED)])
        if len(lens):
            windows.append((x, lens))
            languages.append(lang)
    return languages, train(windows) if languages else None


def classify(docs: DataFrame, model: tuple[list[str], Network | None]) -> DataFrame:
    """(doc_id, lang_pred, score) of every row of docs."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        languages, net = held.value
        at: dict[str, int] = {}
        sums = np.zeros((0, max(1, len(languages))), np.float32)
        size = np.zeros(0, np.float32)
        for b in batches:
            texts, pred, score = b.column(1).to_pylist(), [], []
            for lo, hi in text_slices(texts):
                runs = [words_of(t) if net is not None else [] for t in texts[lo:hi]]
                if len(at) > CACHE:
                    at, sums, size = {}, sums[:0], size[:0]
                if new := [r for r in set(chain.from_iterable(runs)) if r not in at]:
                    parts = [r.encode() for r in new]
                    got = net.pooled(parts)
                    at.update(zip(new, range(len(at), len(at) + len(new))))
                    sums = np.concatenate([sums, got])
                    size = np.concatenate([size, np.fromiter((len(r) + 1 for r in parts), np.float32, len(parts))])
                for r in runs:
                    if not r:
                        pred.append("und")
                        score.append(0.0)
                        continue
                    i = np.fromiter(map(at.__getitem__, r), np.int64, len(r))
                    p = sums[i].sum(0, dtype=np.float64) / size[i].sum(dtype=np.float64)
                    pred.append(languages[int(p.argmax())])
                    score.append(float(min(1.0, p.max())))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def identify_language(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learned from rows whose crc32(doc_id) mod 5 is not 0."""
    out = classify(docs, fit(docs, lambda i: fold_of(i, 5) != 0))
    return out.select("doc_id", F.coalesce(fold_of(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")
