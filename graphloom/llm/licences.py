"""Licence scan: a trained paragraph classifier, confirmed by templates.

A paragraph is a run of lines between blank lines; a line that ends a sentence ends it
too, so wrapped lines are read as one.  Where a joined paragraph is unknown, its lines
are tried alone.  Its features are hashed word unigrams, bigrams and
trigrams; a multinomial logistic regression with L1 (sparse weights) tells licence
families and `unknown` apart.  It is trained here: on the templates below, cut, joined
and worn down at random, against paragraphs of the corpus that share little with any
template.  A temperature fitted on held-out paragraphs calibrates the probabilities, so
`unknown` takes what the families cannot claim.  A predicted family is confirmed when
enough of the word trigrams of one of its templates lie in the paragraph, or the other
way round.

The corpus gives at most about NEGATIVES documents, and of each at most SEEN characters,
for training (documented bounds of the sample).

Cases: null, empty and blank texts have no paragraphs; paragraphs without a known
feature are `unknown`; repeated rows give repeated findings; paragraphs of any length
are read whole; of equally probable families the first is taken; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, uniform_hash

BITS = 16
NEGATIVES = 200
SEEN = 20_000
PROBABILITY = 0.5
SIMILARITY = 0.6
CLEAN = bytes(b if b >= 128 or chr(b).isalnum() else 46 if b == 46 else 32 for b in range(256))

# Wording by which public licences are granted or named.
TEMPLATES: dict[str, list[str]] = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 2.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ],
    "LGPL": [
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
    ],
    "AGPL": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ],
    "BSD": [
        "Licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "MPL-2.0": [
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "ISC": [
        "Licensed under the ISC License.",
        "SPDX-License-Identifier: ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC0": [
        "Released under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "This is free and unencumbered software released into the public domain.",
    ],
    "proprietary": [
        "All rights reserved.",
        "This document is confidential and proprietary; no part may be reproduced without prior written permission.",
    ],
}
UNKNOWN = "unknown"


def words_of(line: bytes) -> list[bytes]:
    return line.lower().translate(CLEAN).replace(b". ", b" ").rstrip(b" .").split()


def paragraphs(text: bytes | None):
    """(number of the first line, its lines) of each paragraph."""
    first, held = 0, []
    for n, line in enumerate(text.split(b"\n") if text else ()):
        if line.strip():
            first = first if held else n
            held.append(line)
        if held and (not line.strip() or line.rstrip()[-1:] in b".!?:;"):
            yield first, held
            held = []
    if held:
        yield first, held


def gram_slots(words: list[bytes], bits: int = BITS) -> np.ndarray:
    """Distinct slots of the unigrams, bigrams and trigrams of a paragraph."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        two = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]
        three = h[:-2] * np.uint64(0xC2B2AE3D27D4EB4F) + h[1:-1] * np.uint64(0x165667B19E3779F9) + h[2:]
        return np.unique(mix64(np.concatenate([h, two, three])) >> np.uint64(64 - bits)).astype(np.int64)


def trigrams(words: list[bytes]) -> set:
    return {tuple(words[k : k + 3]) for k in range(len(words) - 2)} or {tuple(words)}


class Templates:
    def __init__(self, templates: dict[str, list[str]] = TEMPLATES):
        self.by = {f: [trigrams(words_of(t.encode())) for t in ts] for f, ts in templates.items()}

    def similarity(self, words: list[bytes], family: str) -> float:
        """The largest share of a template's trigrams in the paragraph, or of the paragraph's in a template of more."""
        own = trigrams(words)
        return max(len(own & t) / len(t) if len(t) <= len(own) else len(own & t) / len(own) if len(own) >= 5 else len(own & t) / len(t) for t in self.by[family])

    def best(self, words: list[bytes]) -> float:
        return max(self.similarity(words, f) for f in self.by)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


class Classifier:
    """Sparse weights: rows of slots that have any, classes across."""

    def __init__(self, families: list[str], at: np.ndarray, weights: np.ndarray, bias: np.ndarray, temperature: float, bits: int):
        self.families, self.at, self.weights, self.bias, self.temperature, self.bits = families, at, weights, bias, temperature, bits

    def dense(self) -> np.ndarray:
        """Row of each slot, -1 for none."""
        row = np.full(1 << self.bits, -1, np.int32)
        row[self.at] = np.arange(len(self.at))
        return row

    def probabilities(self, rows: np.ndarray) -> np.ndarray:
        return softmax((self.weights[rows].sum(0) + self.bias) / self.temperature)


def train(negatives: list[list[bytes]], bits: int = BITS, seed: int = 13, epochs: int = 6) -> Classifier:
    """From the templates and background paragraphs, as word lists."""
    rng = np.random.default_rng(seed)
    families = [*TEMPLATES, UNKNOWN]
    background = [w for w in negatives if w] or [[b"the"]]
    rows: list[tuple[np.ndarray, int]] = []
    for k, f in enumerate(TEMPLATES):
        base = [words_of(t.encode()) for t in TEMPLATES[f]]
        for _ in range(120):
            w = list(base[int(rng.integers(len(base)))])
            if len(w) > 25 and rng.random() < 0.5:
                a = int(rng.integers(0, len(w) // 2))
                w = w[a : a + len(w) // 2]
            w = [x for x in w if rng.random() > 0.04] or w
            if rng.random() < 0.3:
                other = background[int(rng.integers(len(background)))][: int(rng.integers(1, 12))]
                w = other + w if rng.random() < 0.5 else w + other
            rows.append((gram_slots(w, bits), k))
    for w in background[:1500]:
        rows.append((gram_slots(w, bits), len(families) - 1))
    loose = [b"license", b"licensed", b"under", b"the", b"version", b"copyright", b"software", b"released", b"permission", b"public", b"terms", b"rights", b"free"]
    for _ in range(300):
        w = background[int(rng.integers(len(background)))][:20]
        for _ in range(int(rng.integers(1, 3))):
            w = [*w[: len(w) // 2], loose[int(rng.integers(len(loose)))], *w[len(w) // 2 :]]
        rows.append((gram_slots(w, bits), len(families) - 1))
    order = rng.permutation(len(rows))
    held, learn = [rows[i] for i in order[: len(rows) // 5]], [rows[i] for i in order[len(rows) // 5 :]]
    w, g2 = np.zeros((1 << bits, len(families)), np.float32), np.full((1 << bits, len(families)), 1e-2, np.float32)
    bias = np.zeros(len(families), np.float32)
    for e in range(epochs):
        for i in rng.permutation(len(learn)).tolist():
            s, y = learn[i]
            p = softmax(w[s].sum(0) + bias)
            p[y] -= 1
            g2[s] += p * p
            step = 0.3 / np.sqrt(g2[s])
            x = w[s] - step * p
            w[s] = np.sign(x) * np.maximum(np.abs(x) - step * 2e-3, 0)  # L1
            bias -= 0.02 * p
    logits = np.array([w[s].sum(0) + bias for s, _ in held])
    y = np.array([k for _, k in held])
    losses = {t: -np.log(softmax(logits / t)[np.arange(len(y)), y] + 1e-12).mean() for t in np.geomspace(0.3, 6, 25)}
    at = np.flatnonzero((w != 0).any(1))
    return Classifier(families, at, w[at], bias, float(min(losses, key=losses.get)), bits)


def fit(docs: DataFrame, sample: int = NEGATIVES) -> Classifier:
    share = sample / max(1, docs.count())
    templates, negatives = Templates(), []
    got = docs.where(F.col("text").isNotNull() & (uniform_hash(F.col("doc_id"), 10) < share)).select("doc_id", F.left("text", F.lit(SEEN)).alias("text")).distinct().collect()
    for r in sorted(got, key=lambda r: (r["doc_id"], r["text"])):
        for _, lines in paragraphs(r["text"].encode()):
            w = words_of(b" ".join(lines))
            if w and templates.best(w) < 0.3:
                negatives.append(w)
    return train(negatives)


def scan_licences(docs: DataFrame, model: Classifier | None = None, probability: float = PROBABILITY, similarity: float = SIMILARITY, unknown: bool = False) -> DataFrame:
    """(doc_id, line, lines, family, probability, similarity, confirmed): every paragraph that the classifier gives to a family.

    line: its first, from 0; lines: how many.  With `unknown`, the paragraphs of that class come too, with similarity 0.
    """
    held = docs.sparkSession.sparkContext.broadcast(model or fit(docs))

    def run(batches):
        model, templates = held.value, Templates()
        row_of = model.dense()
        none = len(model.families) - 1
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.bool_()]

        def said(lines: list[bytes]) -> tuple:
            words = words_of(b" ".join(lines))
            rows = row_of[gram_slots(words, model.bits)] if words else np.zeros(0, np.int32)
            rows = rows[rows >= 0]
            p = model.probabilities(rows) if len(rows) else None
            best = none if p is None else int(p.argmax())
            if best == none or p[best] < probability:
                return UNKNOWN, 1.0 if p is None else float(p[none]), 0.0, False
            s = templates.similarity(words, model.families[best])
            return model.families[best], float(p[best]), float(s), s >= similarity

        for b in batches:
            at, found = [], []
            for k, text in enumerate(b.column(1).cast(pa.binary()).to_pylist()):
                for n, lines in paragraphs(text):
                    each = [(n, len(lines), *said(lines))]
                    if each[0][2] == UNKNOWN and len(lines) > 1:
                        alone = [(n + j, 1, *said([line])) for j, line in enumerate(lines)]
                        each = each if all(x[2] == UNKNOWN for x in alone) else [x for x in alone if x[2] != UNKNOWN]
                    each = [x for x in each if unknown or x[2] != UNKNOWN]
                    at += [k] * len(each)
                    found += each
            cols = list(zip(*found)) if found else [[]] * 6
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, kinds))], ["doc_id", "line", "lines", "family", "probability", "similarity", "confirmed"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, line int, lines int, family string, probability double, similarity double, confirmed boolean")
