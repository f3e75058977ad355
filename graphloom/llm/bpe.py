"""Byte-pair encoding and decoding.

The merge loop keeps a segment tree over the ranks of adjacent pairs: its root is
the leftmost pair of lowest rank; a merge changes three leaves, each repaired in
logarithmic time.  Short pre-tokens run many at once, one tree per row of a numpy
matrix; long ones run alone on plain lists.  A text is whole: it is cut only at
special tokens and by the pre-tokenizer's pattern, as the vocabulary's own library
does it.

Cases: a null or empty text has no ids and decodes to the empty string; special
tokens in a text become their ids; very long pre-tokens cost n log n; repeated
rows repeat their results; other columns pass through untouched when named in `keep`.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import csr_gather, text_slices

# The public pre-tokenizer pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White_Space of Unicode.
SPACES = "\t\n\x0b\x0c\r \x85\xa0  -     　"
LOW = 0x250
CACHE = 250_000
LONG = 192


def _char_class(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(LOW) if unicodedata.category(chr(c))[0] == kind)


class PreTokenizer:
    """The pattern above; texts of Latin letters only take an equal pattern that the faster stdlib engine runs."""

    def __init__(self):
        letters, numbers = _char_class("L"), _char_class("N")
        self.any = regex.compile(PATTERN.replace(r"\s", f"[{SPACES}]").replace(rf"[^[{SPACES}]", f"[^{SPACES}").replace(r"\S", f"[^{SPACES}]"))
        self.low = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{SPACES}{letters}{numbers}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
        self.high = re.compile(rf"[^\x00-{chr(LOW - 1)}]")

    def __call__(self, text: str) -> list[str]:
        return (self.any if self.high.search(text) else self.low).findall(text)


def byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = (chr(256 + k) for k in range(256))
    return {b: chr(b) if b in printable else next(spare) for b in range(256)}


class Vocabulary:
    """Ids, merges and special tokens of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids = spec["model"]["vocab"]
        to_byte = {c: b for b, c in byte_chars().items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        n = 1 + max(max(ids.values()), *self.special.values(), 0)
        self.token_bytes = [b""] * n
        for t, i in ids.items():
            self.token_bytes[i] = bytes(to_byte[c] for c in t) if all(c in to_byte for c in t) else t.encode()
        for t, i in self.special.items():
            self.token_bytes[i] = t.encode()
        self.byte_id = np.array([ids[byte_chars()[b]] for b in range(256)], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left, right = (np.array([ids[p[k]] for p in pairs], np.int64) for k in (0, 1))
        self.merged = np.array([ids["".join(p)] for p in pairs], np.int64)
        key = left << 32 | right
        order = np.argsort(key, kind="stable")
        self.keys, self.key_rank = key[order], order.astype(np.int64)
        self.rank_of = dict(zip(key.tolist(), range(len(pairs))))
        self.byte_pair = self.ranks(np.repeat(self.byte_id, 256), np.tile(self.byte_id, 256)).reshape(256, 256)

    NONE = np.int64(1) << 40

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.key_rank[at], self.NONE)


def merge_long(vocab: Vocabulary, word: bytes) -> list[int]:
    """One word on a segment tree of plain lists."""
    sym = vocab.byte_id[np.frombuffer(word, np.uint8)].tolist()
    n = len(sym)
    size = 1 << max(1, (n - 1).bit_length())
    none = int(Vocabulary.NONE) * size
    rank = vocab.rank_of
    tree = [none] * (2 * size)
    for p in range(n - 1):
        r = rank.get(sym[p] << 32 | sym[p + 1])
        if r is not None:
            tree[size + p] = r * size + p
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
    merged = vocab.merged.tolist()

    def put(p: int, value: int) -> None:
        k = size + p
        tree[k] = value
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            a = a if a < b else b
            if tree[k] == a:
                break
            tree[k] = a
            k >>= 1

    def leaf(p: int) -> int:
        q = nxt[p]
        if q >= n:
            return none
        r = rank.get(sym[p] << 32 | sym[q])
        return none if r is None else r * size + p

    while tree[1] < none:
        r, p = divmod(tree[1], size)
        q = nxt[p]
        sym[p], nxt[p] = merged[r], nxt[q]
        if nxt[q] < n:
            prv[nxt[q]] = p
        put(q, none)
        put(p, leaf(p))
        if prv[p] >= 0:
            put(prv[p], leaf(prv[p]))
    out, p = [], 0
    while p < n:
        out.append(sym[p])
        p = nxt[p]
    return out


def merge_many(vocab: Vocabulary, words: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Words of at most `size` bytes (a power of two), one segment tree per row: flat ids and their counts."""
    w = len(words)
    lens = np.fromiter(map(len, words), np.int64, w)
    raw = np.zeros((w, size + 1), np.uint8)
    raw[np.arange(size + 1) < lens[:, None]] = np.frombuffer(b"".join(words), np.uint8)
    sym = vocab.byte_id[raw]
    none = Vocabulary.NONE * size
    tree = np.full((w, 2 * size), none, np.int64)
    cols = np.arange(size)
    pair = vocab.byte_pair[raw[:, :-1], raw[:, 1:]]
    tree[:, size:] = np.where((cols < lens[:, None] - 1) & (pair < Vocabulary.NONE), pair * size + cols, none)
    k = size
    while k > 1:
        tree[:, k // 2 : k] = np.minimum(tree[:, k : 2 * k : 2], tree[:, k + 1 : 2 * k : 2])
        k //= 2
    nxt = np.tile(np.arange(1, size + 2), (w, 1))
    prv = np.tile(np.arange(-1, size), (w, 1))
    alive = np.arange(size + 1) < lens[:, None]

    def put(rows, pos, values):
        at = size + pos
        tree[rows, at] = values
        at = at >> 1
        while at[0] if len(at) else 0:
            tree[rows, at] = np.minimum(tree[rows, 2 * at], tree[rows, 2 * at + 1])
            at = at >> 1

    def leaf(rows, pos):
        q = nxt[rows, pos]
        ok = q < lens[rows]
        r = vocab.ranks(sym[rows, pos], sym[rows, np.minimum(q, size)])
        return np.where(ok & (r < Vocabulary.NONE), r * size + pos, none)

    rows = np.flatnonzero(tree[:, 1] < none)
    while len(rows):
        root = tree[rows, 1]
        p = root & (size - 1)
        q = nxt[rows, p]
        r = nxt[rows, q]
        sym[rows, p] = vocab.merged[root // size]
        nxt[rows, p] = r
        prv[rows, np.minimum(r, size)] = p
        alive[rows, q] = False
        put(rows, np.minimum(q, size - 1), none)
        put(rows, p, leaf(rows, p))
        has = np.flatnonzero(prv[rows, p] >= 0)
        if len(has):
            rr, pp = rows[has], prv[rows[has], p[has]]
            put(rr, pp, leaf(rr, pp))
        rows = rows[tree[rows, 1] < none]
    return sym[alive], alive.sum(1)


def segment_tree_words(vocab: Vocabulary):
    """words -> (flat ids, counts) by the segment-tree merges."""

    def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = [x.encode() for x in words]
        lens = np.fromiter(map(len, raw), np.int64, len(raw))
        size = np.maximum(2, 1 << np.ceil(np.log2(np.maximum(lens, 1))).astype(np.int64))
        order, parts, counts = [], [], []
        for s in np.unique(size).tolist():
            idx = np.flatnonzero(size == s)
            if s > LONG:
                for i in idx.tolist():
                    parts.append(np.array(merge_long(vocab, raw[i]), np.int64))
                    counts.append([len(parts[-1])])
                order.append(idx)
                continue
            step = max(1, 1_500_000 // s)
            for a in range(0, len(idx), step):
                flat, n = merge_many(vocab, [raw[i] for i in idx[a : a + step].tolist()], s)
                parts.append(flat)
                counts.append(n)
                order.append(idx[a : a + step])
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        order, n, flat = np.concatenate(order), np.concatenate(counts), np.concatenate(parts)
        starts = np.cumsum(n) - n
        back = np.argsort(order)
        return flat[csr_gather(starts[back], n[back])], n[back]

    return encode


class LibraryEncoder:
    """Whole texts to ids by installed libraries: the ids of the tokenizers library for the file at `path`.

    Where a vocabulary numbers its tokens in merge order, tiktoken's engine run on the
    file's own tokens, pattern and specials gives the same ids several times faster.
    """

    def __init__(self, path: str, vocab: Vocabulary):
        self.vocab = vocab
        if bool((np.diff(vocab.merged) > 0).all()):
            import tiktoken

            ranks = {b: i for i, b in enumerate(vocab.token_bytes) if b and i not in set(vocab.special.values())}
            fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=vocab.special)
            own = Encoder(vocab, segment_tree_words(vocab))

            def one(t: str) -> np.ndarray:
                try:
                    return fast.encode_to_numpy(t, allowed_special="all")
                except ValueError:  # its pattern engine gives up on runs of about a million blanks
                    return own.encode([t])[0].astype(np.uint32)

            self.one = one
        else:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(path)
            tok.no_truncation()
            tok.no_padding()
            self.one = lambda t: np.array(tok.encode(t, add_special_tokens=False).ids, np.uint32)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        out = [self.one(t) for t in texts]
        n = np.fromiter(map(len, out), np.int64, len(out))
        return (np.concatenate(out) if out else np.zeros(0, np.uint32)), n


class Encoder:
    """Texts to ids through a bounded cache of pre-tokens; `words` encodes those that it lacks."""

    def __init__(self, vocab: Vocabulary, words, cache: int = CACHE):
        self.vocab, self.words, self.most = vocab, words, cache
        self.split = PreTokenizer()
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(vocab.special, key=len, reverse=True))) + ")") if vocab.special else None
        self.clear()

    def clear(self) -> None:
        self.at = {t: k for k, t in enumerate(self.vocab.special)}
        self.flat = np.fromiter(self.vocab.special.values(), np.int32, len(self.at))
        self.lens = np.ones(len(self.at), np.int64)
        self.starts = np.arange(len(self.at), dtype=np.int64)

    def pieces(self, text: str) -> list[str]:
        if self.cut is None or not any(t in text for t in self.vocab.special):
            return self.split(text)
        out: list[str] = []
        for part in self.cut.split(text):
            out += [part] if part in self.vocab.special else self.split(part)
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts, and how many each has."""
        toks = [self.pieces(t) for t in texts]
        distinct = set(chain.from_iterable(toks))
        if len(self.at) > self.most:
            self.clear()
        if new := [t for t in distinct if t not in self.at]:
            flat, n = self.words(new)
            self.at.update(zip(new, range(len(self.at), len(self.at) + len(new))))
            ends = np.cumsum(n)
            self.starts = np.concatenate([self.starts, len(self.flat) + ends - n])
            self.lens = np.concatenate([self.lens, n])
            self.flat = np.concatenate([self.flat, flat.astype(np.int32)])
        count = np.fromiter(map(len, toks), np.int64, len(toks))
        idx = np.fromiter(map(self.at.__getitem__, chain.from_iterable(toks)), np.int64, int(count.sum()))
        lens = self.lens[idx]
        sums = np.concatenate([[0], np.cumsum(lens)])
        ends = np.cumsum(count)
        return self.flat[csr_gather(self.starts[idx], lens)], sums[ends] - sums[ends - count]


class Decoder:
    def __init__(self, vocab: Vocabulary):
        self.lens = np.fromiter(map(len, vocab.token_bytes), np.int64, len(vocab.token_bytes))
        self.starts = np.cumsum(self.lens) - self.lens
        self.pool = np.frombuffer(b"".join(vocab.token_bytes), np.uint8)

    def decode(self, flat: np.ndarray, n: np.ndarray) -> list[str]:
        """Texts of consecutive runs of n ids; bytes that are no UTF-8 become U+FFFD."""
        lens = self.lens[flat]
        raw = self.pool[csr_gather(self.starts[flat], lens)].tobytes()
        sums = np.concatenate([[0], np.cumsum(lens)])
        ends = np.cumsum(n)
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(sums[ends - n].tolist(), sums[ends].tolist())]


_made: dict = {}


def encoder_for(path: str, by: str):
    """This worker's encoder; by: "segment_tree" or "library"."""
    if (path, by) not in _made:
        vocab = _made.setdefault(path, Vocabulary(path))
        _made[path, by] = Encoder(vocab, segment_tree_words(vocab)) if by == "segment_tree" else LibraryEncoder(path, vocab)
    return _made[path, by]


def bpe_encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids array<int>, decoded string): the ids of every whole text and the text that they decode to."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        enc = encoder_for(path, "segment_tree")
        dec = Decoder(enc.vocab)
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo, hi in text_slices(texts):
                flat, n = enc.encode([t or "" for t in texts[lo:hi]])
                offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), ids, pa.array(dec.decode(flat, n), pa.string())], ["id", "ids", "decoded"])

    out = docs.select(id_col, text_col).mapInArrow(run, f"id {id_type}, ids array<int>, decoded string")
    return out.withColumnRenamed("id", id_col)
