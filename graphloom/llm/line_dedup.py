"""Line dedup through deletion neighbourhoods of words.

A line is what stands between line feeds, read as its words.  Two lines are near when
they are equal, or when both have at least `least` words and differ by one inserted,
deleted or replaced word.  A line goes when any earlier line of the corpus, by
(doc_id, copy, line number), is near it; the earliest of all always stays.

Equal lines are settled first, by hash.  Of the distinct lines, only those that share
one half with another line can be near one (an edit leaves the other half whole), so
only these emit their variants: the line itself and the line without each of its
words, as 64-bit keys.  Equal variants are joined through one minimum per key and
deleted place, never pair by pair; each loser and its earlier witness are verified by
edit distance on their words.

Cases: a null text has no lines and stays null; blank lines are kept and never
compared; texts repeated under other ids lose all their lines but the first copy's; rows
of one doc_id are told apart by a hash of their text, so ties occur between whole equal
rows only, whose equal positions keep each other; extra columns pass through; an empty
table stays empty.

The edit bound is one word in `least` or more (8: an eighth of a line): two lines of
fewer words that differ in one are different lines.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, mix64, text_slices

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
LEAST = 8


class Powers:
    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int):
        if n >= len(self.up):
            size = 2 * n + 64
            with np.errstate(over="ignore"):
                self.up, self.down = (np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, b, np.uint64), dtype=np.uint64)]) for b in (BASE, INVERSE))
        return self.up, self.down


def prefix_sums(words: list[bytes], powers: Powers) -> np.ndarray:
    """Sums of word hash times base to the place, for 0, 1, ... words."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    up, _ = powers(len(words))
    with np.errstate(over="ignore"):
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[: len(h)], dtype=np.uint64)])


def _key(x, n) -> np.ndarray:
    """A signed key of a sum of words and their number (or anything that tells kinds of keys apart)."""
    with np.errstate(over="ignore"):
        return mix64(np.asarray(x, np.uint64) + np.asarray(n).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)).astype(np.int64)


def variant_keys(c: np.ndarray) -> np.ndarray:
    """Keys of the line without its word 0, 1, ...; c: prefix_sums of the line."""
    with np.errstate(over="ignore"):
        return _key(c[:-1] + (c[-1] - c[1:]) * np.uint64(INVERSE), len(c) - 2)


def line_keys(words: list[bytes], lens: np.ndarray, least: int, powers: Powers) -> tuple[np.ndarray, pa.Array]:
    """Of consecutive lines of `lens` words each: keys of the whole lines, and lists of the keys of their first and
    last halves, for both roundings of the half; none for lines of under `least` words."""
    c = prefix_sums(words, powers)
    _, down = powers(len(words))
    end = np.cumsum(lens)
    start = end - lens
    with np.errstate(over="ignore"):
        part = lambda a, b: (c[b] - c[a]) * down[a]
        whole = _key(part(start, end), lens)
        k, j = lens // 2, (lens - 1) // 2
        halves = np.column_stack([_key(part(a, b), 2 * m + side) for m in (k, j) for side, a, b in ((0, start, start + m), (1, end - m, end))])
    used = np.column_stack([lens >= least] * 2 + [(lens >= least) & (k != j)] * 2)
    offsets = np.concatenate([[0], np.cumsum(used.sum(1))]).astype(np.int32)
    return whole, pa.ListArray.from_arrays(pa.array(offsets), pa.array(halves[used]))


def within_one_edit(a: list, b: list) -> bool:
    """Whether lists differ by one insertion, deletion or replacement at most."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def _lines_pass(least: int):
    schema = pa.schema([("doc_id", pa.int64()), ("copy", pa.int32()), ("line", pa.int32()), ("n", pa.int32()), ("whole", pa.int64()), ("halves", pa.list_(pa.int64()))])

    def run(batches):
        powers = Powers()
        for b in batches:
            texts = b.column("text").cast(pa.binary()).to_pylist()
            for lo, hi in text_slices(texts):
                rows, no, lens, words = [], [], [], []
                for row, text in enumerate(texts[lo:hi], lo):
                    for k, line in enumerate(text.split(b"\n") if text is not None else ()):
                        if w := line.split():
                            rows.append(row)
                            no.append(k)
                            lens.append(len(w))
                            words += w
                n = np.array(lens, np.int64)
                whole, halves = line_keys(words, n, least, powers)
                rows = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(rows), b.column("copy").take(rows), pa.array(no, pa.int32()), pa.array(n.astype(np.int32)), pa.array(whole), halves], schema=schema)

    return run


def _variants_pass(batches):
    """(doc_id, copy, line, role, key, text): role -1 is the line itself, with its text; 0, 1, ... the deleted word."""
    schema = pa.schema([("doc_id", pa.int64()), ("copy", pa.int32()), ("line", pa.int32()), ("role", pa.int32()), ("key", pa.int64()), ("text", pa.string())])
    powers = Powers()
    for b in batches:
        for doc, copy, text, picked in zip(*(b.column(c).to_pylist() for c in ("doc_id", "copy", "text", "picked"))):
            lines = text.split("\n")
            for k in picked:
                words = lines[k].encode().split()
                c, n = prefix_sums(words, powers), len(words)
                keys = np.append(_key(c[-1], n), variant_keys(c))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n + 1, doc)), pa.array(np.full(n + 1, copy, np.int32)), pa.array(np.full(n + 1, k, np.int32)), pa.array(np.arange(-1, n, dtype=np.int32)), pa.array(keys), pa.array([lines[k]] + [None] * n, pa.string())], schema=schema)


def _batched(run, rows: int = 20_000):
    """The batches of run, put together to larger ones."""

    def out(batches):
        held, n = [], 0
        for b in run(batches):
            held.append(b)
            n += b.num_rows
            if n >= rows:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return out


def _verify_pass(batches):
    for b in batches:
        keep = [k for k, (x, y) in enumerate(zip(b.column("text").to_pylist(), b.column("other").to_pylist())) if within_one_edit(x.encode().split(), y.encode().split())]
        yield b.select(["doc_id", "copy", "line"]).take(pa.array(keep, pa.int64()))


def copy_of(text: str):
    """What tells rows of one doc_id apart."""
    return F.xxhash64(text).bitwiseAND(F.lit((1 << 31) - 1).cast("long")).cast("int")


def repeated_lines(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(doc_id, copy, line) of every line that an earlier one is near to, and (doc_id, copy, n_lines) of documents with words."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), copy_of("text").alias("copy"), "text").where("doc_id is not null and text is not null")
    lines = materialize(src.mapInArrow(_lines_pass(least), "doc_id long, copy int, line int, n int, whole long, halves array<long>"), "lines")
    pos = F.struct("doc_id", "copy", "line")
    first = lines.groupBy("whole", "n").agg(F.min(pos).alias("first"), F.count("*").alias("copies"))
    many = materialize(first.where("copies > 1").select("whole", "n", "first"), "lines-equal")
    copies = lines.join(many, ["whole", "n"], "left_semi").select("doc_id", "copy", "line", "whole", "n").join(many, ["whole", "n"])
    exact = copies.where(pos != F.col("first")).select("doc_id", "copy", "line")
    alone = lines.where(F.col("n") >= least).join(many.select("whole", "n"), ["whole", "n"], "left_anti").select("doc_id", "copy", "line", "halves")
    heads = lines.where(F.col("n") >= least).join(many, ["whole", "n"]).where(pos == F.col("first")).select("doc_id", "copy", "line", "halves")
    halves = materialize(alone.union(heads).select("doc_id", "copy", "line", F.explode("halves").alias("half")), "lines-halves")
    shared = halves.groupBy("half").agg(F.count("*").alias("c")).where("c > 1").select("half")
    picked = halves.join(shared, "half").groupBy("doc_id", "copy").agg(F.collect_set("line").alias("picked"))
    variants = materialize(src.join(picked, ["doc_id", "copy"]).mapInArrow(_batched(_variants_pass), "doc_id long, copy int, line int, role int, key long, text string"), "lines-variants")
    discard(halves)
    by_place = variants.where("role >= 0").groupBy("key", "role").agg(F.min(pos).alias("w"), F.count("*").alias("c")).where("c > 1").select("key", "role", "w")
    replaced = variants.where("role >= 0").select("key", "role", "doc_id", "copy", "line").join(by_place, ["key", "role"]).where(pos > F.col("w")).select("doc_id", "copy", "line", "w")
    whole = variants.where("role = -1").select("key", pos.alias("x"))
    less = variants.where("role >= 0").select("key", pos.alias("y"))
    met = less.join(whole, "key")
    # of the longer lines that lose a word to x, the earliest is witness enough against x
    longer = met.where("y > x").select("y.doc_id", "y.copy", "y.line", F.col("x").alias("w"))
    shorter = met.groupBy("x").agg(F.min("y").alias("w")).where("x > w").select("x.doc_id", "x.copy", "x.line", "w")
    pairs = replaced.union(longer).union(shorter).distinct()
    texts = variants.where("role = -1").select("doc_id", "copy", "line", "text")
    other = texts.select(F.struct("doc_id", "copy", "line").alias("w"), F.col("text").alias("other"))
    verified = pairs.join(texts, ["doc_id", "copy", "line"]).join(other, "w").select("doc_id", "copy", "line", "text", "other").mapInArrow(_verify_pass, "doc_id long, copy int, line int")
    dropped = materialize(exact.union(verified).distinct(), "lines-dropped")
    counts = lines.groupBy("doc_id", "copy").agg(F.count("*").alias("n_lines"))
    return dropped, counts


def dedup_lines(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """docs with only the lines that are kept, in the same columns; n_chars, where there is one, follows the text.

    Documents that lose every line with words go; those that had none stay as they are.
    """
    dropped, _ = repeated_lines(docs, least)
    gone = dropped.groupBy("doc_id", "copy").agg(F.collect_set("line").alias("__gone")).select(F.col("doc_id").alias("__id"), F.col("copy").alias("__copy"), "__gone")
    joined = docs.join(gone, (F.col("doc_id") == F.col("__id")) & (copy_of("text") == F.col("__copy")), "left")
    kept = F.array_join(F.transform(F.filter(F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: ~F.array_contains(F.col("__gone"), s["i"])), lambda s: s["x"]), "\n")
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(kept)
    out = joined.withColumn("text", text).where(F.col("__gone").isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__gone").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
