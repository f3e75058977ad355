"""Cross-entropy difference of two n-gram language models.

The target model counts the documents marked by a label, the background model all
others; counts of all documents enter.  A document is scored by the counts of the other
documents: its own are taken out of its model first.  Both models share one vocabulary, every word of
the corpus, and both count every bigram exactly: words and bigrams are told apart by
64-bit hashes.  Background counts are scaled to the target's number of tokens (matched
sizes), so smoothing weighs the same in both.  Each token's loss interpolates the bigram
with the add-one unigram estimate; a document's score is the mean of target loss minus
background loss: low is like the target.

Counts are a distributed table, never gathered: documents are cut into blocks of about
BLOCK tokens, and a block sends its own distinct n-grams, summed, to ranges of hashes.
A range adds them up and sends each block the sums of its n-grams, in the block's order.
The number of ranges follows the number of tokens, so no task grows with the input.

Cases: null and empty texts have no tokens and score 0; texts of any length are read
whole; without target documents both models are the background; repeated labels of a
document count once; repeated rows are documents of their own, each scored with the
others' counts; ties get equal scores; other columns are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

import gc

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, mix64

BLOCK = 1 << 19
COLUMNS = ["lengths", "words", "ids", "tokens"]
MIX = 0.5


def _hashes(text: bytes | None) -> np.ndarray:
    w = text.lower().split() if text else []
    return np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))


def _packed(*columns: np.ndarray) -> bytes:
    """Columns of equal length as planes of bytes, compressed."""
    flat = np.stack([c.view(np.uint64) for c in columns])
    raw = np.ascontiguousarray(flat.view(np.uint8).reshape(len(columns), -1, 8).transpose(0, 2, 1)).tobytes()
    return len(columns[0]).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(raw: bytes, columns: int) -> np.ndarray:
    n = int.from_bytes(raw[:8], "little")
    flat = np.frombuffer(pa.decompress(raw[8:], decompressed_size=n * 8 * columns, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(flat.reshape(columns, 8, n).transpose(0, 2, 1)).view(np.int64).reshape(columns, n)


def _blocks(kind: pa.DataType, size: int):
    """Rows (block, doc_ids, lengths, words, ids, tokens): documents' lengths and targets, sorted hashes of the block's words, its tokens' places among them."""

    def run(batches):
        task, seq, doc_ids, targets, held, tokens = TaskContext.get().partitionId() << 32, 0, [], [], [], 0

        def row():
            words, ids = np.unique(np.concatenate(held), return_inverse=True)
            lengths = np.array([len(h) for h in held], np.int64)
            cols = [pa.array([task + seq], pa.int64()), pa.array([doc_ids], pa.list_(kind)), *(pa.array([x], pa.binary()) for x in (_packed(lengths, np.array(targets, np.int64)), _packed(np.diff(words, prepend=np.uint64(0))), pa.compress(ids.astype("<i4").tobytes(), codec="zstd", asbytes=True))), pa.array([tokens], pa.int64())]
            return pa.RecordBatch.from_arrays(cols, ["block", "doc_ids", "lengths", "words", "ids", "tokens"])

        for b in (b.slice(k, 256) for b in batches for k in range(0, b.num_rows, 256)):
            for doc_id, text, target in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist()):
                doc_ids.append(doc_id)
                targets.append(bool(target))
                held.append(_hashes(text))
                tokens += len(held[-1])
                if tokens + len(held) >= size:
                    yield row()
                    seq, doc_ids, targets, held, tokens = seq + 1, [], [], [], 0
        if held:
            yield row()

    return run


def _grams(lengths: bytes, words: bytes, ids: bytes, tokens: int):
    """(document of each token, which documents are targets, words, ids of tokens, sorted bigrams, their places for each pair, first token of each pair)."""
    (lengths, targets), words = _unpacked(lengths, 2), np.cumsum(_unpacked(words, 1)[0].view(np.uint64), dtype=np.uint64)
    ids = np.frombuffer(pa.decompress(ids, decompressed_size=4 * tokens, codec="zstd", asbytes=True), "<i4")
    doc = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    first = np.flatnonzero(doc[1:] == doc[:-1])
    with np.errstate(over="ignore"):
        keys = mix64(words[ids[first]] * np.uint64(0x9E3779B97F4A7C15) + mix64(words[ids[first + 1]]))
    bigrams, at = np.unique(keys, return_inverse=True)
    return doc, targets > 0, words, ids, bigrams, at.astype(np.int32), first


def _counts(bits: int):
    """Rows (part, block, grams): a block's n-grams of a range of hashes as steps, target counts and background counts; words first."""

    def run(batches):
        for b in batches:
            for row in range(b.num_rows):
                block = b.column("block")[row].as_py()
                doc, target, words, ids, bigrams, at, first = _grams(*(b.column(c)[row].as_py() for c in COLUMNS))
                parts, raw = [], []
                for kind, keys, places, mine in ((0, words, ids, target[doc]), (1, bigrams, at, target[doc[first]])):
                    t, g = (np.bincount(places[m], minlength=len(keys)) for m in (mine, ~mine))
                    of = keys >> np.uint64(64 - bits) if bits else np.zeros(len(keys), np.uint64)
                    cuts = np.searchsorted(of, np.arange((1 << bits) + 1).astype(np.uint64))
                    for k in np.flatnonzero(np.diff(cuts)).tolist():
                        own = slice(cuts[k], cuts[k + 1])
                        parts.append(kind << bits | k)
                        raw.append(_packed(np.diff(keys[own], prepend=np.uint64(0)), t[own], g[own]))
                yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([block] * len(parts), pa.int64()), pa.array(raw, pa.binary())], ["part", "block", "grams"])

    return run


SUMS = "block long, part int, sums binary, words long, target long, background long"


def _sums(bits: int):
    """The sums of a range for each block, in the order of its n-grams; for a range of words, also their number and both models' tokens."""

    def run(group: pa.Table) -> pa.Table:
        part, blocks = group.column("part")[0].as_py(), group.column("block").to_pylist()
        each = [_unpacked(x, 3) for x in group.column("grams").to_pylist()]
        keys, at = np.unique(np.concatenate([np.cumsum(x[0].view(np.uint64), dtype=np.uint64) for x in each]), return_inverse=True)
        t, g = (np.bincount(at, np.concatenate([x[k] for x in each])).astype(np.int64) for k in (1, 2))
        own = np.split(at, np.cumsum([x.shape[1] for x in each])[:-1])
        stats = [len(keys), int(t.sum()), int(g.sum())] if part >> bits == 0 else [0, 0, 0]
        rest = [[n] + [0] * (len(blocks) - 1) for n in stats]
        return pa.table([pa.array(blocks, pa.int64()), pa.array([part] * len(blocks), pa.int32()), pa.array([_packed(t[k], g[k]) for k in own], pa.binary()), *(pa.array(x, pa.int64()) for x in rest)], names=["block", "part", "sums", "words", "target", "background"])

    return run


def losses(uni: np.ndarray, before: np.ndarray, pair: np.ndarray, first: np.ndarray, total: np.ndarray, words: int) -> np.ndarray:
    """Of each token in nats, from a model's counts: of its word, of the word before and of the bigram (for each pair), and of all tokens; `words` words are known."""
    p = (uni + 1) / (total + words)
    p[first + 1] = (1 - MIX) * p[first + 1] + MIX * np.minimum(1, pair / np.maximum(before, 1))
    return -np.log(p)


def own_counts(doc: np.ndarray, of: np.ndarray) -> np.ndarray:
    """For each place, how often its n-gram `of` occurs in its document."""
    _, at, n = np.unique(doc.astype(np.int64) << 32 | of.astype(np.int64), return_inverse=True, return_counts=True)
    return n[at]


def _scores(words_known: int, n: int, m: int, kind: pa.DataType):
    def run(batches):
        for b in batches:
            listed = b.column("doc_ids")
            for row in range(b.num_rows):
                doc, target, words, ids, bigrams, at, first = _grams(*(b.column(c)[row].as_py() for c in COLUMNS))
                known = [_unpacked(x["sums"], 2) for x in sorted(b.column("sums")[row].as_py() or [], key=lambda x: x["part"])]
                t, g = np.concatenate([np.zeros((2, 0), np.int64), *known], axis=1).astype(np.float64)
                cut, many = len(words), np.bincount(doc, minlength=len(listed[row]))
                mine, size = target[doc], many[doc]
                scale, both = (n / m, False) if n and m else (1.0, True)
                uni, pair = own_counts(doc, ids), own_counts(doc[first], at)
                means = []
                for c, total, inside, by in ((t + g if both else t, n + m if both else n, mine | both, 1.0), (t + g if both else g, n + m if both else m, ~mine | both, scale)):
                    w = (c[:cut][ids] - uni * inside) * by
                    k = (c[cut:][at] - pair * inside[first]) * by
                    means.append(np.bincount(doc, losses(w, w[first], k, first, (total - size * inside) * by, words_known), minlength=len(many)) / np.maximum(many, 1))
                t, g = means
                yield pa.RecordBatch.from_arrays([listed[row].values.cast(kind), pa.array(many, pa.int64()), pa.array(t), pa.array(g), pa.array(t - g)], ["doc_id", "n_tokens", "target_loss", "background_loss", "score"])

    return run


def _sweep(spark) -> None:
    """Shuffle files that no plan reads any more go now; else they stay beside the next ones until the driver collects its garbage.
    Called after a further job, as Spark holds on to the plan of the last one."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def cross_entropy_difference(docs: DataFrame, labels: DataFrame, label: str = "quality", block: int = BLOCK) -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, score) of every row of docs; losses are means per token in nats."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType
    arrow, name = to_arrow_type(kind), kind.simpleString()
    # the same join at every size: a merge, as labelled rows grow with the input
    good = labels.where(F.col(label) == 1).select(F.col("doc_id").cast("long").alias("__id"), F.lit(True).alias("target")).distinct()
    marked = docs.select("doc_id", "text").join(good.hint("merge"), F.col("doc_id").cast("long") == F.col("__id"), "left").select("doc_id", "text", "target")
    blocks = materialize(marked.mapInArrow(_blocks(arrow, block), f"block long, doc_ids array<{name}>, lengths binary, words binary, ids binary, tokens long"), "lm-blocks")
    del good, marked
    bits = max(0, int((blocks.agg(F.sum("tokens")).first()[0] or 0) // (4 * block)).bit_length())
    _sweep(spark)
    grams = blocks.drop("doc_ids").mapInArrow(_counts(bits), "part int, block long, grams binary")
    sums = materialize(grams.groupBy("part").applyInArrow(_sums(bits), SUMS), "lm-sums")
    del grams
    stats = sums.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("words", "target", "background"))).first()
    _sweep(spark)
    own = sums.groupBy("block").agg(F.collect_list(F.struct("part", "sums")).alias("sums"))
    return blocks.join(own.hint("merge"), "block", "left").mapInArrow(_scores(*stats, arrow), f"doc_id {name}, n_tokens long, target_loss double, background_loss double, score double")
