"""Packing token sequences by minimum bin slack.

Every document contributes whole windows of `capacity` ids, which are sequences of
their own, and one remainder.  Remainders wait in a pool as counts by length; for
each sequence the longest one is taken and a subset-sum over bitsets (one bit per
reachable fill) finds the multiset of other lengths that comes closest to the
capacity; the counts are backtracked, and the same multiset is laid out as often
as the counts allow.  A length that fills no sequence exactly is set aside while the
others are laid.  Where more than half a pool is left, and at the end of a task, the
longest get their closest fill, and one piece is cut to close the gap.  The last ids
of a task, less than a sequence, are cut at powers of two, which need no padding.

A task packs its own rows: nothing is shuffled, the pool holds at most `pool`
remainders, and a lost task is redone alone.

Cases: a null or empty text is one end-of-document id; texts of any length are
cut at windows; equal rows are packed each; an empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .bpe import encoder_for
from .common import text_slices

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def closest_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of available lengths with the greatest sum up to `room`: length -> how many."""
    if room <= 0:
        return {}
    mask = (1 << (room + 1)) - 1
    reach, layers = 1, []
    for length in sorted((k for k in counts if k <= room and counts[k] > 0), reverse=True):
        for _ in range(min(counts[length], room // length)):
            grown = (reach | reach << length) & mask
            if grown == reach:
                break
            layers.append((length, reach))
            reach = grown
            if reach >> room & 1:
                break
        if reach >> room & 1:
            break
    fill = reach.bit_length() - 1
    picked: dict[int, int] = defaultdict(int)
    for length, before in reversed(layers):
        if fill and not before >> fill & 1:
            picked[length] += 1
            fill -= length
    return dict(picked)


def minimum_bin_slack(counts: dict[int, int], capacity: int, slack: int | None = None):
    """Yields (multiset, times) until nothing is left; with `slack`, keeps back the lengths that would leave more than that unused."""
    counts = {k: v for k, v in counts.items() if v > 0}
    while counts:
        head = max(counts)
        rest = dict(counts)
        rest[head] -= 1
        picked = closest_fill(rest, capacity - head)
        picked[head] = picked.get(head, 0) + 1
        if slack is not None and capacity - sum(k * v for k, v in picked.items()) > slack:
            del counts[head]  # it closes no multiset of what is left, so none of a smaller head either
            continue
        times = min(counts[k] // v for k, v in picked.items())
        for k, v in picked.items():
            counts[k] -= v * times
            if not counts[k]:
                del counts[k]
        yield picked, times


class Packer:
    """Collects remainders and gives out packed pieces as columns."""

    def __init__(self, capacity: int, pool: int, first_sequence: int):
        self.capacity, self.pool, self.sequence = capacity, pool, first_sequence
        self.wait: dict[int, list] = defaultdict(list)
        self.waiting = 0
        self.out: list[tuple] = []
        self.whole: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        c, n = self.capacity, len(ids)
        for start in range(0, n - c + 1, c):
            self.out.append((doc_id, start, c, ids[start : start + c].tobytes(), n, self.sequence, 0))
            self.sequence += 1
        if n % c:
            self.wait[n % c].append((doc_id, n - n % c, ids[n - n % c :].copy(), n))
            self.waiting += 1
        if self.waiting >= self.pool:
            self.flush(False)

    def lay(self, pieces) -> None:
        offset = 0
        for doc_id, start, ids, n in pieces:
            self.out.append((doc_id, start, len(ids), ids.tobytes(), n, self.sequence, offset))
            offset += len(ids)
        self.sequence += 1

    def closest(self) -> list[tuple]:
        """Takes the longest remainder, its closest fill, and for the gap the start of the longest one left, which no gap exceeds."""
        head = max(self.wait)
        counts = {k: len(v) for k, v in self.wait.items()}
        counts[head] -= 1
        picked = closest_fill(counts, self.capacity - head)
        picked[head] = picked.get(head, 0) + 1
        pieces = [self.take_one(k) for k, v in picked.items() for _ in range(v)]
        gap = self.capacity - sum(k * v for k, v in picked.items())
        if gap:
            doc_id, start, ids, n = self.take_one(max(self.wait))
            pieces.append((doc_id, start, ids[:gap], n))
            self.wait[len(ids) - gap].append((doc_id, start + gap, ids[gap:], n))
        return pieces

    def take_one(self, length: int) -> tuple:
        out = self.wait[length].pop()
        if not self.wait[length]:
            del self.wait[length]
        return out

    def flush(self, last: bool) -> None:
        for picked, times in minimum_bin_slack({k: len(v) for k, v in self.wait.items()}, self.capacity, 0):
            for _ in range(times):
                self.lay([self.wait[k].pop() for k, v in picked.items() for _ in range(v)])
        self.wait = defaultdict(list, {k: v for k, v in self.wait.items() if v})
        total = sum(k * len(v) for k, v in self.wait.items())
        while total >= self.capacity and (last or sum(map(len, self.wait.values())) > self.pool // 2):
            self.lay(self.closest())
            total -= self.capacity
        if last:
            left = [x for v in self.wait.values() for x in v]
            self.wait.clear()
            while left:
                total = sum(len(x[2]) for x in left)
                size, row, fill = min(self.capacity, 1 << (total.bit_length() - 1)), [], 0
                while fill < size:
                    doc_id, start, ids, n = left.pop()
                    take = min(len(ids), size - fill)
                    row.append((doc_id, start, ids[:take], n))
                    if take < len(ids):
                        left.append((doc_id, start + take, ids[take:], n))
                    fill += take
                self.lay(row)
        self.waiting = sum(map(len, self.wait.values()))

    def take(self) -> pa.RecordBatch:
        cols = list(zip(*self.out)) if self.out else [[]] * 7
        self.out = []
        kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 3
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])


def pack_documents(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 0, pool: int = 4096) -> DataFrame:
    """Pieces (doc_id, start, length, ids, doc_tokens, sequence_id, offset); ids: little-endian unsigned 32-bit.

    Ids are those of the tokenizers library for the file at `path`, then end_id.
    sequence_id is unique over the result: the task's number in its upper bits.
    """

    def run(batches):
        enc = encoder_for(path, "library")
        packer = Packer(capacity, pool, TaskContext.get().partitionId() << 36)
        for b in batches:
            doc_ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lo, hi in text_slices(texts):
                flat, n = enc.encode([t or "" for t in texts[lo:hi]])
                flat = flat.astype("<u4")
                end = 0
                for doc_id, k in zip(doc_ids[lo:hi], n.tolist()):
                    packer.add(doc_id, np.append(flat[end : end + k], np.uint32(end_id)))
                    end += k
                yield packer.take()
        packer.flush(True)
        yield packer.take()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
