"""N-gram Jaccard self-join by grouped prefixes.

Documents with equal shingle sets are one class.  A total order puts rare shingles
first; two sets can only be similar enough if they meet in their prefixes under that
order.  Classes with identical prefixes and size make one group; groups that share a
prefix shingle are filtered by size and position, and the survivors expand to their
members, which are verified on their sets.

How the order is found without gathering a hot shingle in one task:

* Pass 1 names the very frequent shingles: every run of CHUNK shingles reports those
  that it holds at least share/2 times its size, so that every shingle with at least
  `share` of all occurrences is caught, and at most 2/share ones are (the bound of
  what is broadcast).  They come last in the order.
* Pass 2 sends all other shingles, delta-coded, to reducers by ranges of the hash,
  which return document frequencies of those seen twice or more to the block that
  sent them.  Shingles seen once precede all others and can match nothing: a class
  whose prefix holds only such ones has no partner and goes no further.

Linked classes only need to be connected, not enumerated: rounds of comparisons with
one centre per prefix shingle merge large families first; then every remaining
candidate pair of different components is verified, so no link between different
components is lost.  Where more than HOT groups hold one prefix shingle, as in a family
of near copies, they do not meet pair by pair: each member is measured against the
shingle's centre, and a pair that may yet be similar is found by the shingles that it
shares outside the centre (`_apart`).

Cases: null, empty or blank texts have no shingles and stand alone; shorter texts than
the width are one shingle; equal texts share a class whatever their number; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, csr_gather, discard, materialize
from .shingles import batch_shingles, class_of

#: Shingles that are counted and sent at a time.
CHUNK = 1_500_000
#: Shingles with this share of all occurrences are certainly named frequent.
SHARE = 2.0**-17
BITS = 56
#: Rows of a token, or pairs of members of two groups, up to which all meet all; beyond, they meet around centres.
HOT = 64
#: A round of centres that links a smaller share of what it compares is the last one.
WORTH = 0.1


def _narrow(h: np.ndarray) -> np.ndarray:
    return h >> np.uint64(64 - BITS)


def _pack(h: np.ndarray) -> bytes:
    """Sorted hashes as differences of as few bytes as fit."""
    d = np.diff(h, prepend=np.uint64(0))
    width = max(1, (int(d.max()).bit_length() + 7) // 8) if len(d) else 1
    return bytes([width]) + d.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpack(b: bytes) -> np.ndarray:
    raw = np.frombuffer(b, np.uint8, offset=1).reshape(-1, b[0])
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, : b[0]] = raw
    return np.cumsum(out.view("<u8").ravel(), dtype=np.uint64)


def _count_pass(width: int):
    """kind 0: doc_id, class, set size; kind 1: frequent shingle, its count; kind 2: shingles counted."""

    def run(batches):
        held, size, known = [], 0, set()

        def frequent():
            h, n = np.unique(np.concatenate(held), return_counts=True)
            often = n >= max(2, SHARE / 2 * size)
            k = int(often.sum())
            return pa.RecordBatch.from_pydict({"kind": [1] * k + [2], "a": pa.array(np.append(h[often].astype(np.int64), 0)), "b": pa.array(np.append(n[often], size).astype(np.int64)), "n": [0] * (k + 1)}, schema=schema)

        schema = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])
        for b in batches:
            ids, classes, sizes = b.column(0).to_pylist(), [], []
            for s in batch_shingles(b.column(1), width):
                classes.append(class_of(s))
                sizes.append(len(s))
                if len(s) and classes[-1] not in known:
                    known.add(classes[-1])
                    held.append(_narrow(s))
                    size += len(s)
                if size >= CHUNK:
                    yield frequent()
                    held, size, known = [], 0, set()
            yield pa.RecordBatch.from_pydict({"kind": [0] * len(ids), "a": ids, "b": classes, "n": sizes}, schema=schema)
        if held:
            yield frequent()

    return run


def _send_pass(width: int, frequent, bits: int):
    """Rows for reducers by hash range (kind 0: hashes and slots) and the blocks themselves (kind 1: class, size, frequent ranks)."""

    schema = pa.schema([("key", pa.int64()), ("kind", pa.int32()), ("block", pa.int64()), ("x", pa.binary()), ("y", pa.binary())])

    def run(batches):
        base, chunk = TaskContext.get().partitionId() << 24, 0
        often, rank, _ = frequent.value
        held, classes, size = [], {}, 0

        def block():
            h = np.concatenate([_narrow(s) for s in held])
            lens = np.fromiter(map(len, held), np.int64, len(held))
            slot = np.repeat(np.arange(len(held), dtype=np.uint32), lens)
            at = np.searchsorted(often, h)
            at[at == len(often)] = 0
            hot = often[at] == h if len(often) else np.zeros(len(h), bool)
            name = base + chunk
            info = np.column_stack([np.fromiter(classes, np.int64, len(held)), lens, np.bincount(slot[hot], minlength=len(held))])
            yield name, 1, name, info.tobytes(), rank[at[hot]].tobytes()
            h, slot = h[~hot], slot[~hot]
            order = np.argsort(h)
            h, slot = h[order], slot[order]
            part = h >> np.uint64(BITS - bits)
            cuts = np.append(np.flatnonzero(np.diff(part, prepend=np.uint64(1 << 63))), len(h))
            small = np.uint16 if len(held) <= 65536 else np.uint32
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                yield int(part[a]), 0, name, _pack(h[a:b]), slot[a:b].astype(small).tobytes()

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*block()), schema.types)], schema=schema)

        for b in batches:
            for s in batch_shingles(b.column(1), width):
                c = class_of(s)
                if len(s) and c not in classes:
                    classes[c] = True
                    held.append(s)
                    size += len(s)
                if size >= CHUNK:
                    yield rows()
                    held, classes, size, chunk = [], {}, 0, chunk + 1
        if held:
            yield rows()

    return run


def _frequency_pass(batches):
    """Rows come sorted by key: document frequencies of shingles seen twice or more go back to their blocks."""
    schema = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("x", pa.binary()), ("y", pa.binary())])
    key, held = None, []

    def answer():
        if not held:
            return
        hs = [_unpack(x) for _, x, _ in held]
        lens = [len(h) for h in hs]
        slots = np.concatenate([np.frombuffer(y, np.uint16 if len(y) == 2 * n else np.uint32).astype(np.uint32) for (_, _, y), n in zip(held, lens)])
        src = np.repeat(np.arange(len(held)), lens)
        h = np.concatenate(hs)
        order = np.argsort(h, kind="stable")
        h, src, slots = h[order], src[order], slots[order]
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        run = np.diff(np.append(first, len(h)))
        df = np.repeat(run, run)
        keep = df >= 2
        h, src, slots, df = h[keep], src[keep], slots[keep], df[keep]
        order = np.argsort(src, kind="stable")
        h, src, slots, df = h[order], src[order], slots[order], df[order]
        cuts = np.append(np.flatnonzero(np.diff(src, prepend=-1)), len(src))
        out = [(held[src[a]][0], 0, _pack(h[a:b]), np.column_stack([slots[a:b], df[a:b].astype(np.uint32)]).astype(np.uint32).tobytes()) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    for b in batches:
        for k, kind, block, x, y in zip(*(b.column(j).to_pylist() for j in range(5))):
            if kind == 1:
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((block, 1, x, y), schema.types)], schema=schema)
                continue
            if k != key:
                yield from answer()
                key, held = k, []
            held.append((block, x, y))
    yield from answer()


def _prefix_pass(frequent, num: int, den: int):
    """Blocks come together again: for each class that may have partners its size, prefix and shared shingles."""
    schema = pa.schema([("cls", pa.int64()), ("n", pa.int64()), ("lead", pa.int64()), ("prefix", pa.list_(pa.int64())), ("shingles", pa.binary())])

    def run(batches):
        by_rank = frequent.value[2]

        def finish(info, ranks, parts):
            cls, n, hot = np.frombuffer(info, np.int64).reshape(-1, 3).T
            hs = [_unpack(x) for x, _ in parts]
            sd = [np.frombuffer(y, np.uint32).reshape(-1, 2) for _, y in parts]
            h = np.concatenate([*hs, by_rank[np.frombuffer(ranks, np.uint32)]]).astype(np.uint64)
            slot = np.concatenate([*(x[:, 0] for x in sd), np.repeat(np.arange(len(n)), hot)]).astype(np.int64)
            # frequent ones come last, in the order of the broadcast
            df = np.concatenate([*(x[:, 1].astype(np.int64) for x in sd), (1 << 40) + np.frombuffer(ranks, np.uint32).astype(np.int64)])
            shared = np.bincount(slot, minlength=len(n))
            need = n - (num * n + den - 1) // den + 1
            lead = n - shared
            live = lead < need
            keep = live[slot]
            h, slot, df = h[keep], slot[keep], df[keep]
            order = np.lexsort((h, df, slot))
            h, slot = h[order], slot[order]
            ids, starts = np.unique(slot, return_index=True)
            ends = np.append(starts[1:], len(slot))
            out = {k: [] for k in schema.names}
            for i, a, b in zip(ids.tolist(), starts.tolist(), ends.tolist()):
                out["cls"].append(int(cls[i]))
                out["n"].append(int(n[i]))
                out["lead"].append(int(lead[i]))
                out["prefix"].append(h[a : a + int(need[i] - lead[i])].astype(np.int64))
                out["shingles"].append(np.sort(h[a:b]).tobytes())
            return pa.RecordBatch.from_pydict(out, schema=schema)

        block, info, ranks, parts = None, None, None, []
        for b in batches:
            for name, kind, x, y in zip(*(b.column(j).to_pylist() for j in range(4))):
                if name != block:
                    if info is not None:
                        yield finish(info, ranks, parts)
                    block, info, ranks, parts = name, None, None, []
                if kind == 1:
                    info, ranks = x, y
                else:
                    parts.append((x, y))
        if info is not None:
            yield finish(info, ranks, parts)

    return run


def _verify_pass(num: int, den: int):
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches):
        for b in batches:
            u, v, nu, nv = (b.column(k).to_pylist() for k in range(4))
            keep = []
            for k, (x, y) in enumerate(zip(b.column(4), b.column(5))):
                x, y = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                both = len(x) + len(y) - len(np.union1d(x, y))
                if den * both >= num * (nu[k] + nv[k] - both):
                    keep.append(k)
            yield pa.RecordBatch.from_pydict({"u": [u[k] for k in keep], "v": [v[k] for k in keep]}, schema=schema)

    return run


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Those of the class pairs (u, v) whose sets are similar enough.  Only sets that a pair needs are dealt out."""
    needed = pairs.select(F.explode(F.array("u", "v")).alias("cls")).distinct()
    sets = sets.select("cls", "n", "shingles").join(needed, "cls", "left_semi")
    a = sets.select(F.col("cls").alias("u"), F.col("n").alias("nu"), F.col("shingles").alias("xu"))
    b = sets.select(F.col("cls").alias("v"), F.col("n").alias("nv"), F.col("shingles").alias("xv"))
    joined = pairs.join(b, "v").join(a, "u").select("u", "v", "nu", "nv", "xu", "xv")
    return joined.mapInArrow(_verify_pass(num, den), "u long, v long")


def ngram_jaccard_join(docs: DataFrame, width: int = 5, num: int = 75, den: int = 100, rounds: int = 6) -> DataFrame:
    """(doc_id, n_shingles, component_id): components under Jaccard similarity >= num/den of word-shingle sets."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    seen = materialize(src.mapInArrow(_count_pass(width), "kind int, a long, b long, n long"), "ngram-pass1")
    total = seen.where("kind = 2").agg(F.sum("b")).first()[0] or 0
    often = seen.where("kind = 1").groupBy("a").agg(F.sum("b").alias("b")).where(F.col("b") >= max(2.0, SHARE / 2 * total)).orderBy("b", "a")
    ranked = np.array([r.a for r in often.collect()], np.int64).astype(np.uint64)  # at most 2 / SHARE rows
    rank = np.argsort(ranked)
    frequent = sc.broadcast((ranked[rank], rank.astype(np.uint32), ranked))  # by value, their ranks by count, by rank
    bits = max(3, int(np.ceil(np.log2(max(1, total) / CHUNK + 1))))
    parts = max(1 << bits, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sent = src.mapInArrow(_send_pass(width, frequent, bits), "key long, kind int, block long, x binary, y binary")
    counted = sent.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_frequency_pass, "block long, kind int, x binary, y binary")
    blocks = counted.repartition(parts, "block").sortWithinPartitions("block")
    sets = blocks.mapInArrow(_prefix_pass(frequent, num, den), "cls long, n long, lead long, prefix array<long>, shingles binary")
    classes = sets.dropDuplicates(["cls"]).withColumn("prefix_hash", F.xxhash64("n", "prefix"))
    members = materialize(classes.select("cls", "n", "lead", "prefix_hash", "prefix", "shingles"), "ngram-classes")
    roster, links = _group(members, num, den)
    tokens = materialize(
        members.join(roster.where("cls = rep").select("cls"), "cls", "left_semi")
        .select(F.col("cls").alias("rep"), "n", "lead", F.posexplode("prefix").alias("pos", "token"))
        .select("rep", "n", "lead", (F.col("lead") + F.col("pos")).alias("place"), "token", F.floor(F.log(F.col("n").cast("double")) / float(np.log(den / num))).alias("scale")),
        "ngram-tokens",
    )
    found = [links]
    comp = None  # so far every representative is a component of its own
    for k in range(rounds):
        labelled = _labelled(tokens, comp)
        # first the class with the fewest shingles of its own, from which the others of a family derive; then any
        own = (F.col("lead") / F.col("n") if k == 0 else F.lit(0.0)).alias("own")
        centre = labelled.groupBy("token", "scale").agg(F.min(F.struct(own, F.xxhash64("rep", F.lit(k)).alias("o"), "rep", "comp")).alias("c"))
        pick = labelled.join(centre, ["token", "scale"]).where("comp <> c.comp").groupBy("rep").agg(F.min("c").alias("c")).select(F.col("rep").alias("u"), F.col("c.rep").alias("v"))
        pick = materialize(pick, "ngram-pick")
        tried = pick.count()
        new = materialize(_verified(pick, members, num, den), "ngram-links") if tried else pick
        linked = new.count() if tried else 0
        if linked:
            found.append(new)
            old, (comp, found) = comp, _settled(found)
            discard(old)
        if linked < WORTH * tried or not tried:
            break
    pairs, families = _candidates(_labelled(tokens, comp), roster, num, den)
    linked = materialize(_verified(pairs, members, num, den), "ngram-links")
    found.append(linked)
    # of pairs of groups whose representatives are not linked, the members meet: all of them, or around a centre
    sizes = roster.groupBy("rep").agg(F.count("*").alias("size")).where("size > 1")
    sa, sb = (sizes.select(F.col("rep").alias(r), F.col("size").alias(f"size_{r}")) for r in "uv")
    wide = pairs.join(linked, ["u", "v"], "left_anti").join(sa, "u", "left").join(sb, "v", "left").withColumn("many", F.coalesce("size_u", F.lit(1)) * F.coalesce("size_v", F.lit(1))).where("many > 1").select("u", "v", "many")
    wide = materialize(wide, "ngram-wide")
    ma, mb = (roster.select(F.col("rep").alias(r), F.col("cls").alias(c)) for r, c in (("u", "cu"), ("v", "cv")))
    expanded = wide.where(F.col("many") <= HOT).join(ma, "u").join(mb, "v").select(F.col("cu").alias("u"), F.col("cv").alias("v"))
    found.append(materialize(_verified(expanded, members, num, den), "ngram-links"))
    around = wide.where(F.col("many") > HOT).select(F.col("u").alias("c"), F.explode(F.array("u", "v")).alias("rep")).distinct()
    named = families.union(around).distinct().join(roster, "rep").select("c", "cls").distinct()
    known = materialize(_measured(named, members, num, den), "ngram-families")
    found.append(known.where("linked and cls <> c").select(F.col("cls").alias("u"), F.col("c").alias("v")))
    old, (comp, found) = comp, _settled(found)
    discard(old)
    apart = known if known.isEmpty() else materialize(_apart(_labelled(known, comp, "cls"), num, den), "ngram-pairs")
    if not apart.isEmpty():
        last = materialize(_verified(apart, members, num, den), "ngram-links")
        if not last.isEmpty():
            comp, _ = _settled([*found, last])
    members_of = seen.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("cls"), F.col("n").alias("n_shingles"))
    first = members_of.where("n_shingles > 0").groupBy("cls").agg(F.min("doc_id").alias("first"))
    named = first.join(comp.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "first", F.coalesce("component", "cls").alias("comp"))
    low = named.groupBy("comp").agg(F.min("first").alias("component_id"))
    by_class = named.join(low, "comp").select("cls", "component_id")
    full = members_of.where("n_shingles > 0").join(by_class, "cls").select("doc_id", "n_shingles", "component_id")
    return full.union(members_of.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def _group(members: DataFrame, num: int, den: int, rounds: int = 3) -> tuple[DataFrame, DataFrame]:
    """(cls, rep) of the groups, and the links (u, v) of members to their representatives.

    Classes with identical prefix and size are one group as far as they are verified to
    be like its least class; the others try again among themselves, and what is left
    after the last round stands alone.  So a group is connected, and lies in one component.
    """
    left = members.select("cls", "n", "prefix_hash")
    parts, links = [], []
    for _ in range(rounds):
        rep = left.groupBy("n", "prefix_hash").agg(F.min("cls").alias("rep"))
        named = materialize(left.join(rep, ["n", "prefix_hash"]).select("cls", "n", "prefix_hash", "rep"), "ngram-groups")
        same = materialize(_verified(named.where("cls <> rep").select(F.col("cls").alias("u"), F.col("rep").alias("v")), members, num, den), "ngram-links")
        links.append(same)
        parts.append(named.where("cls = rep").select("cls", "rep").union(same.select(F.col("u").alias("cls"), F.col("v").alias("rep"))))
        left = named.where("cls <> rep").join(same.select(F.col("u").alias("cls")), "cls", "left_anti").select("cls", "n", "prefix_hash")
        if left.isEmpty():
            break
    parts.append(left.select("cls", F.col("cls").alias("rep")))
    return materialize(_all(parts), "ngram-roster"), _all(links)


def _candidates(labelled: DataFrame, roster: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (u, v) of representatives of different components that share a token of few rows, and for the
    tokens of many rows the centres c with the representatives (c, rep) that meet there.

    So no row joins more than HOT others.  A pair of sizes that can be similar lies in one scale or in two
    that follow each other; it has the lower scale's centre in common.
    """
    rows = materialize(labelled, "ngram-rows")
    of = rows.groupBy("token").agg(F.count("*").alias("rows"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high")
    few, many = (rows.join(of.where(w).select("token"), "token") for w in (F.col("rows") <= HOT, F.col("rows") > HOT))
    a, b = (few.select("token", *(F.col(c).alias(f"{c}_{s}") for c in ("rep", "n", "lead", "place", "comp"))) for s in "ab")
    na, nb = F.col("n_a"), F.col("n_b")
    # a is the smaller: its shorter index prefix is enough (Xiao et al. 2008)
    ordered = (na < nb) | ((na == nb) & (F.col("rep_a") < F.col("rep_b")))
    indexed = F.col("place_a") <= na - F.ceil(na * (2 * num / (num + den)) - 1e-9)
    # besides a shared shingle, only shared ones before it in both and any after it can be common
    bound = F.least(F.col("place_a") - F.col("lead_a"), F.col("place_b") - F.col("lead_b")) + 1 + F.least(na - F.col("place_a") - 1, nb - F.col("place_b") - 1)
    met = a.join(b, "token").where(ordered & indexed & (F.col("comp_a") != F.col("comp_b")) & (den * na >= num * nb) & ((num + den) * bound >= num * (na + nb)))
    # shared prefix shingles are all that precede the last of them
    rest = F.least(na - F.col("last_a") - 1, nb - F.col("last_b") - 1)
    pairs = (
        met.groupBy(F.col("rep_a").alias("u"), F.col("rep_b").alias("v"))
        .agg(F.first(na).alias("n_a"), F.first(nb).alias("n_b"), F.count("*").alias("c"), F.max("place_a").alias("last_a"), F.max("place_b").alias("last_b"))
        .where((num + den) * (F.col("c") + rest) >= num * (na + nb))
        .select("u", "v")
    )
    centre = many.groupBy("token", "scale").agg(F.min(F.struct((F.col("lead") / F.col("n")).alias("own"), F.xxhash64("rep").alias("o"), "rep"))["rep"].alias("c"))
    near = many.select("token", "rep", F.explode(F.array("scale", F.col("scale") - 1)).alias("scale")).join(centre, ["token", "scale"]).select("c", "rep").distinct()
    return materialize(pairs, "ngram-met"), materialize(near, "ngram-near")


def _measure_pass(num: int, den: int):
    schema = pa.schema([("c", pa.int64()), ("cls", pa.int64()), ("n", pa.int64()), ("common", pa.int64()), ("linked", pa.bool_()), ("outside", pa.list_(pa.int64()))])

    def run(batches):
        for b in batches:
            c, cls, n, nc = (b.column(k).to_pylist() for k in range(4))
            common, outside = [], []
            for x, y in zip(b.column(4), b.column(5)):
                x, y = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                rest = np.setdiff1d(x, y, assume_unique=True)
                common.append(len(x) - len(rest))
                outside.append(rest.astype(np.int64))
            linked = [den * i >= num * (p + q - i) for i, p, q in zip(common, n, nc)]
            yield pa.RecordBatch.from_pydict({"c": c, "cls": cls, "n": n, "common": common, "linked": linked, "outside": outside}, schema=schema)

    return run


def _measured(named: DataFrame, members: DataFrame, num: int, den: int) -> DataFrame:
    """(c, cls, n, common, linked, outside): each class's shingles in common with its centre, and its shared ones outside."""
    sets = members.join(named.select(F.explode(F.array("c", "cls")).alias("cls")).distinct(), "cls", "left_semi")
    centre = sets.select(F.col("cls").alias("c"), F.col("n").alias("nc"), F.col("shingles").alias("y"))
    joined = named.join(centre, "c").join(sets.select("cls", "n", F.col("shingles").alias("x")), "cls").select("c", "cls", "n", "nc", "x", "y")
    return joined.mapInArrow(_measure_pass(num, den), "c long, cls long, n long, common long, linked boolean, outside array<long>")


def _apart(known: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (u, v) around one centre that may be similar, of classes of different components.

    Two classes have at most the smaller of their numbers in common with the centre within
    it, and outside it only what they share there.  So either they share a shingle outside
    it, where the many that all copies share do not lie; or both have more in common with
    the centre than a similar pair of their sizes needs, which for a class that is not
    linked to the centre leaves only partners smaller than the centre.
    """
    sides = ("cls", "n", "common", "out", "comp")
    known = known.withColumn("out", F.size("outside"))
    mixed = known.groupBy("c").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("c")
    known = known.join(mixed, "c", "left_semi")
    na, nb = F.col("n_a"), F.col("n_b")
    within, shared = F.least("common_a", "common_b"), F.least("out_a", "out_b")
    fits = (F.col("comp_a") != F.col("comp_b")) & (den * na >= num * nb) & (den * nb >= num * na)
    side = lambda df, s, *keys: df.select(*keys, *(F.col(x).alias(f"{x}_{s}") for x in sides))
    spread = known.select("c", *sides, F.explode("outside").alias("token"))
    at = spread.groupBy("c", "token").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("c", "token")
    spread = spread.join(at, ["c", "token"])
    a, b = (side(spread, s, "c", "token") for s in "ab")
    met = a.join(b, ["c", "token"]).where(fits & (F.col("cls_a") < F.col("cls_b")) & ((num + den) * (within + shared) >= num * (na + nb)))
    outside = (
        met.groupBy("c", F.col("cls_a").alias("u"), F.col("cls_b").alias("v")).agg(F.count("*").alias("k"), F.first(within).alias("w"), F.first(na + nb).alias("n"))
        .where((num + den) * (F.col("w") + F.col("k")) >= num * F.col("n")).select("u", "v")
    )
    step = lambda x: F.floor(F.log(F.greatest(x, F.lit(1)).cast("double")) * 50)
    most = F.floor((num + den) * F.col("common") / num) - F.col("n")  # the largest partner that need not share anything outside
    least = F.ceil(num * F.col("n") / den)
    short = known.where(~F.col("linked") & (most >= least)).withColumn("step", F.explode(F.sequence(step(least), step(most))))
    a, b = side(short, "a", "c", "step"), side(known.withColumn("step", step(F.col("n"))), "b", "c", "step")
    inside = a.join(b, ["c", "step"]).where(fits & ((num + den) * within >= num * (na + nb))).select(F.least("cls_a", "cls_b").alias("u"), F.greatest("cls_a", "cls_b").alias("v"))
    return outside.union(inside).distinct()


def _settled(links: list[DataFrame]) -> tuple[DataFrame, list[DataFrame]]:
    """(node, component) under the links, and links from node to component, which connect the same and take their place."""
    comp = materialize(connected_components(_all(links)), "ngram-comp")
    return comp, [comp.select(F.col("node").alias("u"), F.col("component").alias("v"))]


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out


def _labelled(df: DataFrame, comp: DataFrame | None, on: str = "rep") -> DataFrame:
    if comp is None:
        return df.withColumn("comp", F.col(on))
    return df.join(comp.select(F.col("node").alias(on), F.col("component").alias("comp")), on, "left").withColumn("comp", F.coalesce("comp", on))
