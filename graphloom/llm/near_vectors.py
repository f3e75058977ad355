"""Near-duplicate embeddings by NN-descent.

Vectors of equal label and length are compared by cosine in double precision.  Equal
vectors are one node with a multiplicity.  A forest of random hyperplane trees gives
first neighbour lists; rounds of neighbours-of-neighbours joins refine them: all
vectors on one node's list meet and offer themselves to each other.  An audit measures
recall against brute force for a bounded set of queries, and rounds go on, with longer
lists, while it is short of `recall`; if it never gets there, the query fails.

Lists that are full of links (saturated) hide further links.  Two things handle them
exactly: each comparison also keeps a spanning forest of the links that it saw, so no
connection gets lost behind a full list; and the lists of every linked component are
enlarged to the whole component, whose links are counted in blocks of at most BLOCK
rows, never emitted as pairs.

Cases: null vectors, zero vectors, vectors with null or non-finite parts and null
labels link with nothing and stand alone; vectors of other lengths never link; copies
link with each other; repeated ids are rows of their own with one id; of ties for a
list's last place the greatest id stays; other columns are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import connected_components, discard, materialize, uniform_hash

BLOCK = 1024
LEAF = 64
MEET = 384
#: True links that an audit should have seen.
LINKS = 50


def unit_rows(vectors) -> np.ndarray:
    x = np.stack([np.frombuffer(v, np.float64) for v in vectors])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def spanning_links(sim: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """A spanning forest of the graph of pairs at or above the threshold."""
    n, left, out = len(sim), np.ones(len(sim), bool), []
    linked = sim >= threshold
    np.fill_diagonal(linked, False)
    left &= linked.any(1)
    while left.any():
        front = [int(np.flatnonzero(left)[0])]
        left[front[0]] = False
        while front:
            k = front.pop()
            new = np.flatnonzero(linked[k] & left)
            left[new] = False
            out += [(k, int(j)) for j in new]
            front += new.tolist()
    return out


def offers(ids: np.ndarray, x: np.ndarray, k: int, threshold: float, floor: np.ndarray | None = None):
    """(u, v, sim) arrays: for each row its k nearest others above its floor; if that leaves out links, also a spanning forest of all links."""
    sim = x @ x.T
    n = len(ids)
    np.fill_diagonal(sim, -2)
    m = min(k, n - 1)
    u, v, s = [], [], []
    if m > 0:
        top = np.argpartition(-sim, m - 1, axis=1)[:, :m]
        rows = np.repeat(np.arange(n), m)
        cols = top.ravel()
        val = sim[rows, cols]
        if floor is not None:
            keep = val > floor[rows]
            rows, cols, val = rows[keep], cols[keep], val[keep]
        u, v, s = ids[rows], ids[cols], val
        linked = sim >= threshold
        linked[np.concatenate([rows, cols]), np.concatenate([cols, rows])] = False
        if linked.any():  # links that no kept offer carries: beyond the k nearest, or not above a floor
            for a, b in spanning_links(sim, threshold):
                u, v, s = np.append(u, ids[a]), np.append(v, ids[b]), np.append(s, sim[a, b])
    return np.asarray(u, np.int64), np.asarray(v, np.int64), np.asarray(s, np.float64)


def _clean(batches):
    """(vec_id, bucket of comparison or null, vector as doubles)."""
    for b in batches:
        raw, out, lens = b.column(1).to_pylist(), [], []
        for v in raw:
            x = np.array([np.nan if p is None else p for p in v], np.float64) if v is not None and len(v) else None
            with np.errstate(over="ignore", invalid="ignore"):
                good = x is not None and np.isfinite(x).all() and np.isfinite(np.linalg.norm(x)) and np.linalg.norm(x) > 0
            out.append(x.tobytes() if good else None)
            lens.append(len(x) if good else None)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(lens, pa.int32()), pa.array(out, pa.binary())], ["vec_id", "grp", "dim", "vec"])


def _codes(trees: int, depth: int, seed: int):
    """Rows (tree, code, rep, grp, vec): the signs before `depth` random hyperplanes."""

    def run(batches):
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            vecs = b.column("vec").to_pylist()
            depths = np.array(b.column("depth").to_pylist(), np.int64)
            dims = np.array([len(v) // 8 for v in vecs])
            codes = np.zeros((trees, len(vecs)), np.int64)
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                if d not in planes:
                    planes[d] = np.random.default_rng(seed).standard_normal((trees * depth, d))
                bits = (unit_rows([vecs[i] for i in at]) @ planes[d].T > 0).reshape(len(at), trees, depth)
                bits &= np.arange(depth) < depths[at][:, None, None]
                codes[:, at] = (bits << np.arange(depth)).sum(2).T
            for t in range(trees):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(vecs), t, np.int32)), pa.array(codes[t]), b.column("rep"), b.column("grp"), b.column("vec")], ["tree", "code", "rep", "grp", "vec"])

    return run


def _lists(offered: DataFrame, k: int) -> DataFrame:
    """(u, near): the k best distinct offers of each node, best first.  Each task keeps k of a node's offers before they are dealt out."""
    once = offered.groupBy("u", "v").agg(F.max("s").alias("s"))
    top = once.withColumn("place", F.row_number().over(Window.partitionBy("u").orderBy(F.desc("s"), F.desc("v")))).where(F.col("place") <= k)
    return top.groupBy("u").agg(F.sort_array(F.collect_list(F.struct("s", "v")), asc=False).alias("near"))


def _links(offered: DataFrame, threshold: float) -> DataFrame:
    return offered.where(F.col("s") >= threshold).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _local_join(k: int, threshold: float):
    """Rows sorted by w: everything on w's list meets."""

    def run(batches):
        held, at = [], None

        def meet():
            ids = np.array([r[0] for r in held], np.int64)
            ids, first = np.unique(ids, return_index=True)
            x = unit_rows([held[i][1] for i in first])
            return offers(ids, x, k, threshold, np.array([held[i][2] for i in first]))

        out, size = [], 0

        def batch():
            u, v, s = (np.concatenate(c) for c in zip(*out))
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(s)], ["u", "v", "s"])

        for b in batches:
            for w, v, vec, tau in zip(*(b.column(j).to_pylist() for j in range(4))):
                if w != at:
                    if len(held) > 1:
                        out.append(meet())
                        size += len(out[-1][0])
                        if size > 50_000:
                            yield batch()
                            out, size = [], 0
                    held, at = [], w
                held.append((v, vec, tau))
        if len(held) > 1:
            out.append(meet())
        if out:
            yield batch()

    return run


def _block_counts(threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        a = pdf[pdf["own"] == i]
        b = a if i == j else pdf[pdf["own"] == j]
        if not len(a) or not len(b):
            return pd.DataFrame({"rep": pd.Series([], dtype="int64"), "c": pd.Series([], dtype="int64")})
        linked = unit_rows(a["vec"]) @ unit_rows(b["vec"]).T >= threshold
        if i == j:
            np.fill_diagonal(linked, False)
            return pd.DataFrame({"rep": a["rep"].to_numpy(), "c": linked @ b["copies"].to_numpy()})
        return pd.DataFrame({"rep": np.concatenate([a["rep"], b["rep"]]), "c": np.concatenate([linked @ b["copies"].to_numpy(), linked.T @ a["copies"].to_numpy()])})

    return run


def audit(nodes: DataFrame, lists: DataFrame, threshold: float, k: int, queries: int = 200) -> tuple[int, int]:
    """(links on the lists, links that belong there) of about `queries` nodes, from brute force against all in one scan.

    A list of k can hold k links at most; what lies beyond is counted in blocks later.
    """
    total = nodes.count()
    picked = nodes.where(uniform_hash(F.col("rep"), 9) < queries / max(1, total)).select("rep", "grp", "vec").collect()
    if not picked:
        return 0, 0
    by: dict = {}
    for r in picked:
        by.setdefault((r["grp"], len(r["vec"])), []).append((r["rep"], bytes(r["vec"])))
    held = nodes.sparkSession.sparkContext.broadcast(by)

    def run(batches):
        ready = {g: (np.array([r for r, _ in q]), unit_rows([v for _, v in q])) for g, q in held.value.items()}
        for b in batches:
            rep, grp, vec = (b.column(c).to_pylist() for c in ("rep", "grp", "vec"))
            u, n = [], []
            for g, (ids, x) in ready.items():
                at = [k for k in range(len(rep)) if (grp[k], len(vec[k])) == g]
                if at:
                    hit = unit_rows([vec[k] for k in at]) @ x.T >= threshold
                    hit &= np.array([rep[k] for k in at])[:, None] != ids[None, :]
                    u += ids.tolist()
                    n += hit.sum(0).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(n, pa.int64())], ["u", "n"])

    true = nodes.select("rep", "grp", "vec").mapInArrow(run, "u long, n long").groupBy("u").agg(F.sum("n").alias("n")).where("n > 0")
    found = lists.select("u", F.size(F.filter("near", lambda x: x["s"] >= threshold)).alias("found"))
    got = true.join(found, "u", "left").agg(F.sum(F.least("n", F.lit(k))).alias("there"), F.sum(F.least(F.coalesce("found", F.lit(0)), "n")).alias("hit")).first()
    return got["hit"] or 0, got["there"] or 0


def near_vectors(vectors: DataFrame, threshold: float = 0.98, k: int = 10, trees: int = 6, rounds: int = 2, most_rounds: int = 8, recall: float = 0.97) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of vectors (vec_id, embedding, label)."""
    src = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("string").alias("grp"))
    rows = materialize(src.mapInArrow(_clean, "vec_id long, grp string, dim int, vec binary"), "vectors")
    good = rows.where("vec is not null and grp is not null and vec_id is not null")
    nodes = good.groupBy("grp", "vec").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    nodes = materialize(nodes.withColumn("dim", F.length("vec")), "vector-nodes")
    sizes = nodes.groupBy("grp", "dim").agg(F.count("*").alias("size"))
    depth = F.least(F.lit(30), F.greatest(F.lit(0), F.ceil(F.log2(F.col("size") / float(LEAF))).cast("int"))).alias("depth")
    coded = nodes.join(sizes.select("grp", "dim", depth), ["grp", "dim"]).select("rep", "grp", "vec", "depth").mapInArrow(_codes(trees, 30, 3), "tree int, code long, rep long, grp string, vec binary")
    coded = materialize(coded, "vector-codes")
    leaf = ["tree", "grp", "code"]
    full = coded.groupBy(*leaf).agg(F.count("*").alias("c"))
    dealt = coded.join(full, leaf).withColumn("part", F.pmod(F.xxhash64("rep", "tree"), F.ceil(F.col("c") / float(MEET))))
    dealt = dealt.repartition(*leaf, "part")  # else the parts of a full leaf stay in the task of the join above

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"u": pd.Series([], dtype="int64"), "v": pd.Series([], dtype="int64"), "s": pd.Series([], dtype="float64")})]
        for _, g in pdf.groupby(pdf["vec"].map(len)):
            if len(g) > 1:
                out.append(pd.DataFrame(dict(zip("uvs", offers(g["rep"].to_numpy(), unit_rows(g["vec"]), k, threshold)))))
        return pd.concat(out)

    offered = materialize(dealt.groupBy(*leaf, "part").applyInPandas(compare, "u long, v long, s double"), "vector-offers")
    discard(coded)
    lists = materialize(_lists(offered, k), "vector-lists")
    links = materialize(_links(offered, threshold), "vector-links")
    discard(offered)
    size = k
    for r in count():
        if r >= rounds:
            for queries in (200, 800, 3200):  # more where links are rare
                hit, there = audit(nodes, lists, threshold, size, queries)
                if there >= LINKS:
                    break
            if hit >= recall * there:
                break
            if r == most_rounds:
                raise RuntimeError(f"recall {hit} of {there} after {r} rounds")
            size *= 2
        tau = F.when(F.size("near") >= size, F.element_at("near", -1)["s"]).otherwise(F.lit(-2.0))
        known = nodes.join(lists, nodes["rep"] == lists["u"], "left").select(F.col("rep").alias("v"), "vec", F.coalesce(tau, F.lit(-2.0)).alias("tau"))
        pairs = lists.select(F.col("u").alias("w"), F.explode(F.array_append(F.transform("near", lambda x: x["v"]), F.col("u"))).alias("v"))
        met = pairs.join(known, "v").select("w", "v", "vec", "tau")
        met = met.repartition("w").sortWithinPartitions("w").mapInArrow(_local_join(size, threshold), "u long, v long, s double")
        met = materialize(met, "vector-offers")
        old = lists.select("u", F.explode("near").alias("x")).select("u", "x.v", "x.s")
        back = old.select(F.col("v").alias("u"), F.col("u").alias("v"), "s")  # whose neighbour a node is may be its own
        new_lists = materialize(_lists(met.union(old).union(back), size), "vector-lists")
        new_links = materialize(links.union(_links(met, threshold)).distinct(), "vector-links")
        discard(met, lists, links)
        lists, links = new_lists, new_links
    comp = materialize(connected_components(links), "vector-comp")
    members = nodes.join(comp, nodes["rep"] == comp["node"]).select("rep", "vec", "copies", "component")
    counts = members.groupBy("component").agg(F.ceil(F.count("*") / float(BLOCK)).cast("int").alias("blocks"))
    placed = members.join(counts, "component").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    spread = placed.select("component", "rep", "vec", "copies", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o")).select("component", F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"), "rep", "vec", "copies", "own")
    spread = spread.repartition("component", "i", "j")  # else all blocks of a component stay in one task
    linked = spread.groupBy("component", "i", "j").applyInPandas(_block_counts(threshold), "rep long, c long").groupBy("rep").agg(F.sum("c").alias("c"))
    known = nodes.join(linked, "rep", "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    per_node = known.select("grp", "vec", (F.coalesce("c", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    found = good.select("vec_id", "grp", "vec").join(per_node, ["grp", "vec"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not (vec is not null and grp is not null) and vec_id is not null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.union(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
