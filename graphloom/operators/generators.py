"""Graph generators: closed forms over ranges of ids, or arithmetic randomness."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.random import uniform
from ..graph import Graph
from ..plans.storage import cut

# Zachary's karate club (1977), from 0.
ZACHARY = (
    "0-1,0-2,0-3,0-4,0-5,0-6,0-7,0-8,0-10,0-11,0-12,0-13,0-17,0-19,0-21,0-31,1-2,1-3,1-7,1-13,1-17,1-19,1-21,1-30,"
    "2-3,2-7,2-8,2-9,2-13,2-27,2-28,2-32,3-7,3-12,3-13,4-6,4-10,5-6,5-10,5-16,6-16,8-30,8-32,8-33,9-33,13-33,14-32,14-33,"
    "15-32,15-33,18-32,18-33,19-33,20-32,20-33,22-32,22-33,23-25,23-27,23-29,23-32,23-33,24-25,24-27,24-31,25-31,26-29,"
    "26-33,27-33,28-31,28-33,29-32,29-33,30-32,30-33,31-32,31-33,32-33"
)


def _graph(spark: SparkSession, n: int, edges: DataFrame, directed: bool = False) -> Graph:
    return Graph(spark.range(n), edges, directed)


def ring(spark: SparkSession, n: int = 20, directed: bool = False, circular: bool = True) -> Graph:
    e = spark.range(n if circular else max(0, n - 1)).select(F.col("id").alias("src"), ((F.col("id") + 1) % n).alias("dst"))
    return _graph(spark, n, e, directed)


def cycle(spark: SparkSession, n: int = 12) -> Graph:
    return ring(spark, n)


def star(spark: SparkSession, n: int = 11, center: int = 0) -> Graph:
    return _graph(spark, n, spark.range(n).where(F.col("id") != center).select(F.lit(center).cast("long").alias("src"), F.col("id").alias("dst")))


def kary_tree(spark: SparkSession, n: int = 15, k: int = 2) -> Graph:
    return _graph(spark, n, spark.range(1, n).select(F.floor((F.col("id") - 1) / k).cast("long").alias("src"), F.col("id").alias("dst")))


def lattice(spark: SparkSession, width: int = 5, height: int = 5, periodic: bool = False) -> Graph:
    v = spark.range(width * height).select("id", (F.col("id") % width).alias("x"), F.floor(F.col("id") / width).cast("long").alias("y"))
    right = v.where(F.lit(periodic) | (F.col("x") < width - 1)).select(F.col("id").alias("src"), (F.col("y") * width + (F.col("x") + 1) % width).alias("dst"))
    down = v.where(F.lit(periodic) | (F.col("y") < height - 1)).select(F.col("id").alias("src"), ((F.col("y") + 1) % height * width + F.col("x")).alias("dst"))
    return _graph(spark, width * height, right.union(down))


def _pairs(spark: SparkSession, n: int) -> DataFrame:
    """(src, dst) with src < dst < n, made row by row without a join."""
    return spark.range(max(0, n - 1)).select(F.col("id").alias("src"), F.explode(F.sequence(F.col("id") + 1, F.lit(n - 1))).alias("dst"))


def full(spark: SparkSession, n: int = 10) -> Graph:
    return _graph(spark, n, _pairs(spark, n))


def famous(spark: SparkSession, name: str = "zachary") -> Graph:
    if name.lower() != "zachary":
        raise ValueError(f"no notable graph named {name!r}")
    pairs = [tuple(map(int, p.split("-"))) for p in ZACHARY.split(",")]
    return _graph(spark, 34, spark.createDataFrame(pairs, "src long, dst long"))


def gnp(spark: SparkSession, n: int = 30, p: float = 0.15, seed: int = 1) -> Graph:
    return _graph(spark, n, _pairs(spark, n).where(F.expr(uniform("src", "dst", seed)) < p))


def barabasi(spark: SparkSession, n: int = 50, m: int = 2, seed: int = 1) -> Graph:
    """Preferential attachment by copied endpoints (Batagelj and Brandes 2005).

    Slot 2i of edge i holds its source, i div m + 1; slot 2i + 1 copies a random earlier
    slot.  Chains of copies are followed by pointer jumping, whose rounds grow with the
    logarithm of the chain.  Loops and repeated edges go, so a vertex has at most m new edges.
    """
    slots = 2 * m * (n - 1)
    s = spark.range(slots).withColumn("ref", F.when(F.col("id") % 2 == 0, F.col("id")).when(F.col("id") < 2 * m, F.lit(-1)).otherwise(F.floor(F.expr(uniform("id", "0", seed)) * (F.col("id") - 1)).cast("long")))
    for _ in range(max(1, int(np.ceil(np.log2(slots + 2))))):
        t = s.select(F.col("id").alias("__i"), F.col("ref").alias("__r"))
        s = s.join(t, F.col("ref") == F.col("__i"), "left").select("id", F.coalesce("__r", "ref").alias("ref"))
    vertex = F.when(F.col("ref") < 0, F.lit(0)).otherwise(F.floor(F.col("ref") / (2 * m)).cast("long") + 1)
    ends = s.select(F.floor(F.col("id") / 2).alias("e"), F.when(F.col("id") % 2 == 0, 0).otherwise(1).alias("k"), vertex.alias("v"))
    e = ends.groupBy("e").agg(F.max(F.when(F.col("k") == 0, F.col("v"))).alias("src"), F.max(F.when(F.col("k") == 1, F.col("v"))).alias("dst"))
    return _graph(spark, n, e.select("src", "dst")).simplify()


def watts_strogatz(spark: SparkSession, n: int = 20, nei: int = 2, p: float = 0.1, seed: int = 1, rounds: int = 20) -> Graph:
    """A ring lattice whose edges are rewired at one end with probability p; edges that would repeat another draw again."""
    base = spark.range(n * nei).select(F.col("id").alias("eid"), F.floor(F.col("id") / nei).cast("long").alias("a"), (F.col("id") % nei + 1).alias("step"))
    base = base.select("eid", "a", ((F.col("a") + F.col("step")) % n).alias("b"), (F.expr(uniform("eid", "0", seed)) < p).alias("move"))
    fixed = base.where("not move").select("eid", F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))
    todo, done = base.where("move").select("eid", "a"), fixed
    for r in range(rounds):
        target = F.floor(F.expr(uniform("eid", str(r + 1), seed + 1)) * n).cast("long")
        drawn = todo.select("eid", "a", target.alias("b")).where("a <> b").select("eid", "a", F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))
        first = drawn.groupBy("src", "dst").agg(F.min("eid").alias("eid"))
        got = first.join(done.select("src", "dst"), ["src", "dst"], "left_anti").select("eid", "src", "dst")
        done = cut(done.union(got))
        todo = todo.join(done.select("eid"), "eid", "left_anti")
        if todo.isEmpty():
            break
    # what found no free place in all rounds goes back to the lattice
    left = base.join(todo.select("eid"), "eid", "left_semi").select("eid", F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))
    left = left.join(done.select("src", "dst"), ["src", "dst"], "left_anti").select("eid", "src", "dst")
    return _graph(spark, n, done.union(left).select("src", "dst"))


def _sequential(spark: SparkSession, n: int, pairs) -> Graph:
    return _graph(spark, n, spark.createDataFrame([(int(a), int(b)) for a, b in pairs], "src long, dst long"))


def forest_fire(spark: SparkSession, n: int = 50, forward: float = 0.2, backward: float = 0.2, ambassadors: int = 1, seed: int = 1) -> Graph:
    """Leskovec et al. 2005; each vertex needs all earlier ones, so it grows on the driver."""
    rng = np.random.default_rng(seed)
    out, into, pairs = [set() for _ in range(n)], [set() for _ in range(n)], []
    for v in range(1, n):
        burnt, front = set(), [int(a) for a in rng.choice(v, min(ambassadors, v), replace=False)]
        burnt.update(front)
        while front:
            w = front.pop(0)
            for near, ratio in ((out[w], forward), (into[w], forward * backward)):
                fresh = sorted(near - burnt)
                k = min(len(fresh), int(rng.geometric(1 - ratio)) - 1) if ratio < 1 else len(fresh)
                picked = [fresh[i] for i in rng.permutation(len(fresh))[:k]]
                burnt.update(picked)
                front += picked
        for w in sorted(burnt):
            pairs.append((v, w))
            out[v].add(w)
            into[w].add(v)
    return _sequential(spark, n, pairs)


def random_tree(spark: SparkSession, n: int = 20, seed: int = 1) -> Graph:
    """A uniform labelled tree from a random Pruefer sequence."""
    import heapq

    code = np.random.default_rng(seed).integers(0, n, max(0, n - 2)).tolist()
    degree = [1 + code.count(v) for v in range(n)] if n <= 1000 else (1 + np.bincount(code, minlength=n)).tolist()
    leaves = [v for v in range(n) if degree[v] == 1]
    heapq.heapify(leaves)
    pairs = []
    for v in code:
        pairs.append((heapq.heappop(leaves), v))
        degree[v] -= 1
        if degree[v] == 1:
            heapq.heappush(leaves, v)
    if n > 1:
        pairs.append((heapq.heappop(leaves), heapq.heappop(leaves)))
    return _sequential(spark, n, pairs)


def degree_sequence(spark: SparkSession, degrees: list[int] | None = None, seed: int = 1) -> Graph:
    """Configuration model: stubs in random order, paired by neighbours; loops and repeats may occur."""
    degrees = degrees or [4] * 20
    if sum(degrees) % 2:
        raise ValueError("the sum of degrees must be even")
    v = spark.createDataFrame(list(enumerate(degrees)), "id long, degree int").where("degree > 0")
    stubs = v.select("id", F.explode(F.sequence(F.lit(1), F.col("degree"))).alias("k"))
    from ..plans.ordering import dense_ids

    placed = dense_ids(stubs.select("id", (F.expr(uniform("id", "k", seed)) * 1e6 + F.col("id") * 1e-3 + F.col("k") * 1e-6).alias("o")), "o", "place")
    pair = placed.groupBy(F.floor(F.col("place") / 2).alias("eid")).agg(F.min_by("id", "place").alias("src"), F.max_by("id", "place").alias("dst"))
    return _graph(spark, len(degrees), pair.select("src", "dst"))


def bipartite_gnm(spark: SparkSession, n1: int = 8, n2: int = 6, m: int = 15, seed: int = 1) -> Graph:
    """m distinct random edges between vertices 0..n1-1 and n1..n1+n2-1."""
    pairs = spark.range(n1).select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(n1).cast("long"), F.lit(n1 + n2 - 1).cast("long"))).alias("dst"))
    return _graph(spark, n1 + n2, pairs.orderBy(F.expr(uniform("src", "dst", seed)), "src", "dst").limit(m))


def bipartite_projection(graph: Graph, types: DataFrame | None = None) -> Graph:
    """The graph of false-type vertices that share a true-type neighbour, with the number of those as multiplicity.

    types: (id, type); found by two-colouring when absent.  Raises ValueError if there is none.
    """
    from .structure import bipartite_types, is_bipartite

    if types is None:
        if not is_bipartite(graph).first()["bipartite"]:
            raise ValueError("the graph is not bipartite")
        types = bipartite_types(graph)
    false = types.where("not type").select("id")
    into = graph.both().select("u", "v").join(false.withColumnRenamed("id", "v"), "v", "left_semi").distinct()
    pairs = into.select("u", F.col("v").alias("src")).join(into.select("u", F.col("v").alias("dst")), "u").where("src < dst")
    return Graph(false, pairs.groupBy("src", "dst").agg(F.count("*").alias("multiplicity")))


def random_points(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    return spark.range(n).select("id", F.expr(uniform("id", "1", seed)).alias("x"), F.expr(uniform("id", "2", seed)).alias("y"))


def nearest_neighbours(points: DataFrame, cutoff: float) -> Graph:
    """Edges between points (id, x, y) at most `cutoff` apart: equal grid cells of that size are joined, one side spread over its neighbours."""
    cell = lambda c: F.floor(F.col(c) / cutoff).cast("long")
    p = points.select("id", "x", "y", cell("x").alias("cx"), cell("y").alias("cy"))
    near = F.array(*(F.struct((F.col("cx") + i).alias("cx"), (F.col("cy") + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    a = p.select(F.col("id").alias("src"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.explode(near).alias("c")).select("src", "ax", "ay", "c.cx", "c.cy")
    b = p.select(F.col("id").alias("dst"), F.col("x").alias("bx"), F.col("y").alias("by"), "cx", "cy")
    d2 = (F.col("ax") - F.col("bx")) ** 2 + (F.col("ay") - F.col("by")) ** 2
    return Graph(points, a.join(b, ["cx", "cy"]).where((F.col("src") < F.col("dst")) & (d2 <= cutoff * cutoff)).select("src", "dst"))


def geometric(spark: SparkSession, n: int = 25, cutoff: float = 0.2, seed: int = 1) -> Graph:
    return nearest_neighbours(random_points(spark, n, seed), cutoff)


def gabriel_graph(points: DataFrame, limit: int = 20_000) -> Graph:
    """Edges ab such that no third point lies strictly inside the circle with diameter ab (Gabriel and Sokal 1969).

    Every task tests its own points against all, broadcast once their number is checked
    against `limit`.  A point c inside the circle of ab sees it under an obtuse angle.
    """
    import pandas as pd

    n = points.count()
    if n > limit:
        raise ValueError(f"{n} points are more than limit={limit}")
    rows = points.select("id", "x", "y").orderBy("id").collect()
    held = points.sparkSession.sparkContext.broadcast((np.array([r["id"] for r in rows], np.int64), np.array([(r["x"], r["y"]) for r in rows], float)))

    def run(batches):
        ids, xy = held.value
        for pdf in batches:
            src, dst = [], []
            for i, x, y in pdf[["id", "x", "y"]].itertuples(index=False):
                d = xy - (x, y)
                own = np.flatnonzero(ids == i)
                order = np.argsort((d * d).sum(1), kind="stable")
                for j in order[np.isin(order, own, invert=True)]:
                    if ids[j] > i:
                        # (a - c) . (b - c) < 0 for some third c
                        inside = ((-d) * (xy[j] - xy)).sum(1) < -1e-15
                        inside[[j, *own]] = False
                        if not inside.any():
                            src.append(i)
                            dst.append(int(ids[j]))
            yield pd.DataFrame({"src": pd.Series(src, dtype="int64"), "dst": pd.Series(dst, dtype="int64")})

    return Graph(points, points.select("id", "x", "y").mapInPandas(run, "src long, dst long"))


def gabriel(spark: SparkSession, n: int = 20, seed: int = 1) -> Graph:
    return gabriel_graph(random_points(spark, n, seed))


def apply_new_graph(graph: Graph) -> Graph:
    """What follows a generator: empty graphs are refused, the rest is laid out on a sphere."""
    from .layout_geometric import sphere

    n = graph.vertices.count()
    if not n:
        raise ValueError("the graph has no vertices")
    return graph.with_vertices(sphere(graph.vertices.select("id"), n))
