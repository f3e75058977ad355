"""Components, cores, filters and whole-graph structure."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.random import uniform
from ..graph import Graph
from ..plans.fixpoint import differs, iterate
from ..plans.storage import cut, drop

#: Edges of one component that a depth-first search takes in one task: some 400 bytes each in Python, 2 GB.
SEARCH_EDGES = 5_000_000


def degree(graph: Graph) -> DataFrame:
    """(id, degree): edges at either end, a loop counts twice."""
    d = graph.both().groupBy("u").agg(F.count("*").alias("c"))
    return graph.vertices.select("id").join(d.withColumnRenamed("u", "id"), "id", "left").select("id", F.coalesce("c", F.lit(0)).alias("degree"))


def neighbors(graph: Graph) -> DataFrame:
    """(id, neighbors): sorted, loops left out, repeats kept."""
    n = graph.both().where("u <> v").groupBy(F.col("u").alias("id")).agg(F.sort_array(F.collect_list("v")).alias("neighbors"))
    return graph.vertices.select("id").join(n, "id", "left").select("id", F.coalesce("neighbors", F.array().cast("array<long>")).alias("neighbors"))


def connected_components(graph: Graph) -> DataFrame:
    """(id, component): the smallest id of each weakly connected component.

    Alternating large-star and small-star steps (Kiveris et al. 2014): minima per
    vertex are combined before each shuffle, and rounds grow with the logarithm of the
    diameter.
    """
    e = cut(graph.edges.select(F.col("src").cast("long").alias("u"), F.col("dst").cast("long").alias("v")).where("u <> v"))
    seen = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        star = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        new = large.join(down, "u").select(F.explode(star).alias("e")).select("e.*").where("u <> v").distinct()
        said = Observation()
        new = cut(new.observe(said, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")))
        got = (said.get["n"], said.get["h"])
        drop(e)
        e = new
        if got == seen:
            break
        seen = got
    root = e.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))
    return graph.vertices.select("id").join(root, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def coreness(graph: Graph, rounds: int = 1000) -> DataFrame:
    """(id, coreness), mode all: the h-index fixpoint of Montresor et al. (2013).

    Neighbours are counted by estimate before they are ranked, so a hub's window holds
    one row for each distinct estimate.  Raises RuntimeError if not settled after `rounds`.
    """
    near = cut(graph.both().where("u <> v").select("u", "v").distinct())
    start = near.groupBy(F.col("u").alias("id")).agg(F.count("*").cast("long").alias("est"))

    def step(s: DataFrame) -> DataFrame:
        j = near.join(s.select(F.col("id").alias("v"), "est"), "v")
        counts = j.groupBy("u", "est").agg(F.count("*").alias("c"))
        reach = F.sum("c").over(Window.partitionBy("u").orderBy(F.desc("est")))
        return counts.select("u", "est", reach.alias("r")).groupBy(F.col("u").alias("id")).agg(F.max(F.least("est", "r")).cast("long").alias("est"))

    done = iterate(start, step, rounds, differs("id", "est"), every=3, settle=True)
    return graph.vertices.select("id").join(done, "id", "left").select("id", F.coalesce("est", F.lit(0)).alias("coreness"))


def _keep(graph: Graph, scores: DataFrame, column: str, k: int) -> Graph:
    return graph.induced(scores.where(F.col(column) >= k)).simplify().relabel()


def filter_degree(graph: Graph, k: int) -> Graph:
    """Vertices of degree >= k, once; survivors may end below k.  Ids become dense in old order (old_id), laid out on a grid."""
    from .layout_geometric import grid_3d, sync_positions

    g = _keep(graph, degree(graph), "degree", k)
    return sync_positions(g, grid_3d(g.vertices.select("id")))


def filter_coreness(graph: Graph, k: int) -> Graph:
    """The k-core; glow is coreness in it over its maximum, 0.5 where that is 0."""
    from .layout_geometric import grid_3d, sync_positions

    g = _keep(graph, coreness(graph), "coreness", k)
    core = coreness(g)
    top = core.agg(F.max("coreness").alias("top"))
    glow = F.when(F.col("top") > 0, F.col("coreness") / F.col("top")).otherwise(0.5)
    v = g.vertices.join(core, "id").crossJoin(F.broadcast(top)).withColumn("glow", glow).drop("top")
    return sync_positions(g.with_vertices(v), grid_3d(v.select("id")))


def hops_from(graph: Graph, sources: DataFrame, mode: str = "all", most: int = 1_000_000) -> DataFrame:
    """(source, id, hops) reached from sources (source, id): one frontier join per level."""
    arcs = cut(graph.arcs(mode).select("u", "v").distinct())
    seen = cut(sources.select("source", "id", F.lit(0).alias("hops")))
    front = seen
    for k in range(most):
        new = front.join(arcs, front["id"] == arcs["u"]).select("source", F.col("v").alias("id")).distinct()
        new = cut(new.join(seen.select("source", "id"), ["source", "id"], "left_anti").select("source", "id", F.lit(k + 1).alias("hops")))
        if new.isEmpty():
            break
        grown = cut(seen.union(new))
        drop(seen)
        seen, front = grown, new
    return seen


def bipartite_types(graph: Graph) -> DataFrame:
    """(id, type): parity of the distance from the smallest id of the component; false there."""
    comp = connected_components(graph)
    roots = comp.where("id = component").select(F.col("id").alias("source"), "id")
    return hops_from(graph, roots).select("id", (F.col("hops") % 2 == 1).alias("type"))


def is_bipartite(graph: Graph) -> DataFrame:
    """One row: bipartite."""
    t = cut(bipartite_types(graph))
    a, b = (t.select(F.col("id").alias(k), F.col("type").alias(f"t{k}")) for k in ("src", "dst"))
    bad = graph.edges.join(a, "src").join(b, "dst").where("tsrc = tdst")
    return bad.agg((F.count("*") == 0).alias("bipartite"))


def _lowpoints(pdf: pd.DataFrame) -> pd.DataFrame:
    """Cut vertices and bridges of one component, depth first without recursion (Tarjan 1972)."""
    ends = pdf[["src", "dst"]].to_numpy()
    ids, flat = np.unique(ends, return_inverse=True)
    flat = flat.reshape(-1, 2)
    adj: list[list[tuple[int, int]]] = [[] for _ in ids]
    for e, (a, b) in enumerate(flat.tolist()):
        adj[a].append((b, e))
        adj[b].append((a, e))
    order, low = [-1] * len(ids), [0] * len(ids)
    cuts, bridges, clock = set(), [], 0
    for root in range(len(ids)):
        if order[root] >= 0:
            continue
        order[root] = low[root] = clock
        clock += 1
        stack, kids = [(root, -1, iter(adj[root]))], 0
        while stack:
            v, via, it = stack[-1]
            for w, e in it:
                if e == via:
                    continue
                if order[w] < 0:
                    order[w] = low[w] = clock
                    clock += 1
                    stack.append((w, e, iter(adj[w])))
                    break
                low[v] = min(low[v], order[w])
            else:
                stack.pop()
                if stack:
                    p = stack[-1][0]
                    low[p] = min(low[p], low[v])
                    if low[v] > order[p]:
                        bridges.append(via)
                    if p == root:
                        kids += 1
                    elif low[v] >= order[p]:
                        cuts.add(p)
        if kids > 1:
            cuts.add(root)
    out = [("cut", int(ids[v]), None) for v in sorted(cuts)] + [("bridge", int(min(pdf.src.iloc[e], pdf.dst.iloc[e])), int(max(pdf.src.iloc[e], pdf.dst.iloc[e]))) for e in bridges]
    return pd.DataFrame({"kind": pd.Series([o[0] for o in out], dtype=object), "a": pd.Series([o[1] for o in out], dtype="int64"), "b": pd.Series([o[2] for o in out], dtype="Int64")})


def _cut_parts(graph: Graph) -> DataFrame:
    """Depth-first search needs a component at once, so each runs in one task, of at most SEARCH_EDGES edges."""
    g = graph.undirected()
    named = cut(g.edges.join(connected_components(g).withColumnRenamed("id", "src"), "src"))
    most = named.groupBy("component").agg(F.count("*").alias("m")).agg(F.max("m")).first()[0] or 0
    if most > SEARCH_EDGES:
        raise ValueError(f"a component of {most} edges; depth-first search takes {SEARCH_EDGES}")
    return named.groupBy("component").applyInPandas(_lowpoints, "kind string, a long, b long")


def articulation_points(graph: Graph) -> DataFrame:
    return _cut_parts(graph).where("kind = 'cut'").select(F.col("a").alias("id"))


def bridges(graph: Graph) -> DataFrame:
    return _cut_parts(graph).where("kind = 'bridge'").select(F.col("a").alias("src"), F.col("b").alias("dst"))


def highlight(graph: Graph) -> DataFrame:
    """(id, glow, r, g, b) of cut vertices, and of the ends of bridges, which override."""
    parts = cut(_cut_parts(graph))
    ends = parts.where("kind = 'bridge'").select(F.explode(F.array("a", "b")).alias("id")).distinct().select("id", F.lit(1).alias("k"))
    marks = parts.where("kind = 'cut'").select(F.col("a").alias("id"), F.lit(0).alias("k")).union(ends).groupBy("id").agg(F.max("k").alias("k"))
    return marks.select("id", F.lit(1.0).alias("glow"), F.lit(1.0).alias("r"), F.when(F.col("k") == 1, 0.5).otherwise(0.2).alias("g"), F.when(F.col("k") == 1, 0.0).otherwise(0.2).alias("b"))


def density(graph: Graph) -> DataFrame:
    """One row: edges over possible edges without loops; null below two vertices."""
    s = graph.summary()
    pairs = F.col("node_count") * (F.col("node_count") - 1) / (1.0 if graph.directed else 2.0)
    return s.select(F.try_divide(F.col("edge_count").cast("double"), pairs).alias("density"))


def triangles(graph: Graph) -> DataFrame:
    """(a, b, c) once each: edges run from lower to higher degree, so hubs start few wedges."""
    g = graph.undirected()
    d = g.both().groupBy("u").agg(F.count("*").alias("d"))
    e = g.edges.join(d.select(F.col("u").alias("src"), F.col("d").alias("ds")), "src").join(d.select(F.col("u").alias("dst"), F.col("d").alias("dd")), "dst")
    up = (F.col("ds") < F.col("dd")) | ((F.col("ds") == F.col("dd")) & (F.col("src") < F.col("dst")))
    o = cut(e.select(F.when(up, F.col("src")).otherwise(F.col("dst")).alias("p"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("q")))
    x, y = o.select("p", F.col("q").alias("q1")), o.select("p", F.col("q").alias("q2"))
    wedge = x.join(y, "p").where("q1 < q2")
    closing = o.select(F.least("p", "q").alias("q1"), F.greatest("p", "q").alias("q2"))
    return wedge.join(closing, ["q1", "q2"]).select(F.col("p").alias("a"), F.col("q1").alias("b"), F.col("q2").alias("c"))


def _wedges(graph: Graph) -> DataFrame:
    d = graph.undirected().both().groupBy("u").agg(F.count("*").alias("d"))
    return d.select(F.col("u").alias("id"), "d", (F.col("d") * (F.col("d") - 1) / 2).alias("wedges"))


def transitivity(graph: Graph) -> DataFrame:
    """One row: 3 triangles / connected triples; NaN without triples."""
    t = triangles(graph).agg(F.count("*").alias("t"))
    w = _wedges(graph).agg(F.sum("wedges").alias("w"))
    return t.crossJoin(w).select(F.when(F.coalesce("w", F.lit(0.0)) > 0, 3.0 * F.col("t") / F.col("w")).otherwise(F.lit(float("nan"))).alias("transitivity"))


def local_transitivity(graph: Graph) -> DataFrame:
    """(id, transitivity): linked pairs of neighbours over all; 0 below two neighbours."""
    t = triangles(graph).select(F.explode(F.array("a", "b", "c")).alias("id")).groupBy("id").agg(F.count("*").alias("t"))
    j = graph.vertices.select("id").join(_wedges(graph), "id", "left").join(t, "id", "left")
    return j.select("id", F.when(F.coalesce("wedges", F.lit(0.0)) > 0, F.coalesce("t", F.lit(0)) / F.col("wedges")).otherwise(0.0).alias("transitivity"))


def assortativity(graph: Graph) -> DataFrame:
    """One row: the correlation of degrees at the ends of edges (out with in when directed; Newman 2002)."""
    if graph.directed:
        out = graph.edges.groupBy("src").agg(F.count("*").alias("a"))
        into = graph.edges.groupBy("dst").agg(F.count("*").alias("b"))
        j = graph.edges.select("src", "dst").join(out, "src").join(into, "dst")
    else:
        d = degree(graph)
        j = graph.both().select("u", "v").join(d.select(F.col("id").alias("u"), F.col("degree").alias("a")), "u").join(d.select(F.col("id").alias("v"), F.col("degree").alias("b")), "v")
    return j.agg(F.corr(F.col("a").cast("double"), F.col("b").cast("double")).alias("assortativity"))


def kmeans_hubs(graph: Graph, k: int = 8, rounds: int = 10, start: DataFrame | None = None, seed: int = 1) -> DataFrame:
    """(hub, x, y, z): Lloyd rounds over edge midpoints; ties go to the lower hub, empty hubs stay.

    start: (hub, x, y, z); by default the midpoints of k random edges.  Hubs are few and broadcast.
    """
    p = graph.vertices.select("id", "x", "y", "z")
    a, b = (p.select(F.col("id").alias(s), *(F.col(c).alias(f"{c}{s}") for c in "xyz")) for s in ("src", "dst"))
    mid = cut(graph.edges.select("src", "dst").join(a, "src").join(b, "dst").select("src", "dst", *(((F.col(f"{c}src") + F.col(f"{c}dst")) / 2).alias(c) for c in "xyz")))
    if start is None:
        rows = mid.orderBy(F.expr(uniform("src", "dst", seed)), "src", "dst").limit(k).collect()
        hubs = [(i, r["x"], r["y"], r["z"]) for i, r in enumerate(rows)]
    else:
        hubs = sorted((r["hub"], r["x"], r["y"], r["z"]) for r in start.collect())
    for _ in range(rounds):
        d2 = [(F.col("x") - x) ** 2 + (F.col("y") - y) ** 2 + (F.col("z") - z) ** 2 for _, x, y, z in hubs]
        nearest = F.array_min(F.array(*(F.struct(d.alias("d"), F.lit(h[0]).alias("hub")) for d, h in zip(d2, hubs))))["hub"]
        got = {r["hub"]: (r["x"], r["y"], r["z"]) for r in mid.groupBy(nearest.alias("hub")).agg(*(F.avg(c).alias(c) for c in "xyz")).collect()}
        hubs = [(h, *got.get(h, (x, y, z))) for h, x, y, z in hubs]
    return graph.vertices.sparkSession.createDataFrame([(int(h), float(x), float(y), float(z)) for h, x, y, z in hubs], "hub long, x double, y double, z double")


def info_card(spark, title: str, pairs: list[tuple[str, float, str]], empty: bool = False) -> DataFrame:
    """(title, key, value, value_num): values formatted by printf patterns; an empty graph has a title only."""
    rows = [(title, None, None, None)] if empty else [(title, k, fmt % v if v is not None else None, float(v) if v is not None else None) for k, v, fmt in pairs]
    return spark.createDataFrame(rows, "title string, key string, value string, value_num double")
