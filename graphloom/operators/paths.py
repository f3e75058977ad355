"""Shortest paths by hops."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from .structure import hops_from

#: Adjacency beyond this many arcs is not broadcast; searches then run as frontier joins.
BROADCAST_ARCS = 50_000_000


class Csr:
    """Compressed adjacency: ids sorted, neighbours of vertex k at start[k]:start[k + 1]."""

    def __init__(self, ids: np.ndarray, u: np.ndarray, v: np.ndarray):
        self.ids = ids
        u, v = np.searchsorted(ids, u), np.searchsorted(ids, v)
        order = np.lexsort((v, u))
        self.to = v[order]
        self.start = np.searchsorted(u[order], np.arange(len(ids) + 1))

    def out(self, front: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tail, head) of all arcs that leave the front."""
        n = self.start[front + 1] - self.start[front]
        if not n.sum():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.arange(n.sum()) + np.repeat(self.start[front] - (np.cumsum(n) - n), n)
        return np.repeat(front, n), self.to[at]

    def hops(self, source: int) -> np.ndarray:
        """Hops from a vertex to each, -1 where unreachable."""
        d = np.full(len(self.ids), -1, np.int32)
        d[source] = 0
        front, k = np.array([source]), 0
        while len(front):
            k += 1
            _, head = self.out(front)
            front = np.unique(head[d[head] < 0])
            d[front] = k
        return d

    def hops_of(self, sources: np.ndarray) -> np.ndarray:
        """Hops from each of at most 64 distinct vertices (columns) to each vertex (rows), -1 where unreachable: a bit for each source."""
        d = np.full((len(self.ids), len(sources)), -1, np.int32)
        bit = np.arange(len(sources), dtype=np.uint64)
        front = np.zeros(len(self.ids), np.uint64)
        front[sources] = np.uint64(1) << bit
        d[sources, np.arange(len(sources))] = 0
        seen, k = front.copy(), 0
        while len(at := np.flatnonzero(front)):
            k += 1
            tail, head = self.out(at)
            new = np.zeros_like(front)
            np.bitwise_or.at(new, head, front[tail])
            front = new & ~seen
            seen |= front
            at = np.flatnonzero(front)
            row, column = np.nonzero((front[at, None] >> bit) & np.uint64(1))
            d[at[row], column] = k
        return d


def csr(graph: Graph, mode: str = "auto", limit: int = BROADCAST_ARCS) -> Csr | None:
    """The graph on the driver for broadcast, or None where it has more arcs than `limit`."""
    arcs = graph.arcs(mode).where("u <> v").select("u", "v").distinct()
    if arcs.count() > limit:
        return None
    e = arcs.toPandas()
    ids = np.sort(graph.vertices.select("id").toPandas()["id"].to_numpy(np.int64))
    return Csr(ids, e["u"].to_numpy(np.int64), e["v"].to_numpy(np.int64))


def per_source(graph: Graph, mode: str = "auto", limit: int = BROADCAST_ARCS) -> DataFrame:
    """(id, reached, total, inverse, farthest) over all vertices other than id that it reaches."""
    held = csr(graph, mode, limit)
    if held is None:
        d = hops_from(graph, graph.vertices.select(F.col("id").alias("source"), "id"), mode)
        far = F.col("hops") > 0
        return d.groupBy(F.col("source").alias("id")).agg(F.count(F.when(far, 1)).alias("reached"), F.sum("hops").cast("double").alias("total"), F.coalesce(F.sum(F.when(far, 1.0 / F.col("hops"))), F.lit(0.0)).alias("inverse"), F.max("hops").cast("long").alias("farthest"))
    net = graph.vertices.sparkSession.sparkContext.broadcast(held)

    def run(batches):
        g = net.value
        for pdf in batches:
            out = []
            for i in pdf["id"]:
                d = g.hops(int(np.searchsorted(g.ids, i)))
                d = d[d > 0]
                out.append((i, len(d), float(d.sum()), float((1.0 / d).sum()), int(d.max(initial=0))))
            yield pd.DataFrame(out, columns=["id", "reached", "total", "inverse", "farthest"])

    n = graph.vertices.sparkSession.sparkContext.defaultParallelism * 4
    return graph.vertices.select("id").repartition(n, "id").mapInPandas(run, "id long, reached long, total double, inverse double, farthest long")


def distances(graph: Graph, mode: str = "auto", limit: int = BROADCAST_ARCS) -> DataFrame:
    """(source, id, hops) of all reachable pairs."""
    held = csr(graph, mode, limit)
    if held is None:
        return hops_from(graph, graph.vertices.select(F.col("id").alias("source"), "id"), mode)
    net = graph.vertices.sparkSession.sparkContext.broadcast(held)

    def run(batches):
        g = net.value
        for pdf in batches:
            own = np.sort(pdf["id"].to_numpy(np.int64))
            for a in range(0, len(own), 64):
                source = own[a : a + 64]
                d = g.hops_of(np.searchsorted(g.ids, source))
                # by id, then source: ids come in runs and sources in a short cycle, which Parquet stores small
                for v in range(0, len(d), 1 << 13):
                    row, column = np.nonzero(d[v : v + (1 << 13)] >= 0)
                    yield pd.DataFrame({"source": source[column], "id": g.ids[v + row], "hops": d[v + row, column]})

    n = graph.vertices.sparkSession.sparkContext.defaultParallelism * 4
    return graph.vertices.select("id").repartition(n, "id").mapInPandas(run, "source long, id long, hops int")


def diameter(graph: Graph) -> DataFrame:
    """One row: the longest shortest path without directions; pairs out of reach do not count."""
    return per_source(graph, "all").agg(F.max("farthest").alias("diameter"))


def radius(graph: Graph) -> DataFrame:
    """One row: the least eccentricity, along directions."""
    return per_source(graph, "auto").agg(F.min("farthest").cast("double").alias("radius"))


def average_path_length(graph: Graph) -> DataFrame:
    """One row: mean hops over ordered pairs within reach; null without any."""
    return per_source(graph, "auto").agg(F.try_divide(F.sum("total"), F.sum("reached").cast("double")).alias("average_path_length"))


def closeness(graph: Graph, cutoff: float = -1) -> DataFrame:
    """(id, score): reached / total hops, mode all.  A cutoff of 0 counts no path and gives NaN."""
    s = F.when(F.col("reached") > 0, F.col("reached") / F.col("total")).otherwise(F.lit(float("nan")))
    return per_source(graph, "all").select("id", (s if cutoff != 0 else F.lit(float("nan"))).alias("score"))


def harmonic(graph: Graph) -> DataFrame:
    """(id, score): mean of 1 / hops over all other vertices, mode all; those out of reach add nothing."""
    n = graph.vertices.count()
    return per_source(graph, "all").select("id", (F.col("inverse") / max(1, n - 1)).alias("score"))


def _brandes(g: Csr, source: int) -> tuple[np.ndarray, list]:
    """Dependencies of all vertices on one source (Brandes 2001), level by level."""
    n = len(g.ids)
    d, sigma = np.full(n, -1), np.zeros(n)
    d[source], sigma[source] = 0, 1
    front, levels, k = np.array([source]), [], 0
    while len(front):
        tail, head = g.out(front)
        k += 1
        new = np.unique(head[d[head] < 0])
        d[new] = k
        on = d[head] == k
        tail, head = tail[on], head[on]
        np.add.at(sigma, head, sigma[tail])
        levels.append((tail, head))
        front = new
    delta = np.zeros(n)
    flows = []
    for tail, head in reversed(levels):
        f = sigma[tail] / sigma[head] * (1 + delta[head])
        np.add.at(delta, tail, f)
        flows.append((tail, head, f))
    delta[source] = 0
    return delta, flows


def betweenness(graph: Graph, normalized: bool = True, limit: int = BROADCAST_ARCS) -> DataFrame:
    """(id, score): shortest paths through a vertex.  Sources are dealt over tasks, whose sums of dependencies are added up."""
    held = csr(graph, "auto", limit)
    if held is None:
        raise ValueError(f"more than limit={limit} arcs: the search state does not fit a task")
    net = graph.vertices.sparkSession.sparkContext.broadcast(held)

    def run(batches):
        g = net.value
        total = np.zeros(len(g.ids))
        for pdf in batches:
            for i in pdf["id"]:
                total += _brandes(g, int(np.searchsorted(g.ids, i)))[0]
        yield pd.DataFrame({"id": g.ids, "score": total})

    n = len(held.ids)
    pairs = (n - 1) * (n - 2) / (1 if graph.directed else 2)
    half = 1.0 if graph.directed else 0.5
    parts = graph.vertices.sparkSession.sparkContext.defaultParallelism * 2
    s = graph.vertices.select("id").repartition(parts, "id").mapInPandas(run, "id long, score double").groupBy("id").agg(F.sum("score").alias("score"))
    return s.select("id", (F.col("score") * half / (pairs if normalized and pairs > 0 else 1.0)).alias("score"))
