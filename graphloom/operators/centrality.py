"""Iterative and local vertex scores, and what a score does to a vertex."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..plans.fixpoint import differs, iterate
from ..plans.storage import cut
from .structure import degree as _degree
from .structure import triangles


def degree(graph: Graph) -> DataFrame:
    return _degree(graph).select("id", F.col("degree").cast("double").alias("score"))


def strength(graph: Graph, weight: str | None = None) -> DataFrame:
    """(id, score): the sum of weights at a vertex, loops twice; without weights the degree."""
    s = graph.both(weight).groupBy(F.col("u").alias("id")).agg(F.sum("w").alias("w"))
    return graph.vertices.select("id").join(s, "id", "left").select("id", F.coalesce("w", F.lit(0.0)).alias("score"))


def pagerank(graph: Graph, damping: float = 0.85, rounds: int = 100, tolerance: float = 1e-10) -> DataFrame:
    """(id, score), sum 1; vertices without out-arcs spread evenly."""
    n = graph.vertices.count()
    arcs = graph.arcs().groupBy("u", "v").agg(F.count("*").alias("k"))
    out = graph.arcs().groupBy("u").agg(F.count("*").alias("d"))
    share = cut(arcs.join(out, "u").select("u", "v", (F.col("k") / F.col("d")).alias("p")))
    ids = cut(graph.vertices.select("id").join(out.select(F.col("u").alias("id"), F.lit(True).alias("has")), "id", "left").select("id", F.coalesce("has", F.lit(False)).alias("has")))
    start = ids.select("id", "has", F.lit(1.0 / max(1, n)).alias("score"))
    dangling = not ids.where("not has").isEmpty()

    def step(s: DataFrame) -> DataFrame:
        into = share.join(s.select(F.col("id").alias("u"), "score"), "u").groupBy(F.col("v").alias("id")).agg(F.sum(F.col("p") * F.col("score")).alias("in"))
        j = ids.join(into, "id", "left")
        base = F.lit((1 - damping) / n)
        if dangling:
            lost = s.where("not has").agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("lost"))  # one row
            j = j.crossJoin(F.broadcast(lost))
            base = base + damping * F.col("lost") / n
        return j.select("id", "has", (base + damping * F.coalesce("in", F.lit(0.0))).alias("score"))

    return iterate(start, step, rounds, differs("id", "score", tolerance)).select("id", "score")


def _scaled(s: DataFrame) -> DataFrame:
    top = s.agg(F.max("score").alias("top"))
    return s.crossJoin(F.broadcast(top)).select("id", F.when(F.col("top") > 0, F.col("score") / F.col("top")).otherwise(0.0).alias("score"))


def eigenvector(graph: Graph, rounds: int = 200, tolerance: float = 1e-10, stride: int = 4) -> DataFrame:
    """(id, score), maximum 1, mode all: power iteration on A + I, which also converges on bipartite graphs.

    The product is linear, so scores are scaled once every `stride` products only.
    """
    near = graph.both().groupBy("u", "v").agg(F.sum("w").alias("w"))
    own = graph.vertices.select(F.col("id").alias("u"), F.col("id").alias("v"), F.lit(1.0).alias("w"))
    matrix = cut(near.union(own))

    def step(s: DataFrame) -> DataFrame:
        for _ in range(stride):
            s = matrix.join(s.select(F.col("id").alias("v"), "score"), "v").groupBy(F.col("u").alias("id")).agg(F.sum(F.col("w") * F.col("score")).alias("score"))
        return _scaled(s)

    start = graph.vertices.select("id", F.lit(1.0).alias("score"))
    return iterate(start, step, -(-rounds // stride), differs("id", "score", tolerance), every=1)


def hits(graph: Graph, rounds: int = 100, tolerance: float = 1e-10, stride: int = 2) -> DataFrame:
    """(id, score, authority), maxima 1; score is the hub score.  Undirected graphs have eigenvector centrality in both."""
    if not graph.directed:
        return eigenvector(graph).select("id", "score", F.col("score").alias("authority"))
    arcs = cut(graph.arcs().groupBy("u", "v").agg(F.count("*").cast("double").alias("k")))
    ids = graph.vertices.select("id")

    def half(s: DataFrame, a: str, b: str) -> DataFrame:
        return arcs.join(s.select(F.col("id").alias(a), "score"), a).groupBy(F.col(b).alias("id")).agg(F.sum(F.col("k") * F.col("score")).alias("score"))

    def step(s: DataFrame) -> DataFrame:
        for _ in range(stride):
            s = half(half(s, "u", "v"), "v", "u")
        return _scaled(s)

    whole = lambda s: ids.join(s, "id", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score"))
    hub = iterate(ids.select("id", F.lit(1.0).alias("score")), lambda s: whole(step(s)), -(-rounds // stride), differs("id", "score", tolerance), every=1)
    return hub.join(whole(_scaled(half(hub, "u", "v"))).withColumnRenamed("score", "authority"), "id")


def constraint(graph: Graph) -> DataFrame:
    """(id, score): Burt's constraint, the sum over neighbours j of (p_ij + sum_q p_iq p_qj)^2; null for isolated vertices.

    Ways over q count only where i and j are neighbours, so each lies in a triangle; triangles are listed from their
    vertex of lowest degree, and a hub's wedges never all meet.
    """
    a = cut(graph.both().where("u <> v").groupBy("u", "v").agg(F.sum("w").alias("w")))
    p = cut(a.join(a.groupBy("u").agg(F.sum("w").alias("t")), "u").select("u", "v", (F.col("w") / F.col("t")).alias("p")))
    turns = F.array(*(F.struct(F.col(i).alias("i"), F.col(q).alias("q"), F.col(j).alias("j")) for i, q, j in permutations("abc")))
    ways = triangles(graph).select(F.explode(turns).alias("t")).select("t.*")
    first = p.select(F.col("u").alias("i"), F.col("v").alias("q"), F.col("p").alias("p1"))
    second = p.select(F.col("u").alias("q"), F.col("v").alias("j"), F.col("p").alias("p2"))
    by_way = ways.join(first, ["i", "q"]).join(second, ["q", "j"]).groupBy("i", "j").agg(F.sum(F.col("p1") * F.col("p2")).alias("way"))
    direct = p.select(F.col("u").alias("i"), F.col("v").alias("j"), "p")
    c = direct.join(by_way, ["i", "j"], "left").groupBy(F.col("i").alias("id")).agg(F.sum((F.col("p") + F.coalesce("way", F.lit(0.0))) ** 2).alias("score"))
    return graph.vertices.select("id").join(c, "id", "left")


def apply_centrality(scores: DataFrame) -> DataFrame:
    """(id, score, size, glow): glow is the min-max share, size 0.5 to 2; all alike (or NaN) gives 1."""
    lim = scores.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    span = F.col("hi") - F.col("lo")
    glow = F.when(~F.isnan(span) & (span > 0), (F.col("score") - F.col("lo")) / span).otherwise(1.0)
    return scores.crossJoin(F.broadcast(lim)).select("id", "score", (0.5 + 1.5 * glow).alias("size"), glow.alias("glow"))
