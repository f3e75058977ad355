"""Layered sphere layout: communities on nested spheres, the densest innermost."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..graph import Graph
from ..plans.storage import cut, drop

GRID = 1 << 15


def community_stats(core: DataFrame, member: DataFrame) -> DataFrame:
    """(community, avg_coreness, size), densest first, ties by number."""
    return core.join(member, "id").groupBy("community").agg(F.avg("coreness").alias("avg_coreness"), F.count("*").alias("size")).orderBy(F.desc("avg_coreness"), "community")


def assign_spheres(stats: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(community, sphere) for (community, size) in order: the first community fills sphere 0; sphere s
    holds base * s^2, base being 15 or 1.5 % of the other vertices, and at least one community."""
    if not stats:
        return []
    nucleus = stats[0][1]
    base = max(15, int(0.015 * (sum(n for _, n in stats) - nucleus)))
    out, sphere, load = [], 0, 0
    for c, n in stats:
        room = nucleus if sphere == 0 else base * sphere * sphere
        if load and load + n > room:
            sphere, load = sphere + 1, 0
        load += n
        out.append((c, sphere))
    return out


def sphere_radii(counts: dict[int, int]) -> dict[int, float]:
    """Radius of each used sphere from its number of vertices."""
    out: dict[int, float] = {}
    last = None
    for s in sorted(counts):
        need = math.sqrt(40.0 * counts[s] / (4 * math.pi))
        last = max(5.0, need) if last is None else max(last + 8 + 20 / math.log2(s + 2), need)
        out[s] = last
    return out


def slot_count(n: int, radius: float) -> int:
    return min(100_000, max(3 * n, int(4 * math.pi * radius * radius / 20)))


def hilbert_index(x: Column, y: Column, side: int = GRID) -> Column:
    """Position on the space-filling curve of the layout, for whole numbers below `side`.

    Quadrants turn by their own size, not by the side of the whole: coordinates may go
    below zero, and two's complement bits are meant.
    """
    x, y, d = x.cast("int"), y.cast("int"), F.lit(0)
    s = side // 2
    # an array carries the three numbers from round to round, so the expression stays linear in the rounds
    state = F.array(x, y, d)
    sizes = []
    while s:
        sizes.append(s)
        s //= 2

    def one(acc: Column, s: Column) -> Column:
        px, py, pd = F.get(acc, F.lit(0)), F.get(acc, F.lit(1)), F.get(acc, F.lit(2))
        rx = F.when(px.bitwiseAND(s) > 0, 1).otherwise(0)
        ry = F.when(py.bitwiseAND(s) > 0, 1).otherwise(0)
        step = s * s * (3 * rx).bitwiseXOR(ry)
        flip = (ry == 0) & (rx == 1)
        fx, fy = F.when(flip, s - 1 - px).otherwise(px), F.when(flip, s - 1 - py).otherwise(py)
        swap = ry == 0
        return F.array(F.when(swap, fy).otherwise(fx), F.when(swap, fx).otherwise(fy), pd + step)

    return F.get(F.aggregate(F.array(*(F.lit(k) for k in sizes)), state, one), F.lit(2))


def slots(spark, spheres: DataFrame) -> DataFrame:
    """(sphere, slot, x, y, z, h) for spheres (sphere, radius, slots): Fibonacci points in Hilbert order of their angles."""
    p = spheres.select("sphere", "radius", "slots", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("i"))
    phi = F.acos(1 - 2 * (F.col("i") + 0.5) / F.col("slots"))
    theta = math.pi * (1 + math.sqrt(5)) * F.col("i")
    p = p.select("sphere", "i", "radius", phi.alias("phi"), theta.alias("theta"))
    turn = F.col("theta") - 2 * math.pi * F.floor(F.col("theta") / (2 * math.pi))
    gx = F.floor(turn / (2 * math.pi) * (GRID - 1)).cast("int")
    gy = F.floor(F.col("phi") / math.pi * (GRID - 1)).cast("int")
    at = (F.sin("phi") * F.cos("theta"), F.sin("phi") * F.sin("theta"), F.cos("phi"))
    q = p.select("sphere", "i", *((c * F.col("radius")).alias(k) for c, k in zip(at, "xyz")), hilbert_index(gx, gy).alias("h"))
    return q.withColumn("slot", F.row_number().over(Window.partitionBy("sphere").orderBy("h", "i")) - 1).select("sphere", "slot", "x", "y", "z", "h")


def intra_degree(graph: Graph, member: DataFrame) -> DataFrame:
    """(id, intra_degree): neighbours in the own community."""
    a, b = (member.select(F.col("id").alias(k), F.col("community").alias(f"c{k}")) for k in ("u", "v"))
    d = graph.both().select("u", "v").join(a, "u").join(b, "v").where("cu = cv").groupBy(F.col("u").alias("id")).agg(F.count("*").alias("d"))
    return member.select("id").join(d, "id", "left").select("id", F.coalesce("d", F.lit(0)).alias("intra_degree"))


def initial_slots(placed: DataFrame, spheres: DataFrame) -> DataFrame:
    """(id, sphere, slot) for placed (id, sphere, community, intra_degree, transitivity): evenly spaced by
    community, then most links inside it, then least transitivity, then id."""
    w = Window.partitionBy("sphere").orderBy("community", F.desc("intra_degree"), "transitivity", "id")
    n = placed.groupBy("sphere").agg(F.count("*").alias("n"))
    j = placed.withColumn("i", F.row_number().over(w) - 1).join(n, "sphere").join(spheres.select("sphere", "slots"), "sphere")
    return j.select("id", "sphere", F.least(F.col("slots") - 1, F.col("i") * F.floor(F.col("slots") / F.col("n"))).cast("long").alias("slot"))


# Sweeps inside the spheres, then between them, at most.
INTRA, INTER = 52, 102


def layout(graph: Graph, intra_sweeps: int = INTRA, inter_sweeps: int = INTER, seed: int = 1) -> DataFrame:
    """(id, x, y, z, sphere): slots improved by swaps and moves towards the neighbours' mean, all spheres of one parity at a time.

    Either phase ends early when a sweep inside, or two between the spheres, one of each parity, move nothing.
    """
    from .community import detect
    from .structure import coreness, density, local_transitivity

    g = graph.undirected()
    spark = g.vertices.sparkSession
    core = cut(coreness(g))
    share = density(g).first()["density"] or 0.0
    member = cut(detect(g, "leiden", resolution=max(3 * share, 0.001), rounds=2, seed=seed))
    stats = [(r["community"], r["size"]) for r in community_stats(core, member).collect()]
    where = assign_spheres(stats)
    size = dict(stats)
    counts: dict[int, int] = {}
    for c, s in where:
        counts[s] = counts.get(s, 0) + size[c]
    radii = sphere_radii(counts)
    spheres = spark.createDataFrame([(s, r, slot_count(counts[s], r)) for s, r in radii.items()] or [], "sphere int, radius double, slots int")
    of = spark.createDataFrame(where, "community long, sphere int")
    placed = member.join(of, "community").join(intra_degree(g, member), "id").join(local_transitivity(g), "id")
    grid = cut(slots(spark, spheres))
    at = cut(initial_slots(placed, spheres).join(grid, ["sphere", "slot"]))
    near = cut(g.both().groupBy(F.col("u").alias("id")).agg(F.collect_list("v").alias("near")))
    inside, between, still, k = intra_sweeps, inter_sweeps, 0, -1
    while inside or between:
        k, inner = k + 1, inside > 0
        rate = max(0.05, 0.4 * 0.95**k)
        moving = at if inner else at.where(F.col("sphere") % 2 == k % 2)
        pairs = near.select("id", F.explode("near").alias("v")).join(at.select(F.col("id").alias("v"), F.col("sphere").alias("vs"), F.col("x").alias("vx"), F.col("y").alias("vy"), F.col("z").alias("vz")), "v")
        if inner:
            pairs = pairs.join(at.select("id", "sphere"), "id").where("sphere = vs").drop("sphere")
        lists = pairs.groupBy("id").agg(F.collect_list(F.struct("v", "vx", "vy", "vz")).alias("links"))
        new = moving.join(lists, "id", "left").select("sphere", "id", "slot", F.coalesce("links", F.array().cast("array<struct<v:bigint,vx:double,vy:double,vz:double>>")).alias("links"))
        done = new.groupBy("sphere").cogroup(grid.groupBy("sphere")).applyInPandas(_sweep(rate), "id long, sphere int, slot long, x double, y double, z double")
        kept = done if inner else done.union(at.where(F.col("sphere") % 2 != k % 2).select("id", "sphere", "slot", "x", "y", "z"))
        old, at = at, cut(kept.select("sphere", "slot", "id", "x", "y", "z"))
        was = old.select("id", F.col("sphere").alias("s"), F.col("slot").alias("t"))
        still = still + 1 if at.join(was, "id").where("sphere <> s or slot <> t").isEmpty() else 0
        drop(old)
        if inner:
            inside = 0 if still else inside - 1
            still = still if inside else 0
        else:
            between = 0 if still > 1 else between - 1
    return at.select("id", "x", "y", "z", "sphere")


def _sweep(rate: float):
    """One pass over a sphere's vertices: step towards the mean of the neighbours, to the nearest slot; kept when links get shorter."""

    def run(nodes: pd.DataFrame, grid: pd.DataFrame) -> pd.DataFrame:
        grid = grid.sort_values("slot")
        p = grid[["x", "y", "z"]].to_numpy()
        nodes = nodes.sort_values("id")
        ids = nodes["id"].tolist()
        if not len(p) or not ids:
            return pd.DataFrame({"id": [], "sphere": [], "slot": [], "x": [], "y": [], "z": []})
        at = dict(zip(ids, nodes["slot"].astype(int)))
        who = {s: i for i, s in at.items()}
        links = {}
        for i, l in zip(ids, nodes["links"]):
            links[i] = [(r["v"], np.array([r["vx"], r["vy"], r["vz"]])) for r in l]
        spot = lambda v, q: p[at[v]] if v in at else q
        cost = lambda i, s, skip: sum(float(np.linalg.norm(p[s] - spot(v, q))) for v, q in links[i] if v != skip)
        for i in ids:
            if not links[i]:
                continue
            mean = np.mean([spot(v, q) for v, q in links[i]], 0)
            goal = p[at[i]] + rate * (mean - p[at[i]])
            n = np.linalg.norm(goal)
            if n < 1e-9:
                continue
            s = int(((p - goal / n * np.linalg.norm(p[0])) ** 2).sum(1).argmin())
            old, other = at[i], who.get(s)
            if s == old:
                continue
            gain = cost(i, s, other) - cost(i, old, other)
            if other is not None:
                gain += cost(other, old, i) - cost(other, s, i)
            if gain < -0.001:
                at[i], who[s] = s, i
                if other is None:
                    del who[old]
                else:
                    at[other], who[old] = old, other
        k = np.array([at[i] for i in ids])
        return pd.DataFrame({"id": ids, "sphere": int(grid["sphere"].iloc[0]), "slot": k, "x": p[k, 0], "y": p[k, 1], "z": p[k, 2]})

    return run
