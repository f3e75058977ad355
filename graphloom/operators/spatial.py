"""Picking, rays, camera frames and animated edges as closed forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import Vec, add, clamp, cross, dot, length, lit3, scale, sub, unit, vec
from ..graph import Graph


def ray_sphere(origin: Vec, direction: Vec, center: Vec, radius: Column) -> Column:
    """Distance along a unit direction to the nearer hit of a sphere; null for a miss."""
    oc = sub(origin, center)
    b = dot(oc, direction)
    h = b * b - (dot(oc, oc) - radius * radius)
    return F.when(h >= 0, -b - F.sqrt(F.greatest(h, F.lit(0.0))))


def ray_segment(origin: Vec, direction: Vec, p1: Vec, p2: Vec) -> tuple[Column, Column]:
    """(distance, t) between a ray and a segment; t belongs to the unclamped line, as parallels take the segment's start."""
    u, v, w = sub(p2, p1), direction, sub(p1, origin)
    a, b, c, d, e = dot(u, u), dot(u, v), dot(v, v), dot(u, w), dot(v, w)
    det = a * c - b * b
    flat = det < 1e-6
    safe = F.when(flat, F.lit(1.0)).otherwise(det)
    s = clamp(F.when(flat, 0.0).otherwise((b * e - c * d) / safe), 0.0, 1.0)
    t = F.when(flat, F.when(b > c, F.try_divide(d, b)).otherwise(F.try_divide(e, c))).otherwise((a * e - b * d) / safe)
    return length(sub(add(p1, scale(u, s)), add(origin, scale(v, t)))), t


def ray_quad(origin: Vec, direction: Vec, center: Vec, right: Vec, up: Vec, width: Column, height: Column) -> Column:
    """Distance along the ray to a rectangle spanned by unit vectors right and up; null for a miss."""
    normal = cross(right, up)
    slope = dot(direction, normal)
    t = F.try_divide(dot(sub(center, origin), normal), F.when(F.abs(slope) > 1e-6, slope))
    off = sub(add(origin, scale(direction, t)), center)
    return F.when((t > 0) & (F.abs(dot(off, right)) <= width / 2) & (F.abs(dot(off, up)) <= height / 2), t)


def _ends(graph: Graph, columns: str = "xyz") -> DataFrame:
    """Edges with the positions of both ends as x1.. and x2.."""
    p = graph.vertices.select("id", *columns)
    a, b = (p.select(F.col("id").alias(k), *(F.col(c).alias(f"{c}{s}") for c in columns)) for k, s in (("src", 1), ("dst", 2)))
    return graph.edges.join(a, "src").join(b, "dst")


def _at(df_prefix: str) -> Vec:
    return tuple(F.col(f"{c}{df_prefix}") for c in "xyz")


def pick_object(graph: Graph, origin=(0, 0, 50), direction=(0, 0, -1), layout_scale: float = 1.0, reach: float = 0.2) -> DataFrame:
    """One row (kind, id, src, dst, t) of what a ray meets first, or none.  Spheres have radius size / 2; of equal t nodes come before edges, then lower ids."""
    o, d = lit3(origin), lit3(direction)
    t = ray_sphere(o, d, scale(vec(), layout_scale), F.col("size") * 0.5)
    empty = F.lit(None).cast("long")
    nodes = graph.vertices.select(F.lit(0).alias("kind"), F.col("id").cast("long").alias("id"), empty.alias("src"), empty.alias("dst"), t.alias("t")).where("t > 0")
    dist, te = ray_segment(o, d, scale(_at("1"), layout_scale), scale(_at("2"), layout_scale))
    edges = _ends(graph).select(F.lit(1).alias("kind"), empty.alias("id"), "src", "dst", te.alias("t"), dist.alias("dist")).where((F.col("dist") < reach) & (F.col("t") > 0)).drop("dist")
    first = F.min(F.struct("t", "kind", F.coalesce("id", "src").alias("a"), F.coalesce("dst", F.lit(0)).alias("b"), "id", "src", "dst")).alias("m")
    got = nodes.union(edges).agg(first).where("m is not null")
    return got.select(F.when(F.col("m.kind") == 0, "node").otherwise("edge").alias("kind"), "m.id", "m.src", "m.dst", "m.t")


def incident_edges(graph: Graph, node: int) -> DataFrame:
    """(src, dst, direction): 1 for edges that leave the node, -1 for those that reach it."""
    hit = (F.col("src") == node) | (F.col("dst") == node)
    return graph.edges.where(hit).select("src", "dst", F.when(F.col("src") == node, 1).otherwise(-1).alias("direction"))


def spatial_basis(front: Vec, world_up: Vec | None = None) -> tuple[Vec, Vec, Vec]:
    """(front, right, up), orthonormal."""
    f = unit(front)
    r = unit(cross(f, world_up or lit3((0, 1, 0))))
    return f, r, cross(r, f)


def resolve_position(origin: Vec, basis: tuple[Vec, Vec, Vec], offset: Vec) -> Vec:
    """origin moved by offset = (right, up, front) along the basis."""
    f, r, u = basis
    return add(origin, add(scale(r, offset[0]), add(scale(u, offset[1]), scale(f, offset[2]))))


def animate_step(graph: Graph, dt: float, speed: float = 4.2) -> DataFrame:
    """Edges (.., progress, direction) after dt seconds at `speed` units of length a second, turning round at both ends."""
    n = length(sub(_at("2"), _at("1")))
    moved = F.col("progress") + F.col("direction") * F.when(n > 1e-4, speed / F.when(n > 1e-4, n).otherwise(1.0)).otherwise(speed) * dt
    e = _ends(graph).withColumn("__p", moved)
    turn = F.when(F.col("__p") < 0, 1).when(F.col("__p") > 1, -1).otherwise(F.col("direction"))
    return e.select("src", "dst", clamp(F.col("__p"), 0.0, 1.0).alias("progress"), turn.cast("int").alias("direction"))
