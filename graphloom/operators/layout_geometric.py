"""Layouts with a closed form: (id, x, y, z) for dense ids 0..n-1; n is counted when not given."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.random import uniform
from ..graph import Graph
from ..plans.ordering import running_sum


def _n(vertices: DataFrame, n: int | None) -> int:
    return vertices.count() if n is None else n


def _xyz(vertices: DataFrame, x: Column, y: Column, z: Column | float = 0.0) -> DataFrame:
    z = F.lit(z) if isinstance(z, float) else z
    return vertices.select("id", *(c.cast("double").alias(k) for c, k in zip((x, y, z), "xyz")))


def circle(vertices: DataFrame, n: int | None = None) -> DataFrame:
    """Around the unit circle in the order of ids."""
    a = F.col("id") * (2 * math.pi / max(1, _n(vertices, n)))
    return _xyz(vertices, F.cos(a), F.sin(a))


def star(vertices: DataFrame, n: int | None = None, center: int = 0) -> DataFrame:
    """The center at the origin, the others around it in the order of ids."""
    m = max(1, _n(vertices, n) - 1)
    k = F.when(F.col("id") > center, F.col("id") - 1).otherwise(F.col("id"))
    a = k * (2 * math.pi / m)
    here = F.col("id") == center
    return _xyz(vertices, F.when(here, 0.0).otherwise(F.cos(a)), F.when(here, 0.0).otherwise(F.sin(a)))


def grid(vertices: DataFrame, n: int | None = None, width: int = 0) -> DataFrame:
    w = width or max(1, math.ceil(math.sqrt(_n(vertices, n))))
    return _xyz(vertices, F.col("id") % w, F.floor(F.col("id") / w))


def grid_3d(vertices: DataFrame, n: int | None = None) -> DataFrame:
    w = max(1, math.ceil(round(_n(vertices, n) ** (1 / 3), 9)))
    return _xyz(vertices, F.col("id") % w, F.floor(F.col("id") / w) % w, F.floor(F.col("id") / (w * w)))


def sphere(vertices: DataFrame, n: int | None = None) -> DataFrame:
    """A spiral of even spacing from pole to pole (Saff and Kuijlaars 1997)."""
    n = _n(vertices, n)
    z = F.lit(-1.0) + F.col("id") * 2.0 / max(1, n - 1)
    inner = (F.col("id") > 0) & (F.col("id") < n - 1)
    step = F.when(inner, 3.6 / F.sqrt(n * F.greatest(F.lit(1e-300), 1 - z * z))).otherwise(0.0)
    v = running_sum(vertices.select("id"), step, "phi")
    r = F.sqrt(F.greatest(F.lit(0.0), 1 - z * z))
    phi = F.when(inner, F.col("phi")).otherwise(0.0)
    return _xyz(v, r * F.cos(phi), r * F.sin(phi), z if n > 1 else F.lit(-1.0))


def random_3d(vertices: DataFrame, seed: int = 1) -> DataFrame:
    u = lambda k: F.expr(uniform("id", str(k), seed)) * 2 - 1
    return _xyz(vertices, u(1), u(2), u(3))


def random_2d(vertices: DataFrame, seed: int = 1) -> DataFrame:
    u = lambda k: F.expr(uniform("id", str(k), seed)) * 2 - 1
    return _xyz(vertices, u(1), u(2))


def sync_positions(graph: Graph, layout: DataFrame) -> Graph:
    """Vertices with the positions of a layout; two-dimensional ones lie at z = 0, vertices that it lacks at the origin."""
    z = F.coalesce("__z", F.lit(0.0)) if "z" in layout.columns else F.lit(0.0)
    at = layout.select(F.col("id").alias("__id"), *(F.col(c).alias(f"__{c}") for c in "xyz" if c in layout.columns))
    v = graph.vertices.drop("x", "y", "z").join(at, F.col("id") == F.col("__id"), "left")
    return graph.with_vertices(v.withColumns({"x": F.coalesce("__x", F.lit(0.0)), "y": F.coalesce("__y", F.lit(0.0)), "z": z}).drop("__id", "__x", "__y", "__z"))


def bounds(layout: DataFrame) -> DataFrame:
    """One row: least and greatest x, y and z."""
    return layout.agg(*(f(c).alias(f"{k}_{c}") for c in "xyz" for k, f in (("min", F.min), ("max", F.max))))


def center_unit(layout: DataFrame) -> DataFrame:
    """The layout moved to its centroid and scaled to a greatest distance of 1, unless that is 1e-6 at most."""
    c = layout.agg(*(F.avg(k).alias(f"c{k}") for k in "xyz"))  # one row
    moved = layout.crossJoin(F.broadcast(c)).select("id", *((F.col(k) - F.col(f"c{k}")).alias(k) for k in "xyz"))
    far = moved.agg(F.max(F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)).alias("far"))
    s = F.when(F.col("far") > 1e-6, F.col("far")).otherwise(1.0)
    return moved.crossJoin(F.broadcast(far)).select("id", *((F.col(k) / s).alias(k) for k in "xyz"))
