"""Data that a renderer draws: shapes, sizes, segments, routes and glyphs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import Vec, add, dot, length, scale, sub, unit, vec
from ..graph import Graph

#: Degree below which a shape holds, least first.
SHAPES = [(4, "tetrahedron"), (6, "cube"), (8, "octahedron"), (12, "dodecahedron"), (None, "icosahedron")]


def shape_class(degree: Column) -> Column:
    out = F.lit(SHAPES[-1][1])
    for below, name in reversed(SHAPES[:-1]):
        out = F.when(degree < below, name).otherwise(out)
    return out


def shape_groups(degrees: DataFrame) -> DataFrame:
    """(shape, count, first): vertices by shape, with offsets in the order of SHAPES."""
    order = F.create_map(*(F.lit(x) for k, (_, s) in enumerate(SHAPES) for x in (s, k)))
    g = degrees.groupBy(shape_class(F.col("degree")).alias("shape")).agg(F.count("*").alias("count"))
    before = F.sum("count").over(Window.orderBy(order[F.col("shape")]).rowsBetween(Window.unboundedPreceding, -1))  # five rows
    return g.select("shape", "count", F.coalesce(before, F.lit(0)).cast("long").alias("first"))


def ngon_sides(degree: Column) -> Column:
    return F.greatest(F.lit(3), F.least(degree, F.lit(12)))


def node_instance(vertices: DataFrame, layout_scale: float = 1.0) -> DataFrame:
    """(id, x, y, z, size): scaled positions, sizes of at least 0.1."""
    return vertices.select("id", *((F.col(c) * layout_scale).alias(c) for c in "xyz"), F.greatest("size", F.lit(0.1)).alias("size"))


def size_from_attr(df: DataFrame, attr: str | None) -> DataFrame:
    """df with size = attr / max(attr), or 1 where there is no attribute, no value or no positive maximum."""
    if attr is None or attr not in df.columns:
        return df.withColumn("size", F.lit(1.0))
    top = df.agg(F.greatest(F.max(F.col(attr).cast("double")), F.lit(0.0)).alias("__top"))
    v = F.col(attr).cast("double")
    return df.crossJoin(F.broadcast(top)).withColumn("size", F.when((F.col("__top") > 0) & v.isNotNull(), v / F.when(F.col("__top") > 0, F.col("__top")).otherwise(1.0)).otherwise(1.0)).drop("__top")


def edge_segments(graph: Graph, layout_scale: float = 1.0) -> DataFrame:
    """(src, dst, seq, x, y, z, r, g, b, normalized_pos): both ends of straight edges in the colours of their vertices."""
    cols = ["x", "y", "z", "r", "g", "b"]
    p = graph.vertices.select("id", *cols)
    a, b = (p.select(F.col("id").alias(k), F.struct(*cols).alias(s)) for k, s in (("src", "p"), ("dst", "q")))
    j = graph.edges.select("src", "dst").join(a, "src").join(b, "dst")
    ends = j.select("src", "dst", F.posexplode(F.array("p", "q")).alias("seq", "e"))
    return ends.select("src", "dst", "seq", *((F.col(f"e.{c}") * layout_scale).alias(c) for c in "xyz"), *(f"e.{c}" for c in "rgb"), F.col("seq").cast("double").alias("normalized_pos"))


def edge_brightness(color: Column, size: Column) -> Column:
    return color * (0.2 + 0.8 * size)


def _tangent(d: Vec, normal: Vec) -> Vec:
    """The unit part of d across the normal; zero where d runs along it."""
    t = sub(d, scale(normal, dot(d, normal)))
    n = length(t)
    return tuple(F.when(n > 1e-12, c / F.when(n > 1e-12, n).otherwise(1.0)).otherwise(0.0) for c in t)


def edge_route_spherical(graph: Graph, base_radius: float = 1.0, layout_scale: float = 1.0, elevation: Column | None = None) -> DataFrame:
    """(src, dst, seq, x, y, z): eight waypoints along a sphere.

    Ports lie 0.45 and stubs 1.0 of the size out of a vertex towards the other end; between
    the stubs the route climbs to the highway radius, sweeps along longitude, then latitude.
    """
    p = graph.vertices.select("id", *((F.col(c) * layout_scale).alias(c) for c in "xyz"), "size")
    a, b = (p.select(F.col("id").alias(k), *(F.col(c).alias(f"{s}{c}") for c in "xyz"), F.col("size").alias(f"{s}s")) for k, s in (("src", "p"), ("dst", "q")))
    level = (elevation if elevation is not None else F.lit(0)).cast("double")
    j = graph.edges.select("src", "dst", level.alias("level")).join(a, "src").join(b, "dst")
    s, d = vec("p"), vec("q")
    j = j.withColumn("hr", F.when(length(s) < 0.001, base_radius).otherwise(length(s)) + F.when(F.col("level") > 0, F.col("level") * 1.2).otherwise(0.005))
    towards = unit(sub(d, s))
    st, dt = _tangent(towards, unit(s)), _tangent(scale(towards, F.lit(-1.0)), unit(d))
    stub = lambda pos, tang, size, k: add(pos, scale(tang, size * k))
    points = {"sp": stub(s, st, F.col("ps"), 0.45), "ss": stub(s, st, F.col("ps"), 1.0), "ds": stub(d, dt, F.col("qs"), 1.0), "dp": stub(d, dt, F.col("qs"), 0.45)}
    j = j.select("src", "dst", "hr", *(c.alias(f"{n}{k}") for n, v in points.items() for c, k in zip(v, "xyz")))
    sn, dn = unit(vec("ss")), unit(vec("ds"))
    angle = lambda n: (F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), n[1]))), F.atan2(n[2], n[0]))
    (sl, so), (dl, do) = angle(sn), angle(dn)
    on = lambda lat, lon: scale((F.sin(lat) * F.cos(lon), F.cos(lat), F.sin(lat) * F.sin(lon)), F.col("hr"))
    del so
    way = [vec("sp"), vec("ss"), scale(sn, F.col("hr")), on(sl, do), on(dl, do), scale(dn, F.col("hr")), vec("ds"), vec("dp")]
    path = F.array(*(F.struct(*(c.alias(k) for c, k in zip(v, "xyz"))) for v in way))
    return j.select("src", "dst", F.posexplode(path).alias("seq", "p")).select("src", "dst", "seq", "p.x", "p.y", "p.z")


def route_normalized_pos(routed: DataFrame) -> DataFrame:
    """routed with normalized_pos: length so far over the whole length of its edge (0 for a route of no length)."""
    w = Window.partitionBy("src", "dst").orderBy("seq")
    before = tuple(F.lag(c).over(w) for c in "xyz")
    step = F.coalesce(length(sub(vec(), before)), F.lit(0.0))
    r = routed.withColumn("__step", step)
    r = r.withColumn("__far", F.sum("__step").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__all", F.sum("__step").over(Window.partitionBy("src", "dst")))
    return r.withColumn("normalized_pos", F.when(F.col("__all") > 0, F.col("__far") / F.when(F.col("__all") > 0, F.col("__all")).otherwise(1.0)).otherwise(0.0)).drop("__step", "__far", "__all")


def label_glyphs(vertices: DataFrame, advance: float = 0.6) -> DataFrame:
    """(id, place, glyph, dx, dy): a row for each character, side by side above the vertex."""
    chars = vertices.where("label is not null and label <> ''").select("id", "size", F.posexplode(F.regexp_extract_all("label", F.lit("(?s)."), F.lit(0))).alias("place", "glyph"))
    return chars.select("id", "place", "glyph", (F.col("place") * advance).alias("dx"), (0.5 * F.col("size") + 0.3).alias("dy"))


def remove_overlaps(vertices: DataFrame, rounds: int = 1) -> DataFrame:
    """(id, x, y, z, size) after pairs closer than their mean size have pushed each other apart, all at once.

    Cells are as wide as the largest size and 0.1; each vertex meets the 27 cells around it by an
    equi-join.  Pairs at most 0.01 apart stay, as their direction is not defined.
    """
    v = vertices.select("id", "x", "y", "z", "size")
    for _ in range(rounds):
        width = v.agg((F.max("size") + 0.1).alias("w")).first()["w"]
        if width is None:
            return v
        cell = lambda c: F.floor(F.col(c) / width).cast("long")
        own = v.select("*", *(cell(c).alias(f"c{c}") for c in "xyz"))
        around = F.array(*(F.struct(*((F.col(f"c{c}") + o).alias(f"c{c}") for c, o in zip("xyz", (i, j, k)))) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)))
        a = own.select("id", "x", "y", "z", "size", F.explode(around).alias("c")).select("id", "x", "y", "z", "size", "c.*")
        b = own.select(F.col("id").alias("o"), *(F.col(c).alias(f"o{c}") for c in "xyz"), F.col("size").alias("os"), "cx", "cy", "cz")
        d = sub(vec(), vec("o"))
        j = a.join(b, ["cx", "cy", "cz"]).where("id <> o").withColumn("dist", length(d)).withColumn("least", 0.5 * (F.col("size") + F.col("os")))
        push = (F.col("least") - F.col("dist")) / F.col("dist")
        hit = j.where((F.col("dist") < F.col("least")) & (F.col("dist") * F.col("dist") > 1e-4))
        moves = hit.groupBy("id").agg(*(F.sum(c * push).alias(f"m{k}") for c, k in zip(d, "xyz")))
        # each pair is met from both sides, and each meeting moves both by half the overlap
        v = v.join(moves, "id", "left").select("id", *((F.col(k) + F.coalesce(f"m{k}", F.lit(0.0))).alias(k) for k in "xyz"), "size")
    return v


def platonic_mesh(solid: str) -> list[tuple[float, float, float]]:
    """Unit vertices of a regular solid, from its symmetry."""
    signs = [(a, b, c) for a in (-1, 1) for b in (-1, 1) for c in (-1, 1)]
    gold = (1 + math.sqrt(5)) / 2
    turns = lambda a, b: [p for s in (-1, 1) for t in (-1, 1) for p in ((0, s * a, t * b), (s * a, t * b, 0), (t * b, 0, s * a))]
    raw = {
        "tetrahedron": [s for s in signs if s[0] * s[1] * s[2] > 0],
        "cube": signs,
        "octahedron": [tuple(s * (k == j) for k in range(3)) for j in range(3) for s in (-1, 1)],
        "dodecahedron": signs + turns(1 / gold, gold),
        "icosahedron": turns(1, gold),
    }[solid]
    n = math.sqrt(sum(c * c for c in raw[0]))
    return [tuple(c / n for c in p) for p in raw]


def hud_row(graph: Graph, layout: str, clustering: str) -> DataFrame:
    """One status line."""
    return graph.summary().select(F.format_string("Layout: %s | Cluster: %s | Nodes: %d | Edges: %d", F.lit(layout), F.lit(clustering), "node_count", "edge_count").alias("status"))


def records(graph: Graph, node_attr: str | None = None) -> DataFrame:
    """Vertex records: id, label, size, degree (neighbours without loops), coreness."""
    from .structure import coreness, neighbors

    v = size_from_attr(graph.vertices, node_attr)
    label = F.col("label") if "label" in v.columns else F.lit(None).cast("string")
    d = neighbors(graph).select("id", F.size("neighbors").alias("degree"))
    c = coreness(graph).select("id", F.col("coreness").cast("int").alias("coreness"))
    return v.select("id", label.alias("label"), "size").join(d, "id").join(c, "id")
