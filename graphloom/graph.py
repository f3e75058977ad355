"""Property graphs as two DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .plans.ordering import dense_ids


@dataclass(frozen=True)
class Graph:
    """vertices (id, ...), edges (src, dst, ...).  Immutable: every operation returns a new graph or table."""

    vertices: DataFrame
    edges: DataFrame
    directed: bool = False

    @classmethod
    def of_edges(cls, edges: DataFrame, directed: bool = False) -> Graph:
        """A graph whose vertices are the ends of its edges."""
        ends = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()
        return cls(ends, edges, directed)

    def with_vertices(self, vertices: DataFrame) -> Graph:
        return replace(self, vertices=vertices)

    def with_edges(self, edges: DataFrame) -> Graph:
        return replace(self, edges=edges)

    def simplify(self, keep_attrs: dict | None = None) -> Graph:
        """No loops, one edge per pair.  keep_attrs: aggregates by column name; other edge attributes go."""
        e = self.edges.where("src <> dst")
        if not self.directed:
            e = e.withColumns({"src": F.least("src", "dst"), "dst": F.greatest("src", "dst")})
        e = e.groupBy("src", "dst").agg(*(f.alias(c) for c, f in keep_attrs.items())) if keep_attrs else e.select("src", "dst").distinct()
        return self.with_edges(e)

    def undirected(self) -> Graph:
        return replace(self, directed=False).simplify()

    def both(self, weight: str | None = None) -> DataFrame:
        """(u, v, w): every edge from both ends; a loop gives two rows."""
        w = F.col(weight) if weight else F.lit(1.0)
        e = self.edges.select("src", "dst", w.cast("double").alias("w"))
        return e.select(F.explode(F.array(F.struct(F.col("src").alias("u"), F.col("dst").alias("v"), "w"), F.struct(F.col("dst").alias("u"), F.col("src").alias("v"), "w"))).alias("x")).select("x.u", "x.v", "x.w")

    def arcs(self, mode: str = "auto", weight: str | None = None) -> DataFrame:
        """(u, v, w) along which paths run.  mode: out, in, all, or auto (out when directed)."""
        if mode == "all" or (mode == "auto" and not self.directed):
            return self.both(weight)
        w = (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w")
        u, v = ("dst", "src") if mode == "in" else ("src", "dst")
        return self.edges.select(F.col(u).alias("u"), F.col(v).alias("v"), w)

    def induced(self, keep: DataFrame) -> Graph:
        """The subgraph on the vertices of keep (id)."""
        k = keep.select("id")
        e = self.edges.join(k.withColumnRenamed("id", "src"), "src", "left_semi").join(k.withColumnRenamed("id", "dst"), "dst", "left_semi")
        return replace(self, vertices=self.vertices.join(k, "id", "left_semi"), edges=e)

    def relabel(self) -> Graph:
        """Dense ids 0, 1, ... in the order of the old ones, which stay as old_id."""
        v = dense_ids(self.vertices.withColumnRenamed("id", "old_id"), "old_id")
        m = v.select("old_id", "id")
        e = self.edges.withColumnsRenamed({"src": "__s", "dst": "__d"})
        e = e.join(m.select(F.col("old_id").alias("__s"), F.col("id").alias("src")), "__s").join(m.select(F.col("old_id").alias("__d"), F.col("id").alias("dst")), "__d")
        return replace(self, vertices=v, edges=e.drop("__s", "__d"))

    def summary(self) -> DataFrame:
        n = self.vertices.agg(F.count("*").alias("node_count"))
        return n.crossJoin(self.edges.agg(F.count("*").alias("edge_count")))  # one row each
