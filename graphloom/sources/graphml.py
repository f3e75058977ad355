"""GraphML in and out."""

from __future__ import annotations

from xml.sax.saxutils import quoteattr

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph
from ..operators.style import size_from_attr
from ..plans.ordering import dense_ids

#: Columns of ours: attributes of these names are read as attr_<name>, and not written.
OWN = {"id", "src", "dst", "xml_id"}
DATA = "data array<struct<_key:string,_VALUE:string>>"
SCHEMAS = {
    "key": "_id string, _for string, `_attr.name` string, `_attr.type` string",
    "graph": "_id string, _edgedefault string",
    "node": f"_id string, {DATA}",
    "edge": f"_id string, _source string, _target string, {DATA}",
}
TYPES = {"int": "int", "long": "long", "float": "double", "double": "double", "boolean": "boolean"}


def _scan(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """One pass over the elements of a kind; schemas are fixed, as inference varies with the file."""
    found = {"key": "_id", "graph": "_edgedefault", "node": "_id", "edge": "_source"}[tag]  # files without the element give empty rows
    return spark.read.format("xml").option("rowTag", tag).option("recursiveFileLookup", "true").schema(SCHEMAS[tag]).load(path).where(F.col(found).isNotNull())


def _attributes(df: DataFrame, keys: list, kind: str) -> DataFrame:
    """df with a typed column for each declared key."""
    value = F.map_from_entries(F.transform(F.coalesce("data", F.array().cast("array<struct<_key:string,_VALUE:string>>")), lambda d: F.struct(d["_key"].alias("k"), d["_VALUE"].alias("v"))))
    out = df.withColumn("__m", value)
    for k in keys:
        if k["_for"] in (kind, "all"):
            raw = F.trim(F.try_element_at("__m", F.lit(k["_id"])))
            name = f"attr_{k['attr']}" if k["attr"] in OWN else k["attr"]
            out = out.withColumn(name, raw.try_cast(TYPES[k["type"]]) if k["type"] in TYPES else raw)
    return out.drop("__m", "data")


def read_graphml(spark: SparkSession, path: str, node_attr: str = "pagerank", edge_attr: str = "betweenness", simplify: bool = True, keep_attrs: bool = False) -> Graph:
    """The first graph of a GraphML file, with dense ids in the order of node names.

    simplify drops loops and repeated edges, and with them edge attributes, unless
    keep_attrs takes the maximum of each.  size comes from node_attr and edge_attr where present.
    """
    keys = [{"_id": r[0], "_for": r[1], "attr": r[2], "type": r[3]} for r in _scan(spark, path, "key").distinct().collect()]  # a row per declared attribute
    head = _scan(spark, path, "graph").select("_edgedefault").first()
    directed = head is not None and head[0] == "directed"
    nodes = _attributes(_scan(spark, path, "node"), keys, "node").withColumnRenamed("_id", "xml_id")
    nodes = _numbered(nodes)
    m = nodes.select("xml_id", "id")
    edges = _attributes(_scan(spark, path, "edge"), keys, "edge").drop("_id")
    edges = edges.join(m.select(F.col("xml_id").alias("_source"), F.col("id").alias("src")), "_source").join(m.select(F.col("xml_id").alias("_target"), F.col("id").alias("dst")), "_target").drop("_source", "_target")
    g = Graph(nodes, edges, directed)
    if simplify:
        attrs = [c for c in edges.columns if c not in ("src", "dst")]
        g = g.simplify({c: F.max(c) for c in attrs} if keep_attrs and attrs else None)
    return Graph(size_from_attr(g.vertices, node_attr), size_from_attr(g.edges, edge_attr), directed)


def _numbered(nodes: DataFrame) -> DataFrame:
    """Dense ids by name: by number where every name is n and digits, else by hash order of distinct names."""
    number = F.regexp_extract("xml_id", r"^\D*(\d{1,18})$", 1)
    plain = nodes.withColumn("__n", F.when(number != "", number.cast("long")))
    if plain.where("__n is null").isEmpty() and plain.select("__n").distinct().count() == plain.count():
        return dense_ids(plain, "__n").drop("__n")
    return dense_ids(nodes.withColumn("__n", F.xxhash64("xml_id")), "__n").drop("__n")


def write_graphml(graph: Graph, path: str) -> None:
    """A folder of GraphML documents: each task writes its vertices or edges as a document of its own, all with the
    same declarations, so that any of them is well formed and read_graphml(path) puts them together."""
    import pandas as pd

    kinds = {"int": "int", "bigint": "long", "double": "double", "float": "float", "boolean": "boolean"}
    heads, body = [], []
    for part, df in (("node", graph.vertices), ("edge", graph.edges)):
        attrs = [(c, t) for c, t in df.dtypes if c not in OWN and not t.startswith(("array", "struct", "map"))]
        heads += [f'<key id={quoteattr(part + "_" + c)} for="{part}" attr.name={quoteattr(c)} attr.type="{kinds.get(t, "string")}"/>' for c, t in attrs]
        escaped = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col(c).cast("string"), "&", "&amp;"), "<", "&lt;"), ">", "&gt;")
        data = F.concat(F.lit(""), *(F.coalesce(F.concat(F.lit(f"<data key={quoteattr(part + '_' + c)}>"), escaped(c), F.lit("</data>")), F.lit("")) for c, _ in attrs))
        start = F.concat(F.lit('<node id="n'), F.col("id").cast("string"), F.lit('">')) if part == "node" else F.concat(F.lit('<edge source="n'), F.col("src").cast("string"), F.lit('" target="n'), F.col("dst").cast("string"), F.lit('">'))
        body.append(df.select(F.concat(start, data, F.lit(f"</{part}>")).alias("value")))
    default = "directed" if graph.directed else "undirected"
    head = "\n".join(['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', *heads, f'<graph id="G" edgedefault="{default}">'])

    def document(batches):
        yield pd.DataFrame({"value": [head]})
        yield from batches
        yield pd.DataFrame({"value": ["</graph>\n</graphml>"]})

    for part, df in zip(("nodes", "edges"), body):
        df.mapInPandas(document, "value string").write.mode("overwrite").text(f"{path}/{part}")
