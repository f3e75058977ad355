"""Graphs made from the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph
from ..plans.ordering import successors


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hand_off(spark: SparkSession, sf_dir: str, event_type: str | None = "purchase") -> Graph:
    """user -> user of the next event in time, distinct, without loops; directed."""
    e = table(spark, sf_dir, "events")
    if event_type:
        e = e.where(F.col("event_type") == event_type)
    pairs = successors(e, F.date_trunc("day", "ts"), ["ts", "event_id"], "user_id").where("s <> t")
    return Graph.of_edges(pairs.select(F.col("s").alias("src"), F.col("t").alias("dst")).distinct(), True)


def co_ordered(spark: SparkSession, sf_dir: str) -> Graph:
    """Parts returned in one urgent order; undirected."""
    o = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select("o_orderkey")
    l = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p"))
    l = l.join(o, l["o"] == o["o_orderkey"], "left_semi").distinct()
    a, b = l.select("o", F.col("p").alias("src")), l.select("o", F.col("p").alias("dst"))
    return Graph.of_edges(a.join(b, "o").where("src < dst").select("src", "dst").distinct())


def customer_part(spark: SparkSession, sf_dir: str) -> Graph:
    """Customers (id 2k) and parts (id 2k + 1) that they ordered; bipartite."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    e = l.join(o, l["l_orderkey"] == o["o_orderkey"]).select((F.col("o_custkey") * 2).alias("src"), (F.col("l_partkey") * 2 + 1).alias("dst")).distinct()
    return Graph.of_edges(e)


def nation_trade(spark: SparkSession, sf_dir: str) -> Graph:
    """Customer nation -> supplier nation with revenue as weight; directed."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("rev"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    j = l.join(o, l["l_orderkey"] == o["o_orderkey"]).join(c, F.col("o_custkey") == c["c_custkey"]).join(s, l["l_suppkey"] == s["s_suppkey"])
    e = j.where("c_nationkey <> s_nationkey").groupBy(F.col("c_nationkey").cast("long").alias("src"), F.col("s_nationkey").cast("long").alias("dst")).agg(F.sum("rev").alias("weight"))
    return Graph.of_edges(e, True)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as points: the first three coordinates, and a size from the label."""
    e = table(spark, sf_dir, "embeddings")
    at = lambda k: F.get("embedding", F.lit(k)).cast("double")
    return e.select(F.col("vec_id").alias("id"), at(0).alias("x"), at(1).alias("y"), at(2).alias("z"), (0.1 + F.col("label") * 0.01).alias("size"))
