"""Global order without a global sort: ranks and running sums by range buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _buckets(df: DataFrame, key: str, n: int) -> list:
    """Sorted distinct quantiles of a numeric key, n - 1 at most."""
    q = df.agg(F.percentile_approx(key, [(k + 1) / n for k in range(n - 1)], 20 * n).alias("q")).first()["q"] if n > 1 else None
    return sorted(set(q or []))


def range_bucket(key: Column, bounds: list) -> Column:
    """How many of the sorted bounds are at most key, found by binary search."""
    if not bounds:
        return F.lit(0)
    steps = []
    s = 1
    while s <= len(bounds):
        steps.insert(0, s)
        s *= 2
    table = F.array(*(F.lit(b) for b in bounds))
    fits = lambda at, s: (at + s <= len(bounds)) & (F.get(table, at + s - 1) <= key)
    return F.aggregate(F.array(*(F.lit(s) for s in steps)), F.lit(0), lambda at, s: F.when(fits(at, s), at + s).otherwise(at))


def dense_ids(df: DataFrame, key: str, name: str = "id", buckets: int | None = None) -> DataFrame:
    """df with ids 0, 1, ... in the order of a numeric, distinct key.  Only counts per bucket meet on the driver."""
    n = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.withColumn("__b", range_bucket(F.col(key), _buckets(df, key, n)))
    counts = sorted((r["__b"], r["count"]) for r in placed.groupBy("__b").count().collect())
    before, rows = 0, []
    for b, c in counts:
        rows.append((b, before))
        before += c
    offsets = df.sparkSession.createDataFrame(rows, "__b int, __o long")
    rank = F.row_number().over(Window.partitionBy("__b").orderBy(key)) - 1
    return placed.withColumn("__r", rank).join(F.broadcast(offsets), "__b").withColumn(name, F.col("__r") + F.col("__o")).drop("__b", "__r", "__o")


def running_sum(df: DataFrame, value: Column, name: str, id_col: str = "id", block: int = 1 << 16) -> DataFrame:
    """df with the sum of value over all rows of at most this dense id: blocks first, then within blocks."""
    placed = df.withColumn("__b", F.floor(F.col(id_col) / block)).withColumn("__v", value)
    blocks = placed.groupBy("__b").agg(F.sum("__v").alias("__s"))
    before = F.coalesce(F.sum("__s").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    offsets = blocks.select("__b", before.alias("__o"))  # a row per block
    inside = F.sum("__v").over(Window.partitionBy("__b").orderBy(id_col).rowsBetween(Window.unboundedPreceding, 0))
    return placed.withColumn("__r", inside).join(F.broadcast(offsets), "__b").withColumn(name, F.col("__o") + F.col("__r")).drop("__b", "__v", "__r", "__o")


def successors(df: DataFrame, day: Column, order: list[str], value: str) -> DataFrame:
    """(s, t): value of each row and of the next in the global order, where `day` is a coarse, order-preserving key.

    Rows follow each other within a day; one row per day links its last to the next day's first.
    """
    d = df.select(day.alias("__d"), *dict.fromkeys([*order, value]))
    w = Window.partitionBy("__d").orderBy(*order)
    inside = d.select(F.col(value).alias("s"), F.lead(value).over(w).alias("t"), F.lit(True).alias("has"), F.row_number().over(w).alias("r")).where("t is not null").select("s", "t")
    key = F.struct(*order)
    ends = d.groupBy("__d").agg(F.min_by(value, key).alias("first"), F.max_by(value, key).alias("last"))
    across = ends.select(F.col("last").alias("s"), F.lead("first").over(Window.orderBy("__d")).alias("t")).where("t is not null")
    return inside.union(across)
