"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import uuid
from itertools import count

import numpy as np
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


#: Tables written between two collections of the driver's garbage.
COLLECT = 4
_written = count(1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; in local mode one of our own where none is set."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="graphloom-"))
        root = sc.getCheckpointDir()
    return root.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if next(_written) % COLLECT == 0:
        # plans of finished rounds hang on Python's objects, and broadcasts and shuffles on those plans
        gc.collect()
        spark._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out._graphloom_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete tables made by materialize() that no later plan reads."""
    for df in frames:
        path = getattr(df, "_graphloom_path", None)
        if path:
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def uniform_hash(col, salt: int = 0):
    """A column in [0, 1) from a 64-bit hash: deterministic under recomputation."""
    return F.pmod(F.xxhash64(col, F.lit(salt)), F.lit(1 << 30)) / float(1 << 30)


def fold_of(doc_id, k: int):
    """crc32 of doc_id as text, modulo k."""
    return F.crc32(doc_id.cast("string").cast("binary")) % k


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of uint64 values (splitmix64's finalizer)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def csr_gather(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Positions start..start+len-1 of every segment, one after the other."""
    total = int(lens.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lens)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lens), lens)


def text_slices(texts: list, most: int = 4_000_000):
    """(from, to) ranges of at most `most` characters, one text at least."""
    a, size = 0, 0
    for b, t in enumerate(texts):
        n = len(t) if t else 0
        if b > a and size + n > most:
            yield a, b
            a, size = b, 0
        size += n
    if a < len(texts):
        yield a, len(texts)


def connected_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, component) for every node of edges (u, v): component is the smallest reachable node.

    Alternating large-star and small-star steps (Kiveris et al. 2014): each is one
    pre-aggregated minimum per node and one join, so a hub is split like any skewed
    join; rounds grow with the logarithm of the longest path.  Self-loops keep a
    lone node; null ends are ignored; an empty input gives an empty result.
    """
    e = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u is not null and v is not null")
    ends = e.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    seen, kept = None, []
    for _ in range(max_rounds):
        both = e.where("u <> v").select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        star = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        new = large.join(down, "u").select(F.explode(star).alias("e")).select("e.*").where("u <> v").distinct()
        said = Observation()
        e = materialize(new.observe(said, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")), "cc")
        discard(*kept)
        kept = [e]
        got = (said.get["n"], said.get["h"])
        if got == seen:
            break
        seen = got
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    roots = e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m"))
    return ends.join(roots, "node", "left").select("node", F.coalesce("m", "node").alias("component"))
