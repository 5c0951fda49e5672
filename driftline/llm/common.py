"""Storage and join helpers of the operators in this subpackage."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one 64-bit key that may be broadcast: 8 MB of keys, about 50 MB as a hash relation.
BROADCAST_KEYS = 1_000_000


#: What operators keep between their tasks, in Python workers that Spark reuses for others.
_KEPT: dict[str, dict] = {}


def keeps(owner: str) -> dict:
    """The dictionary in which an operator keeps what its next task in this process can use."""
    return _KEPT.setdefault(owner, {})


def lighten(owner: str) -> None:
    """As a task of ``owner`` begins: what the other operators keep in this process goes back to the system."""
    others = [kept for name, kept in _KEPT.items() if name != owner and kept]
    for kept in others:
        kept.clear()
    if others:
        gc.collect()
        trim()


def trim() -> None:
    """Freed memory of this process goes back to the system; the C library alone keeps what lies below a block in use."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where the setting is missing and all runs in one process (tests) is a folder made here.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        conf = "file://" + tempfile.mkdtemp(prefix="driftline-")
        spark.conf.set("spark.checkpoint.dir", conf)
    return conf.rstrip("/")


class Scratch:
    """Tables of one operator call in the shared folder.

    A written table cuts the lineage: a lost executor costs only the running stage.  ``drop``
    frees a table that later ones have replaced; the last ones are read lazily by the result
    and go with the cluster's shared folder.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/driftline/{label}-{uuid.uuid4().hex}"
        self.n = 0

    def put(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{name}"
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._driftline_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            self.delete(df._driftline_path)

    def delete(self, path: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def restrict(df: DataFrame, keys: DataFrame, key: str, most: int = BROADCAST_KEYS) -> DataFrame:
    """Rows of df whose key is in keys (distinct long keys).

    The keys are counted; up to ``most`` are broadcast, more go through a shuffled semi join.
    """
    if keys.limit(most + 1).count() <= most:
        keys = F.broadcast(keys)
    return df.join(keys, key, "left_semi")


def union_find(spark: SparkSession, scratch: Scratch, edges: DataFrame) -> DataFrame:
    """Connected components by alternating large-star and small-star steps, until a round changes no edge.

    ``edges`` has long columns a and b (any order, a != b).  Returns (node, root), root the smallest
    node of the component, for every node of an edge.  All state is in tables; a node with many
    neighbours is only ever aggregated (map-side) or joined, never collected.  Aggregates are written
    before they are joined, since AQE splits a hot key only between two plain exchanges.
    """
    edges = scratch.put(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = scratch.put(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "low")
        large = scratch.put(both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        down = scratch.put(large.groupBy("a").agg(F.min("b").alias("m")), "down")
        small = large.join(down, "a")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(down.select("a", F.col("m").alias("b")))
        new = scratch.put(small.distinct(), "edges")
        # two sets of distinct edges are equal if they are as many and none is new
        settled = new.count() == edges.count() and new.join(edges, ["a", "b"], "left_anti").isEmpty()
        scratch.drop(edges, low, large, down)
        edges = new
        if settled:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
