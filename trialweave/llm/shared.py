"""Tables in the shared folder: lineage is cut by writing and rereading them.

The folder is the session's ``spark.checkpoint.dir``.  Only where that is unset and all of
Spark is one process on this machine (as in tests) a temporary one is made; on a cluster an
unset folder is an error.
"""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="trialweave-")
        context.setCheckpointDir(found)
    return found.rstrip("/")


class Scratch:
    """Tables of one call of an operator, in a folder of their own.

    The operator drops what its result does not read; the rest goes when the program ends."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.path = f"{shared_folder(spark)}/trialweave-{name}-{uuid.uuid4().hex}"
        self._place = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._place(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        atexit.register(self.close)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written as the table ``name`` and read again."""
        df.write.parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            self._fs.delete(self._place(f"{self.path}/{name}"), True)

    def close(self) -> None:
        with contextlib.suppress(Exception):  # the virtual machine may be gone
            self._fs.delete(self._place(self.path), True)


def apart(key: str) -> Column:
    """A grouping column beside ``key`` that depends on it alone.

    An aggregate over both has the same groups, but in a join on ``key`` its rows are dealt out
    anew, so both sides have a shuffle of their own and Spark may split a hot key of the other."""
    return (F.col(key) % 2).alias("_apart")


def connected_components(edges: DataFrame, scratch: Scratch, name: str, *, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges(a long, b long)``; root is the component's least node.

    Alternating large-star and small-star rounds (Kiveris et al., 2014); each round is one
    written table.  Hot nodes are met by partial minima and by joins that Spark may split.
    The result reads the table ``name`` of ``scratch``.
    """
    now = scratch.table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0")
    before = None
    for k in range(1, most_rounds + 1):
        # large-star: each neighbour above u is tied to the least of u and its neighbours
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u", apart("u")).agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        # small-star: u and its neighbours below are tied to the least of them
        low = large.groupBy("a", apart("a")).agg(F.min("b").alias("m")).select("a", "m")
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        new = scratch.table(small, f"{name}-{k}")
        state = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        scratch.drop(f"{name}-{k - 1}")
        now = new
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = scratch.table(roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()), name)
    scratch.drop(f"{name}-{k}")
    return out
