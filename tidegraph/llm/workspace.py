"""Shared-folder tables and connected components, used by several operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a temporary one where that is unset and all runs in one process (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tidegraph-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """An eager checkpoint: keeps the partitions as they are."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


class Workspace:
    """One run's tables under the shared folder. ``keep`` writes a frame and reads it back, which cuts its lineage;
    ``drop`` deletes a table that nothing reads any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def keep(self, df: DataFrame, table: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(self.path(table))
        return self.spark.read.schema(df.schema).parquet(self.path(table))

    def drop(self, table: str) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(table))
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or one made from it, that no column of ``df`` has in any spelling."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def only(df: DataFrame, ids: DataFrame, key: str, most: int = 1_000_000) -> DataFrame:
    """The rows of ``df`` whose ``key`` is among ``ids``: by broadcast up to ``most`` counted ids, else by a shuffle."""
    return df.join(F.broadcast(ids) if ids.count() <= most else ids, key, "left_semi")


def components(edges: DataFrame, space: Workspace, table: str = "cc", rounds: int = 60) -> DataFrame:
    """``(a, b)`` links to ``(node, component)`` where component is the smallest node reachable; linked nodes only.

    Alternating large-star and small-star steps; each round is written to the shared folder. The state is one
    edge row per node or link, so a hub of any degree stays a set of rows.
    """
    now = space.keep(
        edges.where("a <> b").select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).distinct(), f"{table}0"
    )
    mark = None
    for k in range(1, rounds):
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # least neighbours are tables of their own, so that the join of a hub's links can be split
        low = space.keep(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{table}low{k}")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        nxt = space.keep(small.select("e.u", "e.v").where("u <> v").distinct(), f"{table}{k}")
        space.drop(f"{table}low{k}")
        seen = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        space.drop(f"{table}{k - 1}")
        now = nxt
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError("connected components did not settle")
    flat = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return flat.union(flat.select(F.col("component").alias("node"), "component").distinct())
