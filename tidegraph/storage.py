"""The append-only edge log, its layouts, and tables written between the rounds of iterative algorithms."""

from __future__ import annotations

import re
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EDGE = "src_id string, dst_id string, weight double, timestamp long, seq long"


@dataclass(frozen=True)
class LogConfig:
    """``paradigm`` 1: arrival order; 2: sorted by time; 3 and 4: buckets of ``interval`` from ``t0`` on (4 keeps t0 in the index)."""

    paradigm: int = 4
    interval: int = 50
    t0: int = 0
    store_ingoing: bool = True

    @staticmethod
    def from_properties(text: str) -> LogConfig:
        """Reads ``key=value`` lines; lines starting with ``#`` are comments."""
        pairs = dict(line.split("=", 1) for line in text.splitlines() if "=" in line and not line.lstrip().startswith("#"))
        get = {k.strip().upper(): v.strip() for k, v in pairs.items()}.get
        return LogConfig(int(get("STORAGE_PARADIGM", 2)), int(get("EVENT_TIME_INTERVAL", 50)), int(get("T0", 0)), get("STORE_INGOING_EDGES", "true").lower() == "true")

    def bucket(self, timestamp):
        """The bucket of a timestamp; the same expression on write and on read."""
        return F.floor((timestamp - (self.t0 if self.paradigm == 4 else 0)) / self.interval)


def shared_dir(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tidegraph-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Rounds:
    """Tables of one iterative run in the shared folder. ``add`` appends a level and returns it; ``some`` reads the named ones, ``all`` every level."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.schema = None

    def add(self, df: DataFrame, level: int) -> DataFrame:
        self.schema = self.schema or df.schema
        path = f"{self.root}/level={level}"
        df.write.parquet(path)
        return self.spark.read.schema(self.schema).parquet(path)

    def some(self, levels: list[int]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*[f"{self.root}/level={k}" for k in levels])

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(self.root)


def write_log(edges: DataFrame, path: str, config: LogConfig, mode: str = "append") -> None:
    """Appends edges to a log in the layout of ``config``.

    Buckets are dealt out by number, and adaptive execution splits a hot one and joins small ones.
    """
    if config.paradigm >= 3:
        edges.withColumn("bucket", config.bucket(F.col("timestamp"))).hint("rebalance", "bucket").write.mode(mode).partitionBy("bucket").parquet(path)
    elif config.paradigm == 2:
        edges.repartitionByRange("timestamp", "src_id", "dst_id").sortWithinPartitions("timestamp", "src_id", "dst_id").write.mode(mode).parquet(path)
    else:
        edges.write.mode(mode).parquet(path)


def read_log(spark: SparkSession, path: str, config: LogConfig) -> DataFrame:
    return spark.read.schema(EDGE + (", bucket long" if config.paradigm >= 3 else "")).parquet(path)


def read_window(spark: SparkSession, path: str, config: LogConfig, start_t: int, end_t: int) -> DataFrame:
    """Edges with start_t <= timestamp <= end_t. Bucket bounds are added for partition pruning, which can't be derived from the timestamp."""
    return pruned(read_log(spark, path, config), config, start_t, end_t).select("src_id", "dst_id", "weight", "timestamp", "seq")


def pruned(log: DataFrame, config: LogConfig, start_t: int, end_t: int) -> DataFrame:
    """The edges of a log from ``start_t`` to ``end_t``; of a bucketed one only those folders are read."""
    if config.paradigm >= 3:
        log = log.where(F.col("bucket").between(config.bucket(F.lit(start_t)), config.bucket(F.lit(end_t))))
    return window(log, start_t, end_t)


def window(edges: DataFrame, start_t: int, end_t: int) -> DataFrame:
    return edges.where(F.col("timestamp").between(start_t, end_t))
