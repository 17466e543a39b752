"""Windows of many queries over one edge log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.operators.state import weighted_neighbours
from tidegraph.storage import LogConfig


def number_windows(queries: DataFrame) -> DataFrame:
    """Adds ``wid``, equal for equal windows, so each window's graph is built once."""
    return queries.withColumn("wid", F.xxhash64("start_t", "end_t"))


def window_edges(edges: DataFrame, windows: DataFrame, config: LogConfig, most_buckets: int = 4096) -> DataFrame:
    """The edges of each window ``(wid, start_t, end_t)``, as an equi-join on time buckets with the exact bounds checked after.

    The bucket length adapts to the windows, so that none is longer than ``most_buckets``; a window's first and last
    bucket need the check only. An empty window (start after end) has no edges.
    """
    windows = windows.select("wid", "start_t", "end_t").distinct().where("start_t <= end_t")
    lo, hi = edges.agg(F.min("timestamp"), F.max("timestamp")).first()
    if lo is None:
        return edges.limit(0).withColumn("wid", F.lit(0).cast("long"))
    step = max(config.interval, (hi - lo) // most_buckets + 1)
    index = lambda t: F.floor((t - lo) / step)
    # windows may reach beyond the log: only buckets that exist
    inside = windows.where((F.col("end_t") >= lo) & (F.col("start_t") <= hi)).withColumn("b", F.explode(F.sequence(index(F.greatest("start_t", F.lit(lo))), index(F.least("end_t", F.lit(hi))))))
    return edges.withColumn("b", index(F.col("timestamp"))).join(inside, "b").where(F.col("timestamp").between(F.col("start_t"), F.col("end_t"))).drop("b", "start_t", "end_t")


def window_graphs(edges: DataFrame, windows: DataFrame, config: LogConfig) -> DataFrame:
    """``wid, src_id, dst_id, weight``: each window's graph with parallel edges collapsed."""
    return weighted_neighbours(window_edges(edges, windows, config), config, ("wid",))
