"""Activities, neighbours and degrees recovered from the edge log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.storage import LogConfig


def activities(edges: DataFrame, store_ingoing: bool = True) -> DataFrame:
    """An outgoing activity at the source of each edge and, if wanted, an ingoing one at its target."""
    sides = [F.struct(F.col("src_id").alias("vertex_id"), F.lit(False).alias("ingoing"))]
    if store_ingoing:
        sides.append(F.struct(F.col("dst_id").alias("vertex_id"), F.lit(True).alias("ingoing")))
    return edges.select(F.explode(F.array(*sides)).alias("side"), "src_id", "dst_id", "weight", "timestamp", "seq").select("side.vertex_id", F.lit("add").alias("activity_type"), "src_id", "dst_id", "weight", "timestamp", "side.ingoing", "seq")


def outgoing(log: DataFrame) -> DataFrame:
    """P4."""
    return log.where((F.col("activity_type") == "add") & ~F.col("ingoing"))


def ingoing(log: DataFrame) -> DataFrame:
    """P5."""
    return log.where((F.col("activity_type") == "add") & F.col("ingoing"))


def out_neighbours(edges: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """A1."""
    return edges.select(*by, "src_id", "dst_id").distinct()


def arrival(config: LogConfig) -> Column:
    """The order in which a layout returns edges; the last one's weight counts, of equal places the largest."""
    first = {1: F.lit(0), 2: F.col("timestamp")}.get(config.paradigm, config.bucket(F.col("timestamp")))
    return F.struct(first.cast("long"), F.col("seq"), F.col("weight"))


def weighted_neighbours(edges: DataFrame, config: LogConfig, by: tuple[str, ...] = ()) -> DataFrame:
    """A2, P10: the last written weight of each pair, 1.0 where it is missing."""
    return edges.groupBy(*by, "src_id", "dst_id").agg(F.max_by(F.coalesce("weight", F.lit(1.0)), arrival(config)).alias("weight"))


def in_degree(edges: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """A3: distinct sources of ingoing edges."""
    return edges.groupBy(*by, F.col("dst_id").alias("vertex_id")).agg(F.countDistinct("src_id").alias("in_degree"))


def with_weight_sum(adjacency: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """A4: adds the sum of a vertex's out-weights."""
    total = adjacency.groupBy(*by, "src_id").agg(F.sum("weight").alias("weight_sum"))
    return adjacency.join(total, [*by, "src_id"])


def vertex_ids(edges: DataFrame) -> DataFrame:
    """Every vertex of the whole log."""
    return edges.select(F.explode(F.array("src_id", "dst_id")).alias("vertex_id")).distinct()


def bucket_counts(edges: DataFrame, config: LogConfig) -> DataFrame:
    """Edges per bucket, by bucket number."""
    return edges.groupBy(config.bucket(F.col("timestamp")).cast("long").alias("bucket")).agg(F.count("*").alias("n_edges"))


def activity_rank(log: DataFrame, by: str = "vertex_id") -> DataFrame:
    """O1: place of each activity in its vertex's log by (timestamp, src, dst)."""
    order = Window.partitionBy(by).orderBy("timestamp", "src_id", "dst_id", "ingoing", "seq")
    return log.withColumn("place", F.row_number().over(order))


def mirrored(edges: DataFrame) -> DataFrame:
    """Both directions of every edge."""
    return edges.unionByName(edges.withColumns({"src_id": F.col("dst_id"), "dst_id": F.col("src_id")}))


def running_stats(metrics: DataFrame, value: str, order: list[str], by: list[str]) -> DataFrame:
    """Count, sum and mean of all records so far, after each record; ``by`` keeps series apart."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return metrics.withColumn("record_number", F.count("*").over(w)).withColumn("overall_time", F.sum(value).over(w)).withColumn("average_time", F.col("overall_time") / F.col("record_number"))


def latency_cdf(metrics: DataFrame, value: str, by: list[str]) -> DataFrame:
    """The share of records not slower than each."""
    return metrics.withColumn("fraction", F.cume_dist().over(Window.partitionBy(*by).orderBy(value)))


def latency_marks(metrics: DataFrame, value: str, by: list[str], shares: tuple[float, ...] = (0.9, 0.99)) -> DataFrame:
    """The least value that at least such a share of the records doesn't exceed, for each share."""
    ranked = metrics.withColumn("fraction", F.cume_dist().over(Window.partitionBy(*by).orderBy(value)))
    marks = ranked.select(*by, value, "fraction", F.explode(F.array(*[F.lit(s) for s in shares])).alias("share")).where("fraction >= share")
    return marks.groupBy(*by, "share").agg(F.min(value).alias(value))


def metric_records(metrics: DataFrame, value: str, order: list[str], by: list[str]) -> DataFrame:
    """K2, K3: ``key`` (record number) and JSON ``value`` with the time, the overall and the average time of the records so far."""
    stats = running_stats(metrics, value, order, by)
    wire = F.struct(F.col(value).cast("string").alias("time"), F.col("overall_time").cast("string").alias("overall_time"), F.format_string("%.1f", "average_time").alias("average_time"))
    return stats.select(*by, F.col("record_number").cast("string").alias("key"), F.to_json(wire).alias("value"))


def latency_histogram(metrics: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """Counts in equal bins of log10 between the smallest and the largest value."""
    logs = metrics.where(F.col(value) > 0).select(F.log10(value).alias("l"))
    bounds = logs.agg(F.min("l").alias("lo"), F.max("l").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    binned = logs.crossJoin(F.broadcast(bounds)).select(F.when(width == 0, 0).otherwise(F.least(F.floor((F.col("l") - F.col("lo")) / width), F.lit(bins - 1))).cast("long").alias("bin"))
    return binned.groupBy("bin").agg(F.count("*").alias("n"))
