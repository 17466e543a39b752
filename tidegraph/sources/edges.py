"""Edge and query sources: JSON lines, keyed text, raw edge lists, Kafka, and generators."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EDGE_WIRE = "src_id string, dst_id string, weight string, timestamp string"
QUERY_WIRE = "query_id string, user_id string, vertex_id string, query_type string, start_t string, end_t string, parameter_map map<string,string>"
#: A path without a host is written with one slash or with three.
NO_HOST = r"^(\w+:)///"


def typed_edges(wire: DataFrame, seq: Column | None = None) -> DataFrame:
    """S3: wire strings to edges; rows without ids or with a timestamp that is no number are left out."""
    seq = F.monotonically_increasing_id() if seq is None else seq
    rows = wire.select("src_id", "dst_id", F.expr("try_cast(weight AS double)").alias("weight"), F.expr("try_cast(timestamp AS bigint)").alias("timestamp"), seq.cast("long").alias("seq"))
    return rows.where("src_id is not null and dst_id is not null and timestamp is not null")


def typed_queries(wire: DataFrame) -> DataFrame:
    """Wire strings to queries; a missing bound reads as 0."""
    bound = lambda c: F.coalesce(F.expr(f"try_cast({c} AS bigint)"), F.lit(0)).alias(c)
    return wire.select("query_id", "user_id", "vertex_id", "query_type", bound("start_t"), bound("end_t"), "parameter_map")


def edges_from_json(lines: DataFrame, column: str = "value") -> DataFrame:
    return typed_edges(lines.select(F.from_json(column, EDGE_WIRE).alias("e")).select("e.*"))


def queries_from_json(lines: DataFrame, column: str = "value") -> DataFrame:
    return typed_queries(lines.select(F.from_json(column, QUERY_WIRE).alias("q")).select("q.*"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``value, seq`` of text files; ``seq`` rises with the file's name, then the line, but isn't dense.

    A line's place is its split's first byte plus its number in the split, which can't reach the next split's. Files
    are ranked by the names that the driver lists anyway; up to 2^20 files of 8 TB each.
    """
    lines = spark.read.text(path)
    split = F.struct(F.regexp_replace("_metadata.file_path", NO_HOST, "$1/").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    placed = lines.select("value", split.alias("split"), F.monotonically_increasing_id().alias("row")).select("value", "split.*", "row")
    line = F.row_number().over(Window.partitionBy("file", "start").orderBy("row")) - 1
    ranks = spark.createDataFrame([(f, n) for n, f in enumerate(sorted(re.sub(NO_HOST, r"\1/", f) for f in lines.inputFiles()))], "file string, rank long")
    numbered = placed.select("value", "file", (F.col("start") + line).alias("place")).join(ranks, "file", "left")
    rank = F.coalesce("rank", F.raise_error(F.concat(F.lit("not among the files listed: "), F.col("file"))).cast("long"))
    return numbered.select("value", (F.shiftleft(rank, 43) + F.col("place")).alias("seq"))


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """Files of one JSON object per line; ``seq`` rises with the file's name, then the line."""
    wire = numbered_lines(spark, path).select(F.from_json("value", EDGE_WIRE).alias("e"), "seq")
    return typed_edges(wire.select("e.*", "seq"), F.col("seq"))


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    return queries_from_json(spark.read.text(path).where("trim(value) <> ''"))


def unkeyed(lines: DataFrame, column: str = "value") -> DataFrame:
    """``key: {json}`` lines to ``key, value``."""
    pattern = r"^([^:{]+):\s*(\{.*)$"
    return lines.select(F.regexp_extract(column, pattern, 1).alias("key"), F.regexp_extract(column, pattern, 2).alias("value")).where("value <> ''")


def raw_edge_list(lines: DataFrame, mirror: bool = False, rows: int | None = None, column: str = "value") -> DataFrame:
    """``src dst timestamp`` lines to edges without weights, both ways if wanted.

    ``rows`` caps the lines read: the first by ``seq``, which ``lines`` must have then (``numbered_lines`` gives it).
    """
    numbered = "seq" in lines.columns
    if rows is not None:
        if not numbered:
            raise ValueError("a cap needs lines with seq, as the first lines are undefined without")
        lines = lines.orderBy("seq").limit(rows)
    parts = F.split(F.trim(column), r"\s+")
    wire = lines.select(F.get(parts, F.lit(0)).alias("src_id"), F.get(parts, F.lit(1)).alias("dst_id"), F.lit(None).cast("string").alias("weight"), F.get(parts, F.lit(2)).alias("timestamp"), *(["seq"] if numbered else []))
    edges = typed_edges(wire, F.col("seq") if numbered else None)
    if mirror:
        # the mirrored edge arrives right after its edge
        twin = edges.withColumns({"src_id": F.col("dst_id"), "dst_id": F.col("src_id"), "seq": F.col("seq") * 2 + 1})
        edges = edges.withColumn("seq", F.col("seq") * 2).unionByName(twin)
    return edges


def to_edge_json(edges: DataFrame) -> DataFrame:
    """Edges as JSON lines with the wire's strings; a missing weight is left out."""
    return edges.select(F.to_json(F.struct("src_id", "dst_id", F.col("weight").cast("string").alias("weight"), F.col("timestamp").cast("string").alias("timestamp"))).alias("value"), "seq")


def kafka_stream(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """A topic from its start, as ``key, value`` strings; needs Spark's Kafka connector on the class path."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest").load()
    return raw.select(F.col("key").cast("string"), F.col("value").cast("string"))


def json_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """A folder of JSON-lines files as a stream of ``value`` strings."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder)


def synthetic_edges(spark: SparkSession, n: int = 100_000, hub: int = 151, vertices: int = 1001, span: int = 530_000, mirror: bool = True, seed: int = 1) -> DataFrame:
    """Edges from one hub to random vertices at distinct times in [0, span): a multiplicative permutation of the row number."""
    step = next(p for p in range(span * 618 // 1000, span) if _coprime(p, span))
    base = spark.range(n).select(F.lit(str(hub)).alias("src_id"), F.floor(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(vertices))).cast("string").alias("dst_id"), F.lit(None).cast("double").alias("weight"), ((F.col("id") * step + seed) % span).alias("timestamp"), (F.col("id") * 2).alias("seq"))
    if not mirror:
        return base
    return base.unionByName(base.withColumns({"src_id": F.col("dst_id"), "dst_id": F.col("src_id"), "seq": F.col("seq") + 1}))


def _coprime(a: int, b: int) -> bool:
    while b:
        a, b = b, a % b
    return a == 1


def growing_window_queries(spark: SparkSession, vertices: int = 20, ends: tuple[int, ...] = (100, 1_000, 10_000, 100_000, 1_000_000), first_vertex: int = 1) -> DataFrame:
    """Component queries of each vertex over each growing window."""
    base = spark.range(vertices * len(ends))
    end = F.get(F.array(*[F.lit(e) for e in ends]), F.floor(F.col("id") / vertices).cast("int"))
    return base.select((F.col("id") + 1).cast("string").alias("query_id"), F.lit("1").alias("user_id"), (F.col("id") % vertices + first_vertex).cast("string").alias("vertex_id"), F.lit("connected-components").alias("query_type"), F.lit(0).cast("long").alias("start_t"), end.cast("long").alias("end_t"), F.lit(None).cast("map<string,string>").alias("parameter_map"))


def fixed_window_queries(spark: SparkSession, n: int = 100, end_t: int = 100_000, iterations: int = 10) -> DataFrame:
    """PageRank queries of one window over the whole graph."""
    return spark.range(n).select((F.col("id") + 1).cast("string").alias("query_id"), F.lit("1").alias("user_id"), F.lit("all").alias("vertex_id"), F.lit("pagerank").alias("query_type"), F.lit(0).cast("long").alias("start_t"), F.lit(end_t).cast("long").alias("end_t"), F.create_map(F.lit("iterations"), F.lit(str(iterations))).alias("parameter_map"))
