"""Edges and queries as streams: an append-only log, answers per micro-batch, and running metrics."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidegraph.functions.text import egress
from tidegraph.plans.engine import Engine
from tidegraph.sources.edges import edges_from_json, queries_from_json
from tidegraph.storage import LogConfig, Rounds, pruned, read_log, write_log


def ingest_edges(lines: DataFrame, log: str, checkpoint: str, config: LogConfig, metrics: str | None = None) -> StreamingQuery:
    """S1 to the log: every micro-batch is appended in the layout of ``config``; nothing is late, nothing expires.

    ``seq`` orders arrival: the batch's number, then the row within it. A batch that is run again after a failure may
    append its edges twice, which no graph result notices. ``metrics``: a folder for K2 records.
    """

    def append(batch: DataFrame, number: int) -> None:
        begin = time.monotonic_ns()
        edges = edges_from_json(batch).withColumn("seq", F.col("seq") + F.lit(number) * F.lit(1 << 46))
        write_log(edges, log, config)
        if metrics:
            batch.sparkSession.createDataFrame([(number, time.monotonic_ns() - begin)], "batch long, time long").write.mode("append").parquet(metrics)

    return lines.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def answer_queries(lines: DataFrame, log: str, out: str, checkpoint: str, engine: Engine, metrics: str | None = None) -> StreamingQuery:
    """All queries of a micro-batch are answered together over one snapshot of the log.

    A batch writes its own folder, replaced if it runs again, so each answer is there once. ``metrics``: a folder for
    K3 records, the time to filter a batch's edges from the log, for which they are read once more.
    """

    def answer(batch: DataFrame, number: int) -> None:
        spark: SparkSession = batch.sparkSession
        begin = time.monotonic()
        queries = Rounds(spark, "queries").add(queries_from_json(batch), 0)
        edges = asked_edges(spark, log, engine.config, queries)
        if metrics:
            started = time.monotonic_ns()
            edges.count()
            spark.createDataFrame([(number, time.monotonic_ns() - started)], "batch long, time long").write.mode("append").parquet(metrics)
        results = engine.answer(edges, queries, number, read_log(spark, log, engine.config))
        key, value = egress(F.col("result"), F.lit(round((time.monotonic() - begin) * 1000)))
        results.select(key, value).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return lines.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def asked_edges(spark: SparkSession, log: str, config: LogConfig, queries: DataFrame) -> DataFrame:
    """The edges of a log between the first and the last moment that some query asks for; other buckets aren't read."""
    lo, hi = queries.where("start_t <= end_t").agg(F.min("start_t"), F.max("end_t")).first()
    edges = read_log(spark, log, config)
    return edges.limit(0) if lo is None else pruned(edges, config, lo, hi)


def dump_text(results: DataFrame, path: str) -> None:
    """K5: ``query_id user_id time result`` lines of K1 records."""
    value = F.from_json("value", "result_string string, time string")
    results.select(F.concat_ws(" ", F.col("key"), value["time"], value["result_string"])).write.mode("overwrite").text(path)
