"""The query engine: validation, dispatch by type, batches of queries over shared windows, result cache and history."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.functions import text
from tidegraph.operators import graph, state, windows
from tidegraph.storage import LogConfig, Rounds

#: What every algorithm returns: one row per answered query.
ANSWER = ["query_id", "user_id", "wid", "vertex_id", "query_type", "status", "result"]

#: An algorithm takes the window graphs, its queries and the ids of all vertices, and returns ``ANSWER`` rows.
Algorithm = Callable[[DataFrame, DataFrame, DataFrame], DataFrame]
ALGORITHMS: dict[str, Algorithm] = {}


def register(name: str) -> Callable[[Algorithm], Algorithm]:
    """Makes an algorithm answer queries of type ``name``."""

    def add(algorithm: Algorithm) -> Algorithm:
        ALGORITHMS[name] = algorithm
        return algorithm

    return add


def _answers(queries: DataFrame, found: DataFrame, result) -> DataFrame:
    """Answers of the queries in ``found`` with ``result``, the isolated text of the others."""
    name = "query_type"
    done = found.select("query_id", "user_id", "wid", "vertex_id", result.alias("result"))
    joined = queries.select(*graph.KEY, "vertex_id", name).join(done, [*graph.KEY, "vertex_id"], "left")
    lonely = F.lit(None).cast("string")
    for kind in text.ISOLATED:
        lonely = F.when(F.col(name) == kind, text.isolated(kind)).otherwise(lonely)
    return joined.select("query_id", "user_id", "wid", "vertex_id", name, F.when(F.col("result").isNull(), "isolated").otherwise("ok").alias("status"), F.coalesce("result", lonely).alias("result"))


@register("connected-components")
def _components(graphs: DataFrame, queries: DataFrame, ids: DataFrame) -> DataFrame:
    members = graph.component_of(graph.reachable(graphs, queries))
    return _answers(queries, members.groupBy(*graph.KEY, "vertex_id", "component_id").agg(F.collect_set("member_id").alias("members")), text.component_text())


@register("strongly-connected-components")
def _strong(graphs: DataFrame, queries: DataFrame, ids: DataFrame) -> DataFrame:
    members = graph.component_of(graph.strongly_connected(graphs, queries))
    return _answers(queries, members.groupBy(*graph.KEY, "vertex_id", "component_id").agg(F.collect_set("member_id").alias("members")), text.strong_text())


@register("single-source-shortest-path")
def _paths(graphs: DataFrame, queries: DataFrame, ids: DataFrame) -> DataFrame:
    found = graph.shortest_paths(graphs, queries)
    return _answers(queries, found.groupBy(*graph.KEY, "vertex_id").agg(F.collect_list(F.struct("target_id", "distance", "path")).alias("paths")), text.paths_text())


@register("gnn-sampling")
def _sampling(graphs: DataFrame, queries: DataFrame, ids: DataFrame) -> DataFrame:
    asked = queries.withColumns({c: F.col("parameter_map")[c].cast("int") for c in ("h", "k")})
    found = graph.sampled_tree(graphs, asked)
    return _answers(queries, found.groupBy(*graph.KEY, "vertex_id").agg(F.collect_list(F.struct("hop", "src_id", "dst_id")).alias("tree")), text.sample_text())


@register("pagerank")
def _ranks(graphs: DataFrame, queries: DataFrame, ids: DataFrame) -> DataFrame:
    """Every vertex of the log appears, with a null rank if it is not in the window."""
    asked = queries.withColumn("iterations", F.col("parameter_map")["iterations"].cast("int"))
    ranks = graph.pagerank(graphs, asked.select("wid", "iterations").distinct())
    # a batch asks about few windows: each once, however many queries share it
    wanted = [(r.wid, k) for r in asked.groupBy("wid").agg(F.max("iterations").alias("n")).collect() for k in range(1, r.n + 1)]
    every = F.explode(F.array(*[F.struct(F.lit(w).cast("long").alias("wid"), F.lit(k).alias("iteration")) for w, k in wanted])).alias("round")
    values = ids.select("vertex_id", every).select("round.*", "vertex_id").join(ranks, ["wid", "iteration", "vertex_id"], "left")
    per_round = values.groupBy("wid", "iteration").agg(F.array_sort(F.collect_list(F.struct(F.col("vertex_id").try_cast("bigint").alias("n"), "vertex_id", "rank"))).alias("values"))
    per_query = asked.select(*graph.KEY, "vertex_id", "query_type", "iterations").join(per_round, "wid").where("iteration <= iterations")
    whole = per_query.groupBy(*graph.KEY, "vertex_id", "query_type").agg(F.collect_list(F.struct("iteration", "values")).alias("ranks"))
    return whole.select(*graph.KEY, "vertex_id", "query_type", F.lit("ok").alias("status"), text.ranks_text().alias("result")).select(ANSWER)


def problem(types: list[str]):
    """Why a query can't be answered, else null."""
    number = lambda c: F.expr(f"try_cast(parameter_map['{c}'] AS int)")
    bad = lambda c: number(c).isNull() | (number(c) < 1)
    return (
        F.when(F.col("query_type").isNull() | ~F.col("query_type").isin(types), F.concat(F.lit("unknown query type "), F.coalesce("query_type", F.lit("null"))))
        .when(F.col("vertex_id").isNull(), "no vertex_id")
        .when((F.col("query_type") == "pagerank") & (F.col("vertex_id") != "all"), "pagerank is answered for the whole graph only: vertex_id must be all")
        .when((F.col("query_type") == "pagerank") & bad("iterations"), "iterations must be at least 1")
        .when((F.col("query_type") == "gnn-sampling") & (bad("h") | bad("k")), "h and k must be at least 1")
    )


@dataclass
class Engine:
    """Answers batches of queries over an edge log.

    ``answered`` holds the answers of all batches in the shared folder. One is reused only for the same question, in
    full, about the same version of the log.
    """

    config: LogConfig = field(default_factory=LogConfig)
    answered: Rounds | None = None
    batches: int = 0

    def answer(self, edges: DataFrame, queries: DataFrame, version: int = 0, log: DataFrame | None = None) -> DataFrame:
        """``ANSWER`` rows of all queries, repeated ones once; ``status`` is ok, isolated or error.

        ``log``: all edges, where ``edges`` are only those of the queries' windows; it tells which vertices exist.
        """
        spark = edges.sparkSession
        key = ["query_id", "user_id", "vertex_id", "query_type", "start_t", "end_t", "parameters"]
        asked = windows.number_windows(queries).withColumn("parameters", F.array_join(F.array_sort(F.transform(F.map_entries("parameter_map"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "&"))
        asked = asked.dropDuplicates(key).withColumn("problem", problem(list(ALGORITHMS)))
        asked = Rounds(spark, "asked").add(asked, 0)
        known = None
        if self.answered is not None:
            same = [F.col(f"a.{c}").eqNullSafe(F.col(f"c.{c}")) for c in key]
            hit = self.answered.all().where(F.col("version") == version).alias("c")
            known = asked.alias("a").join(hit, same).select(*[F.col(f"a.{c}") for c in ANSWER[:5]], "c.status", "c.result")
            asked = asked.alias("a").join(hit, same, "left_anti")
        out = asked.where("problem is not null").select(*ANSWER[:5], F.lit("error").alias("status"), F.col("problem").alias("result"))
        good = asked.where("problem is null")
        kinds = [r.query_type for r in good.select("query_type").distinct().collect()]
        graphs = Rounds(spark, "graphs").add(windows.window_graphs(edges, good, self.config), 0)
        ids = state.vertex_ids(edges if log is None else log)
        for kind in kinds:
            out = out.unionByName(ALGORITHMS[kind](graphs, good.where(F.col("query_type") == kind), ids).select(ANSWER))
        fresh = out.join(asked.select("query_id", "user_id", "wid", "vertex_id", "query_type", "start_t", "end_t", "parameters"), ["query_id", "user_id", "wid", "vertex_id", "query_type"])
        self.answered = self.answered or Rounds(spark, "answered")
        fresh = self.answered.add(fresh.withColumn("version", F.lit(version).cast("long")), self.batches)
        self.batches += 1
        return fresh.select(ANSWER) if known is None else fresh.select(ANSWER).unionByName(known.select(ANSWER))

    def with_history(self, results: DataFrame) -> DataFrame:
        """Results joined with all answers given to the same query and user, one row per answer; adds ``earlier`` and ``version``."""
        past = self.answered.all().select("query_id", "user_id", F.col("result").alias("earlier"), "version")
        return results.join(past, ["query_id", "user_id"])

    def views(self, spark: SparkSession, edges: DataFrame) -> None:
        """Edges, activities and vertices as views for plain SQL."""
        edges.createOrReplaceTempView("edges")
        state.activities(edges, self.config.store_ingoing).createOrReplaceTempView("activities")
        state.vertex_ids(edges).createOrReplaceTempView("vertices")
