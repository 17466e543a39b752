"""The five graph algorithms, each for a batch of queries at once.

``graphs(wid, src_id, dst_id, weight)`` holds the collapsed graph of each window, ``queries`` the columns ``wid,
query_id, user_id, vertex_id`` and parameters. Every round is one or two shuffles over all queries and is written to
the shared folder, which cuts the lineage and survives lost executors.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.storage import Rounds

KEY = ["query_id", "user_id", "wid"]
DAMPING = 0.85
#: Links that one task of a round reads.
LINKS = 250_000


def _dealt(graphs: DataFrame, *columns) -> DataFrame:
    """``columns``, else all, of the graphs dealt out and sorted by source once, for all rounds; read from their table again where an executor is lost.

    Into as many parts as the links need, so that a round's tasks grow with the graph only.
    """
    table = Rounds(graphs.sparkSession, "adjacency").add(graphs, 0)
    return table.repartition(table.count() // LINKS + 1, "wid", "src_id").sortWithinPartitions("wid", "src_id").select(*columns or ["*"]).persist(StorageLevel.DISK_ONLY)


def _asked(found: DataFrame, queries: DataFrame, *more: str) -> DataFrame:
    """What was found for the start vertices of windows (and parameters ``more``), for each query that asks it."""
    start = ["wid", "vertex_id", *more]
    return queries.select(*KEY, "vertex_id", *more).distinct().join(found, start)


def _both_ways(adjacency: DataFrame) -> bool:
    """Whether every edge has its reverse: two fingerprints of (src, dst) and of (dst, src) add up to the same, by chance in 1 of 2^128."""
    mark = lambda seed, a, b: F.xxhash64(F.lit(seed), "wid", a, b).cast("decimal(20,0)")
    sums = [F.sum(mark(s, "src_id", "dst_id") - mark(s, "dst_id", "src_id")) for s in (1, 2)]
    return not any(adjacency.agg(*sums).first())


def _walks(adjacency: DataFrame, queries: DataFrame, both_ways: bool) -> DataFrame:
    """``wid, vertex_id, member_id`` of all vertices on walks from each distinct start that has an out-edge.

    Level by level: frontier joined with adjacency, less the visited. Where edges run both ways, the neighbours of a
    level lie in it, in the one before or in the next, so the older ones aren't read again.
    """
    spark = adjacency.sparkSession
    rounds = Rounds(spark, "reach")
    starts = queries.select("wid", F.col("vertex_id").alias("src_id")).distinct()
    begun = adjacency.select("wid", "src_id").join(starts, ["wid", "src_id"]).distinct()
    frontier = before = rounds.add(begun.select("wid", F.col("src_id").alias("vertex_id"), F.col("src_id").alias("member_id")), 0)
    level = 0
    while not frontier.isEmpty():
        level += 1
        visited = before.union(frontier) if both_ways else rounds.all()
        step = frontier.withColumnRenamed("member_id", "src_id").join(adjacency, ["wid", "src_id"]).select("wid", "vertex_id", F.col("dst_id").alias("member_id")).distinct()
        before, frontier = frontier, rounds.add(step.join(visited, ["wid", "vertex_id", "member_id"], "left_anti"), level)
    return rounds.all()


def reachable(graphs: DataFrame, queries: DataFrame, directed: bool = True) -> DataFrame:
    """G1: ``KEY, vertex_id, member_id`` of all vertices on out-edge walks from a query's vertex, itself included.

    Empty for a vertex without out-edges. Queries of one vertex and window share its walk.
    """
    adjacency = graphs.select("wid", "src_id", "dst_id")
    if not directed:
        adjacency = adjacency.union(adjacency.select("wid", F.col("dst_id").alias("src_id"), F.col("src_id").alias("dst_id"))).distinct()
    adjacency = _dealt(adjacency)
    members = _walks(adjacency, queries, not directed or _both_ways(adjacency))
    adjacency.unpersist()
    return _asked(members, queries).select(*KEY, "vertex_id", "member_id")


def component_of(members: DataFrame) -> DataFrame:
    """Adds ``component_id``, the least member; by number where all ids are numbers, else by text."""
    number = F.expr("try_cast(member_id AS bigint)")
    least = members.groupBy(*KEY, "vertex_id").agg(F.when(F.count("*") == F.count(number), F.min(number).cast("string")).otherwise(F.min("member_id")).alias("component_id"))
    return members.join(least, [*KEY, "vertex_id"])


def strongly_connected(graphs: DataFrame, queries: DataFrame) -> DataFrame:
    """``KEY, vertex_id, member_id``: vertices both reachable from the query's vertex and reaching it, itself included."""
    adjacency = _dealt(graphs.select("wid", "src_id", "dst_id"))
    both_ways = _both_ways(adjacency)
    members = forward = _walks(adjacency, queries, both_ways)
    adjacency.unpersist()
    if not both_ways:
        reverse = _dealt(graphs.select("wid", F.col("dst_id").alias("src_id"), F.col("src_id").alias("dst_id")))
        back = _walks(reverse, queries, False)
        reverse.unpersist()
        members = forward.join(back, ["wid", "vertex_id", "member_id"], "left_semi").union(forward.where("vertex_id = member_id")).distinct()
    return _asked(members, queries).select(*KEY, "vertex_id", "member_id")


def shortest_paths(graphs: DataFrame, queries: DataFrame) -> DataFrame:
    """``KEY, vertex_id, target_id, distance, path`` of every reachable vertex but the source; least (distance, hops, path).

    Bellman-Ford by frontiers: only vertices whose best label improved are expanded. The best labels are written anew
    when as many have been found since, so a round reads at most twice the vertices. Raises on negative weights.
    """
    spark = graphs.sparkSession
    if not graphs.where("weight < 0").isEmpty():
        raise ValueError("shortest paths need weights of 0 or more")
    graphs = _dealt(graphs.select("wid", "src_id", "dst_id", "weight"))
    label = F.struct(F.col("distance"), F.col("hops"), F.col("path"))
    start = queries.select("wid", "vertex_id", F.col("vertex_id").alias("target_id"), F.struct(F.lit(0.0).alias("distance"), F.lit(0).alias("hops"), F.array("vertex_id").alias("path")).alias("best")).distinct()
    rounds, whole = Rounds(spark, "paths"), Rounds(spark, "best")
    key = ["wid", "vertex_id", "target_id"]
    frontier = rounds.add(start.withColumn("new", F.lit(True)), 0)
    base, base_rows, recent, recent_rows = whole.add(start, 0), 0, [], 0
    level, bound = 0, None
    while True:
        rows, new = frontier.agg(F.count("*"), F.count_if("new")).first()
        best = base.union(rounds.some(recent).drop("new")).groupBy(*key).agg(F.min("best").alias("best")) if recent else base
        recent_rows += rows if recent else 0
        if not rows:
            break
        # without new vertices, all neighbours are labelled: longer ways than to the farthest lead to no better label
        if recent_rows >= base_rows or (not new and bound is None):
            base = best = whole.add(best, level) if recent else base
            base_rows, recent, recent_rows = base.count(), [], 0
            if not new and bound is None:
                bound = base.agg(F.max("best.distance")).first()[0]
                wide, graphs = graphs, _dealt(graphs.where(F.col("weight") <= bound))
                wide.unpersist()
        level += 1
        way = F.col("best.distance") + F.col("weight")
        step = frontier.select("wid", "vertex_id", F.col("target_id").alias("src_id"), "best").join(graphs, ["wid", "src_id"])
        step = step if bound is None else step.where(way <= bound)
        found = step.where(~F.array_contains("best.path", F.col("dst_id"))).select("wid", "vertex_id", F.col("dst_id").alias("target_id"), way.alias("distance"), (F.col("best.hops") + 1).alias("hops"), F.concat("best.path", F.array("dst_id")).alias("path")).groupBy(*key).agg(F.min(label).alias("best"))
        old = best.withColumnRenamed("best", "old")
        better = found.join(old, key, "left").where(F.col("old").isNull() | (F.col("best") < F.col("old")))
        frontier = rounds.add(better.select(*key, "best", F.col("old").isNull().alias("new")), level)
        recent = [*recent, level]
    graphs.unpersist()
    found = _asked(best.where("target_id <> vertex_id"), queries)
    return found.select(*KEY, "vertex_id", "target_id", F.col("best.distance").alias("distance"), F.col("best.path").alias("path"))


def sampled_tree(graphs: DataFrame, queries: DataFrame, seed: int = 0) -> DataFrame:
    """``KEY, vertex_id, hop, src_id, dst_id, path``: a tree of at most ``h`` neighbours per node and ``k`` hops, as a bag of edges.

    Neighbours on the path from the source to the node are left out, the node itself isn't. A node's sample is the
    ``h`` least md5 of seed, path and neighbour, so it can be repeated; ``h`` of at least the largest degree takes all.
    """
    spark = graphs.sparkSession
    adjacency = _dealt(graphs.select("wid", "src_id", "dst_id"))
    rounds = Rounds(spark, "tree")
    asked = queries.select("wid", "vertex_id", "h", "k").where("h > 0 and k > 0").distinct()
    deepest = asked.agg(F.max("k")).first()[0] or 0
    nodes = asked.select("*", F.col("vertex_id").alias("dst_id"), F.array().cast("array<string>").alias("path"))
    empty = nodes.select("wid", "vertex_id", "h", "k", F.lit(0).alias("hop"), F.lit("").alias("src_id"), "dst_id", "path").limit(0)
    rounds.add(empty, 0)
    for hop in range(1, deepest + 1):
        step = nodes.where(F.col("k") >= hop).withColumnRenamed("dst_id", "src_id").join(adjacency, ["wid", "src_id"]).where(~F.array_contains("path", F.col("dst_id")))
        path = F.concat("path", F.array("src_id"))
        order = Window.partitionBy("wid", "vertex_id", "h", "k", path).orderBy(F.md5(F.concat_ws(">", F.lit(str(seed)), path, F.col("dst_id"))), "dst_id")
        taken = step.withColumn("r", F.row_number().over(order)).where(F.col("r") <= F.col("h"))
        level = rounds.add(taken.select("wid", "vertex_id", "h", "k", F.lit(hop).alias("hop"), "src_id", "dst_id", path.alias("path")), hop)
        nodes = level.select("wid", "vertex_id", "h", "k", "dst_id", "path")
    adjacency.unpersist()
    return _asked(rounds.all(), queries, "h", "k").select(*KEY, "vertex_id", "hop", "src_id", "dst_id", "path")


def pagerank(graphs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wid, iteration, vertex_id, rank`` of rounds 1 to ``iterations`` for each ``(wid, iterations)``; vertices of the window only.

    PR'(v) = (1 - d) + d * sum of PR(u) w(u, v) / W(u), all vertices at once; 1.0 before the first round, 1 - d
    for a vertex without in-edges. The mass of a vertex without out-edges is dropped.
    """
    base = 1 - DAMPING
    total = F.sum("weight").over(Window.partitionBy("wid", "src_id"))
    links = _dealt(graphs.join(wanted.select("wid").distinct(), "wid", "left_semi"), "wid", "src_id", "dst_id", F.when(total != 0, F.col("weight") / total).otherwise(0.0).alias("part"))
    most = wanted.groupBy("wid").agg(F.max("iterations").alias("n"))
    sides = F.array(F.struct(F.col("src_id").alias("vertex_id"), F.lit(False).alias("has_in")), F.struct(F.col("dst_id").alias("vertex_id"), F.lit(True).alias("has_in")))
    ids = links.select("wid", F.explode(sides).alias("side")).groupBy("wid", "side.vertex_id").agg(F.max("side.has_in").alias("has_in"))
    ids = Rounds(graphs.sparkSession, "vertices").add(ids.join(most, "wid").select("wid", "vertex_id", "has_in", "n"), 0)
    rounds = Rounds(graphs.sparkSession, "ranks")
    ranks = rounds.add(ids.select("wid", F.lit(0).alias("iteration"), "vertex_id", F.when(F.col("has_in"), 1.0).otherwise(base).alias("rank")), 0)
    for i in range(1, (most.agg(F.max("n")).first()[0] or 0) + 1):
        gained = links.join(ranks.select("wid", F.col("vertex_id").alias("src_id"), "rank"), ["wid", "src_id"]).select("wid", F.col("dst_id").alias("vertex_id"), (F.col("rank") * F.col("part")).alias("gain"), F.lit(False).alias("wanted"))
        # a row of no gain for every vertex of the windows that go on
        every = ids.where(F.col("n") >= i).select("wid", "vertex_id", F.lit(0.0), F.lit(True))
        summed = gained.union(every).groupBy("wid", "vertex_id").agg(F.sum("gain").alias("gain"), F.max("wanted").alias("wanted")).where("wanted")
        ranks = rounds.add(summed.select("wid", F.lit(i).alias("iteration"), "vertex_id", (base + DAMPING * F.col("gain")).alias("rank")), i)
    links.unpersist()
    return rounds.all().where("iteration > 0")
