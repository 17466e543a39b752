"""Registered queries over the driver's tables, with their SQL.

Graph A hands a user over to the next one of the same event type; graph B joins customers with suppliers of their
orders. Ids are text in the library and numbers in the results here. Every query reads its whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegraph.functions import text
from tidegraph.operators import graph, state, windows
from tidegraph.plans.engine import Engine
from tidegraph.sources import edges as source
from tidegraph.storage import LogConfig, Rounds, read_window, shared_dir, write_log

LAYOUTS = {k: LogConfig(paradigm=k, interval=3600) for k in (1, 2, 3, 4)}
FROM, HOPS, ROUNDS = "8", 3, 10

A = """WITH RECURSIVE ev AS (SELECT event_id, user_id, value, ts, lead(user_id) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS nxt FROM events),
a AS (SELECT user_id AS src_id, nxt AS dst_id, value AS weight, CAST(floor(epoch(ts) - epoch(TIMESTAMP '2024-01-01 00:00:00')) AS BIGINT) AS timestamp, event_id AS seq FROM ev WHERE nxt IS NOT NULL),
adj AS (SELECT src_id, dst_id, arg_max(weight, seq) AS weight FROM a GROUP BY src_id, dst_id)"""


def graph_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A type's events are put in order day by day, each day ended by the first user of the type's next one."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")
    events = events.withColumn("day", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86_400_000_000)).withColumn("ends", F.lit(False))
    first = events.groupBy("event_type", "day").agg(F.min_by("user_id", F.struct("ts", "event_id")).alias("user_id"))
    ends = first.withColumn("user_id", F.lead("user_id").over(Window.partitionBy("event_type").orderBy("day"))).withColumn("ends", F.lit(True))
    following = F.lead("user_id").over(Window.partitionBy("event_type", "day").orderBy("ends", "ts", "event_id"))
    seconds = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000) - F.unix_timestamp(F.lit("2024-01-01 00:00:00"))
    rows = events.unionByName(ends, allowMissingColumns=True).select("ends", F.col("user_id").cast("string").alias("src_id"), following.cast("string").alias("dst_id"), F.col("value").alias("weight"), seconds.cast("long").alias("timestamp"), F.col("event_id").alias("seq"))
    return rows.where("not ends and dst_id is not null").drop("ends")


def logged_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graph A as a table, for queries that read it more than once."""
    return Rounds(spark, "edges").add(graph_a(spark, sf_dir), 0)


def graph_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_suppkey", "l_linenumber", "l_quantity")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(F.col("o_custkey").cast("string").alias("src_id"), (F.col("l_suppkey") + 1_000_000).cast("string").alias("dst_id"), F.col("l_quantity").cast("double").alias("weight"), F.datediff("o_orderdate", F.lit("1995-01-01")).cast("long").alias("timestamp"), (F.col("l_orderkey") * 16 + F.col("l_linenumber")).cast("long").alias("seq"))


def _numbers(df: DataFrame) -> DataFrame:
    """Ids as numbers, doubles rounded to six places."""
    out = []
    for f in df.schema:
        c = F.col(f.name)
        out.append(c.cast("long").alias(f.name) if f.name.endswith("_id") else F.round(c, 6).alias(f.name) if f.dataType.simpleString() == "double" else c)
    return df.select(out)


def _span(edges: DataFrame) -> tuple[int, int]:
    """First and last timestamp; an empty window if there is no edge."""
    lo, hi = edges.agg(F.min("timestamp"), F.max("timestamp")).first()
    return (0, -1) if lo is None else (lo, hi)


def _graph(edges: DataFrame, config: LogConfig = LAYOUTS[1]) -> DataFrame:
    """The edges' graph with one ``wid``."""
    return state.weighted_neighbours(edges, config).withColumn("wid", F.lit(1).cast("long"))


def _one(spark: SparkSession, vertex: str = FROM, more: str = "") -> DataFrame:
    return spark.sql(f"SELECT '1' query_id, '1' user_id, 1L wid, '{vertex}' vertex_id{more}")


CATALOG: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def entry(sql: str | None = None):
    def add(query):
        CATALOG[query.__name__] = (query, sql)
        return query

    return add


@entry(A + "SELECT src_id, dst_id, round(weight, 6) AS weight, timestamp, seq FROM a")
def s3_edge_decode(spark, sf_dir):
    lines = source.to_edge_json(graph_a(spark, sf_dir))
    return _numbers(source.typed_edges(lines.select(F.from_json("value", source.EDGE_WIRE).alias("e"), "seq").select("e.*", "seq"), F.col("seq")))


@entry("SELECT o_orderkey AS query_id, o_custkey AS user_id, o_custkey % 100 AS vertex_id, 'gnn-sampling' AS query_type, CAST(0 AS BIGINT) AS start_t, CAST(o_custkey AS BIGINT) AS end_t, 2 AS h FROM orders")
def s4_query_decode(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    wire = F.to_json(F.struct(F.col("o_orderkey").cast("string").alias("query_id"), F.col("o_custkey").cast("string").alias("user_id"), (F.col("o_custkey") % 100).cast("string").alias("vertex_id"), F.lit("gnn-sampling").alias("query_type"), F.col("o_custkey").cast("string").alias("end_t"), F.create_map(F.lit("h"), F.lit("2")).alias("parameter_map")))
    return _numbers(source.queries_from_json(o.select(wire.alias("value"))).select("query_id", "user_id", "vertex_id", "query_type", "start_t", "end_t", F.col("parameter_map")["h"].cast("int").alias("h")))


@entry(A + "SELECT src_id AS key_id, dst_id, timestamp FROM a")
def s6_keyed_text(spark, sf_dir):
    lines = source.to_edge_json(graph_a(spark, sf_dir)).select(F.concat(F.get_json_object("value", "$.src_id"), F.lit(": "), F.col("value")).alias("value"))
    pairs = source.unkeyed(lines).select(F.col("key").alias("key_id"), F.from_json("value", source.EDGE_WIRE).alias("e"))
    return _numbers(pairs.select("key_id", "e.dst_id", F.col("e.timestamp").cast("long").alias("timestamp")))


@entry(A + "SELECT src_id, dst_id, timestamp FROM a UNION ALL SELECT dst_id, src_id, timestamp FROM a")
def s7_raw_edge_list(spark, sf_dir):
    lines = graph_a(spark, sf_dir).select(F.concat_ws(" ", "src_id", "dst_id", F.col("timestamp").cast("string")).alias("value"))
    return _numbers(source.raw_edge_list(lines, mirror=True).select("src_id", "dst_id", "timestamp"))


@entry("SELECT CAST(200000 AS BIGINT) AS n_edges, CAST(100000 AS BIGINT) AS n_times, TRUE AS in_range, CAST(100000 AS BIGINT) AS from_hub")
def s8_synthetic_edges(spark, sf_dir):
    e = source.synthetic_edges(spark)
    return e.agg(F.count("*").alias("n_edges"), F.countDistinct("timestamp").alias("n_times"), F.bool_and(F.col("timestamp").between(0, 529_999)).alias("in_range"), F.count(F.when(F.col("seq") % 2 == 0, 1)).alias("from_hub"))


@entry("SELECT CAST(20 * k + v + 1 AS BIGINT) AS query_id, CAST(v + 1 AS BIGINT) AS vertex_id, 'connected-components' AS query_type, CAST(0 AS BIGINT) AS start_t, CAST(power(10, k + 2) AS BIGINT) AS end_t FROM range(20) AS r(v), range(5) AS s(k)")
def s9_growing_windows(spark, sf_dir):
    return _numbers(source.growing_window_queries(spark).select("query_id", "vertex_id", "query_type", "start_t", "end_t"))


@entry("SELECT CAST(i + 1 AS BIGINT) AS query_id, 'all' AS vertex, 'pagerank' AS query_type, CAST(0 AS BIGINT) AS start_t, CAST(100000 AS BIGINT) AS end_t, '10' AS iterations FROM range(100) AS r(i)")
def s10_fixed_window(spark, sf_dir):
    return _numbers(source.fixed_window_queries(spark).select("query_id", F.col("vertex_id").alias("vertex"), "query_type", "start_t", "end_t", F.col("parameter_map")["iterations"].alias("iterations")))


@entry(A + "SELECT src_id AS vertex_id, 'add' AS activity_type, src_id, dst_id, timestamp, FALSE AS ingoing FROM a UNION ALL SELECT dst_id, 'add', src_id, dst_id, timestamp, TRUE FROM a")
def p1_p2_activities(spark, sf_dir):
    return _numbers(state.activities(graph_a(spark, sf_dir)).select("vertex_id", "activity_type", "src_id", "dst_id", "timestamp", "ingoing"))


@entry(A + "SELECT src_id AS vertex_id, count(*) AS n FROM a GROUP BY src_id")
def p4_outgoing(spark, sf_dir):
    return _numbers(state.outgoing(state.activities(graph_a(spark, sf_dir))).groupBy("vertex_id").agg(F.count("*").alias("n")))


@entry(A + "SELECT dst_id AS vertex_id, count(*) AS n FROM a GROUP BY dst_id")
def p5_ingoing(spark, sf_dir):
    return _numbers(state.ingoing(state.activities(graph_a(spark, sf_dir))).groupBy("vertex_id").agg(F.count("*").alias("n")))


def _layout(paradigm: int):
    def query(spark, sf_dir):
        path = f"{shared_dir(spark)}/log-{paradigm}-{abs(hash((sf_dir, id(spark))))}"
        write_log(graph_a(spark, sf_dir), path, LAYOUTS[paradigm], "overwrite")
        return _numbers(read_window(spark, path, LAYOUTS[paradigm], 3000, 90000))

    query.__name__ = f"p3{'_abcd'[paradigm]}_window_filter"
    return entry(A + "SELECT src_id, dst_id, round(weight, 6) AS weight, timestamp, seq FROM a WHERE timestamp BETWEEN 3000 AND 90000")(query)


for _k in LAYOUTS:
    _layout(_k)


@entry(A + "SELECT CAST(floor(timestamp / 3600) AS BIGINT) AS bucket, count(*) AS n_edges FROM a GROUP BY 1")
def p8_a14_buckets(spark, sf_dir):
    return state.bucket_counts(graph_a(spark, sf_dir), LAYOUTS[4])


@entry(A + "SELECT DISTINCT src_id, dst_id FROM a")
def a1_out_neighbours(spark, sf_dir):
    return _numbers(state.out_neighbours(graph_a(spark, sf_dir)))


def _weights(paradigm: int, order: str):
    def query(spark, sf_dir):
        return _numbers(state.weighted_neighbours(graph_b(spark, sf_dir), LAYOUTS[paradigm]).select("src_id", "dst_id", "weight"))

    query.__name__ = f"a2_weights_layout_{paradigm}"
    return entry(f"""WITH b AS (SELECT o_custkey AS src_id, 1000000 + l_suppkey AS dst_id, CAST(l_quantity AS DOUBLE) AS weight, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS t, l_orderkey * 16 + l_linenumber AS seq FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
r AS (SELECT *, row_number() OVER (PARTITION BY src_id, dst_id ORDER BY {order}) AS k FROM b)
SELECT src_id, dst_id, round(weight, 6) AS weight FROM r WHERE k = 1""")(query)


_weights(1, "seq DESC, weight DESC")
_weights(2, "t DESC, seq DESC, weight DESC")
_weights(4, "floor(t / 3600) DESC, seq DESC, weight DESC")


@entry(A + "SELECT dst_id AS vertex_id, count(DISTINCT src_id) AS in_degree FROM a GROUP BY dst_id")
def a3_in_degree(spark, sf_dir):
    return _numbers(state.in_degree(graph_a(spark, sf_dir)))


@entry(A + "SELECT src_id, dst_id, round(weight, 6) AS weight, round(sum(weight) OVER (PARTITION BY src_id), 6) AS weight_sum FROM adj")
def a4_weight_sum(spark, sf_dir):
    return _numbers(state.with_weight_sum(_graph(graph_a(spark, sf_dir))).select("src_id", "dst_id", "weight", "weight_sum"))


@entry(A + "SELECT src_id AS vertex_id FROM a UNION SELECT dst_id FROM a")
def a11_vertex_ids(spark, sf_dir):
    return _numbers(state.vertex_ids(graph_a(spark, sf_dir)))


@entry("SELECT event_id, count(*) OVER o AS record_number, CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER o AS BIGINT) AS overall_time, round(CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER o AS DOUBLE) / count(*) OVER o, 3) AS average_time FROM events WINDOW o AS (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING)")
def a12_running_stats(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    out = state.running_stats(events, "cents", ["event_id"], ["event_type"])
    return out.select("event_id", "record_number", "overall_time", F.round("average_time", 3).alias("average_time"))


@entry(A + "SELECT seq, row_number() OVER (PARTITION BY src_id ORDER BY timestamp, CAST(src_id AS VARCHAR), CAST(dst_id AS VARCHAR), seq) AS place FROM a")
def o1_activity_order(spark, sf_dir):
    return state.activity_rank(state.activities(graph_a(spark, sf_dir), store_ingoing=False)).select("seq", F.col("place").cast("long").alias("place"))


@entry("SELECT event_id, round(cume_dist() OVER (PARTITION BY event_type ORDER BY value), 6) AS fraction FROM events")
def o7_latency_cdf(spark, sf_dir):
    return state.latency_cdf(spark.read.parquet(f"{sf_dir}/events.parquet"), "value", ["event_type"]).select("event_id", F.round("fraction", 6).alias("fraction"))


@entry("WITH l AS (SELECT log10(value) AS l FROM events WHERE value > 0), b AS (SELECT min(l) AS lo, max(l) AS hi FROM l) SELECT CAST(least(floor((l - lo) / ((hi - lo) / 10)), 9) AS BIGINT) AS bin, count(*) AS n FROM l, b GROUP BY 1")
def o8_latency_histogram(spark, sf_dir):
    return state.latency_histogram(spark.read.parquet(f"{sf_dir}/events.parquet"), "value")


@entry(A + ", q AS (SELECT i AS window_id, 3600 * i AS s, 3600 * i + 9000 AS t FROM (SELECT unnest(range((SELECT CAST(max(timestamp) // 3600 + 1 AS BIGINT) FROM a))) AS i) AS r) SELECT window_id, count(*) AS n, round(sum(weight), 4) AS total FROM a JOIN q ON timestamp BETWEEN s AND t GROUP BY window_id")
def j8_window_join(spark, sf_dir):
    edges = logged_a(spark, sf_dir)
    asked = spark.range(_span(edges)[1] // 3600 + 1).select(F.col("id").alias("wid"), (F.col("id") * 3600).alias("start_t"), (F.col("id") * 3600 + 9000).alias("end_t"))
    found = windows.window_edges(edges, asked, LAYOUTS[4])
    return found.groupBy(F.col("wid").alias("window_id")).agg(F.count("*").alias("n"), F.round(F.sum("weight"), 4).alias("total"))


REACH = A + """, reach(id) AS (SELECT 8 WHERE EXISTS (SELECT 1 FROM adj WHERE src_id = 8) UNION SELECT adj.dst_id FROM reach JOIN adj ON adj.src_id = reach.id)"""


@entry(REACH + " SELECT (SELECT min(id) FROM reach) AS component_id, id AS member_id FROM reach")
def g1_connected_components(spark, sf_dir):
    return _numbers(graph.component_of(graph.reachable(_graph(graph_a(spark, sf_dir)), _one(spark))).select("component_id", "member_id"))


@entry(A + """, both_ways AS (SELECT src_id, dst_id FROM adj UNION SELECT dst_id, src_id FROM adj),
reach(id) AS (SELECT 8 WHERE EXISTS (SELECT 1 FROM both_ways WHERE src_id = 8) UNION SELECT m.dst_id FROM reach JOIN both_ways m ON m.src_id = reach.id)
SELECT (SELECT min(id) FROM reach) AS component_id, id AS member_id FROM reach""")
def g1_undirected_components(spark, sf_dir):
    return _numbers(graph.component_of(graph.reachable(_graph(graph_a(spark, sf_dir)), _one(spark), directed=False)).select("component_id", "member_id"))


@entry(REACH + """, back(id) AS (SELECT 8 WHERE EXISTS (SELECT 1 FROM adj WHERE src_id = 8) UNION SELECT adj.src_id FROM back JOIN adj ON adj.dst_id = back.id),
s AS (SELECT id FROM reach INTERSECT SELECT id FROM back) SELECT (SELECT min(id) FROM s) AS component_id, id AS member_id FROM s""")
def g2_strong_components(spark, sf_dir):
    return _numbers(graph.component_of(graph.strongly_connected(_graph(graph_a(spark, sf_dir)), _one(spark))).select("component_id", "member_id"))


@entry(A + """, p(id, best) USING KEY (id) AS (SELECT 8, {'d': CAST(0 AS DOUBLE), 'hops': 0, 'path': ['8']} UNION SELECT adj.dst_id, min({'d': p.best.d + adj.weight, 'hops': p.best.hops + 1, 'path': list_append(p.best.path, CAST(adj.dst_id AS VARCHAR))}) AS best
FROM p JOIN adj ON adj.src_id = p.id LEFT JOIN recurring.p AS old ON old.id = adj.dst_id WHERE NOT list_contains(p.best.path, CAST(adj.dst_id AS VARCHAR)) AND (old.best IS NULL OR {'d': p.best.d + adj.weight, 'hops': p.best.hops + 1, 'path': list_append(p.best.path, CAST(adj.dst_id AS VARCHAR))} < old.best) GROUP BY adj.dst_id)
SELECT id AS target_id, round(best.d, 6) AS distance, array_to_string(best.path, '>') AS path FROM p WHERE id <> 8""")
def g3_shortest_paths(spark, sf_dir):
    return _numbers(graph.shortest_paths(_graph(graph_a(spark, sf_dir)), _one(spark)).select("target_id", "distance", F.array_join("path", ">").alias("path")))


@entry(A + """, t AS (SELECT 1 AS hop, src_id, dst_id, [src_id] AS path FROM adj WHERE src_id = 8
UNION ALL SELECT t.hop + 1, adj.src_id, adj.dst_id, list_append(t.path, adj.src_id) FROM t JOIN adj ON adj.src_id = t.dst_id WHERE t.hop < 3 AND NOT list_contains(t.path, adj.dst_id))
SELECT hop, src_id, dst_id FROM t""")
def g4_full_expansion(spark, sf_dir):
    return _numbers(graph.sampled_tree(_graph(graph_a(spark, sf_dir)), _one(spark, more=f", 1000000 h, {HOPS} k")).select("hop", "src_id", "dst_id"))


@entry(A + """, t AS (SELECT 0 AS hop, CAST(NULL AS BIGINT) AS src_id, id AS dst_id, CAST([] AS VARCHAR[]) AS path FROM (SELECT DISTINCT src_id AS id FROM a)
UNION ALL SELECT hop, src_id, dst_id, path FROM (SELECT t.hop + 1 AS hop, adj.src_id, adj.dst_id, list_append(t.path, CAST(adj.src_id AS VARCHAR)) AS path, row_number() OVER (PARTITION BY list_append(t.path, CAST(adj.src_id AS VARCHAR)) ORDER BY md5('0>' || array_to_string(t.path, '>') || CASE WHEN t.hop > 0 THEN '>' ELSE '' END || adj.src_id || '>' || adj.dst_id), CAST(adj.dst_id AS VARCHAR)) AS r
FROM t JOIN adj ON adj.src_id = t.dst_id WHERE t.hop < 3 AND NOT list_contains(t.path, CAST(adj.dst_id AS VARCHAR))) WHERE r <= 2)
SELECT CAST(path[1] AS BIGINT) AS vertex_id, hop, src_id, dst_id, array_to_string(path, '>') AS path FROM t WHERE hop > 0""")
def o3_seeded_sample(spark, sf_dir):
    """The tree of every vertex that has an out-edge."""
    g = _graph(graph_a(spark, sf_dir))
    asked = g.select(F.col("src_id").alias("query_id"), F.lit("1").alias("user_id"), "wid", F.col("src_id").alias("vertex_id"), F.lit(2).alias("h"), F.lit(HOPS).alias("k")).distinct()
    return _numbers(graph.sampled_tree(g, asked).select("vertex_id", "hop", "src_id", "dst_id", F.array_join("path", ">").alias("path")))


def _pagerank_sql() -> str:
    """One CTE per round, so each is a plain join and sum."""
    sql = A + """, share AS (SELECT src_id, dst_id, CASE WHEN sum(weight) OVER (PARTITION BY src_id) = 0 THEN 0 ELSE weight / sum(weight) OVER (PARTITION BY src_id) END AS part FROM adj),
ids AS (SELECT src_id AS id FROM adj UNION SELECT dst_id FROM adj),
r0 AS (SELECT id, CASE WHEN id IN (SELECT dst_id FROM adj) THEN 1.0 ELSE 1 - CAST(0.85 AS DOUBLE) END AS rank FROM ids)"""
    for i in range(1, ROUNDS + 1):
        sql += f""",
g{i} AS (SELECT dst_id, sum(rank * part) AS gain FROM share JOIN r{i - 1} ON id = src_id GROUP BY dst_id),
r{i} AS (SELECT id, (1 - CAST(0.85 AS DOUBLE)) + CAST(0.85 AS DOUBLE) * coalesce(gain, 0) AS rank FROM ids LEFT JOIN g{i} ON id = dst_id)"""
    return sql


@entry(_pagerank_sql() + f", everyone AS (SELECT src_id AS vertex_id FROM a UNION SELECT dst_id FROM a) SELECT vertex_id, round(rank, 6) AS rank FROM everyone LEFT JOIN r{ROUNDS} ON id = vertex_id")
def g5_j5_pagerank(spark, sf_dir):
    edges = logged_a(spark, sf_dir)
    ranks = graph.pagerank(_graph(edges), spark.sql(f"SELECT 1L wid, {ROUNDS} iterations")).where(F.col("iteration") == ROUNDS)
    return _numbers(state.vertex_ids(edges).join(ranks, "vertex_id", "left").select("vertex_id", "rank"))


@entry(_pagerank_sql() + " SELECT count(*) AS n, round(sum(rank), 4) AS total FROM r1")
def a5_first_round(spark, sf_dir):
    ranks = graph.pagerank(_graph(graph_a(spark, sf_dir)), spark.sql("SELECT 1L wid, 1 iterations"))
    return ranks.agg(F.count("*").alias("n"), F.round(F.sum("rank"), 4).alias("total"))


@entry("""WITH RECURSIVE adj AS (SELECT DISTINCT o_custkey AS src_id, 1000000 + l_suppkey AS dst_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
reach(id) AS (SELECT 8 WHERE EXISTS (SELECT 1 FROM adj WHERE src_id = 8) UNION SELECT adj.dst_id FROM reach JOIN adj ON adj.src_id = reach.id)
SELECT id AS vertex_id FROM (SELECT src_id AS id FROM adj UNION SELECT dst_id FROM adj) v WHERE id NOT IN (SELECT id FROM reach)""")
def e2_p12_unreached(spark, sf_dir):
    g = _graph(graph_b(spark, sf_dir))
    members = graph.reachable(g, _one(spark)).select(F.col("member_id").alias("vertex_id"))
    return _numbers(state.vertex_ids(g).join(members, "vertex_id", "left_anti"))


def _batch(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """Ten queries, those that can be answered over the time span of all edges."""
    lo, hi = _span(edges)
    rows = [("1", "8", "connected-components", lo, hi, None), ("2", "8", "connected-components", lo, hi, None), ("3", "8", "strongly-connected-components", lo, hi, None), ("4", "8", "single-source-shortest-path", lo, hi, None), ("5", "8", "gnn-sampling", lo, hi, {"h": "1000", "k": "2"}), ("6", "all", "pagerank", lo, hi, {"iterations": "2"}), ("7", "8", "connected-components", 9, 3, None), ("8", "8", "triangles", 0, 9, None), ("9", "8", "pagerank", 0, 9, {"iterations": "2"}), ("10", "8", "gnn-sampling", 0, 9, {"h": "0", "k": "2"})]
    return spark.createDataFrame([(q, "1", v, t, s, e, p) for q, v, t, s, e, p in rows], "query_id string, user_id string, vertex_id string, query_type string, start_t long, end_t long, parameter_map map<string,string>")


@entry("SELECT CAST(q AS BIGINT) AS query_id, s AS status FROM (VALUES (1, 'ok'), (2, 'ok'), (3, 'ok'), (4, 'ok'), (5, 'ok'), (6, 'ok'), (7, 'isolated'), (8, 'error'), (9, 'error'), (10, 'error')) AS t(q, s)")
def p6_p7_p9_engine_status(spark, sf_dir):
    edges = logged_a(spark, sf_dir)
    return _numbers(Engine(LAYOUTS[1]).answer(edges, _batch(spark, edges)).select("query_id", "status"))


@entry()
def k1_f1_result_records(spark, sf_dir):
    edges = logged_a(spark, sf_dir)
    answers = Engine(LAYOUTS[1]).answer(edges, _batch(spark, edges))
    return answers.select(*text.egress(F.col("result"), F.lit(0)))


@entry(REACH + """ SELECT '1 1' AS key, '{"result_string":"Result of query 1 by user 1: connected component id of node 8 is ' || min(id) || '. All node ids that contain in the same component are:[' || string_agg(id, ', ' ORDER BY id) || ']","time":"0"}' AS value FROM reach""")
def k1_component_record(spark, sf_dir):
    edges = logged_a(spark, sf_dir)
    answers = Engine(LAYOUTS[1]).answer(edges, _batch(spark, edges).where("query_id = '1'"))
    return answers.select(*text.egress(F.col("result"), F.lit(0)))


@entry("""WITH m AS (SELECT event_id, event_type, CAST(round(value * 100) AS BIGINT) AS t FROM events),
s AS (SELECT event_type, t, count(*) OVER o AS n, CAST(sum(t) OVER o AS BIGINT) AS total FROM m WINDOW o AS (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING))
SELECT event_type, CAST(n AS VARCHAR) AS key, '{"time":"' || t || '","overall_time":"' || total || '","average_time":"' AS value FROM s""")
def k2_k3_metric_records(spark, sf_dir):
    """Without the average, whose last digit rounds differently here and there."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    records = state.metric_records(events, "cents", ["event_id"], ["event_type"])
    return records.select("event_type", "key", F.regexp_replace("value", r'(average_time":")[^"]*"\}$', "$1").alias("value"))


@entry("""WITH f AS (SELECT event_type, value, cume_dist() OVER (PARTITION BY event_type ORDER BY value) AS fraction FROM events), s AS (SELECT unnest([0.9, 0.99])::DOUBLE AS share)
SELECT event_type, share, round(min(value), 6) AS value FROM f JOIN s ON fraction >= share GROUP BY event_type, share""")
def o7_latency_marks(spark, sf_dir):
    return state.latency_marks(spark.read.parquet(f"{sf_dir}/events.parquet"), "value", ["event_type"]).select("event_type", "share", F.round("value", 6).alias("value"))


@entry("SELECT CAST(i AS BIGINT) AS query_id, CAST(2 AS BIGINT) AS n FROM range(1, 3) AS r(i)")
def j6_result_history(spark, sf_dir):
    edges = logged_a(spark, sf_dir)
    engine, asked = Engine(LAYOUTS[1]), _batch(spark, edges).where("query_id IN ('1', '2')")
    engine.answer(edges, asked, 1)
    results = engine.answer(edges, asked, 2)
    return _numbers(engine.with_history(results).where("result = earlier").groupBy("query_id").agg(F.count("*").alias("n")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in CATALOG.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in CATALOG.items() if sql}
