"""What a round costs follows the graph, not the session's settings; results stay those of plain code."""

import datetime
import itertools
import random

import pytest

from tidegraph import catalog
from tidegraph.operators import graph

GRAPH = "wid long, src_id string, dst_id string, weight double"


@pytest.fixture
def tasks(spark):
    """Runs a query with 60 shuffle partitions; its result and the tasks its jobs had."""
    names = ["spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold"]
    before = {n: spark.conf.get(n) for n in names}
    sc = spark.sparkContext

    def count(query, group):
        sc.setJobGroup(group, group)
        out = query()
        jobs = [sc.statusTracker().getJobInfo(j) for j in sc.statusTracker().getJobIdsForGroup(group)]
        stages = {s for j in jobs if j for s in j.stageIds}
        return out, sum(info.numCompletedTasks for s in stages if (info := sc.statusTracker().getStageInfo(s)))

    for n, v in zip(names, ("60", "-1")):
        spark.conf.set(n, v)
    yield count
    for n, v in before.items():
        spark.conf.set(n, v)
    sc.setJobGroup("", "")


def ring(spark, n=12):
    return spark.createDataFrame([(1, str(i), str((i + k) % n), float(k)) for i in range(n) for k in (1, 2, 3)], GRAPH).coalesce(1)


def test_pagerank_tasks(spark, tasks):
    wanted = spark.createDataFrame([(1, 5)], "wid long, iterations int").coalesce(1)
    rows, n = tasks(lambda: graph.pagerank(ring(spark), wanted).collect(), "pagerank")
    assert len(rows) == 60 and all(abs(r.rank - 1) < 1e-9 for r in rows)
    assert n < 200


def test_hand_over_across_days(spark, tmp_path):
    """Days without events, events of one moment, missing types, times and users."""
    day = lambda d, s=0: datetime.datetime(2023, 12, 30) + datetime.timedelta(days=d, seconds=s)
    rows = [(i, day(d, s), u, t, 1.0) for i, (d, s, u, t) in enumerate([(5, 0, 1, "a"), (0, 3, 2, "a"), (0, 3, 3, "a"), (9, 0, 4, "a"), (9, 0, None, "a"), (40, 1, 5, "a"), (1, 0, 6, None), (7, 0, 7, None), (3, 0, 8, "b"), (5, 86399, 9, "a"), (6, 0, 10, "a"), (6, 0, 10, "a")])]
    rows += [(50, None, 11, "a", 1.0), (51, None, 12, "a", 1.0)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = sorted((r.seq, r.src_id, r.dst_id) for r in catalog.graph_a(spark, str(tmp_path)).collect())
    order = sorted(rows, key=lambda r: (r[3] or "", r[1] is not None, r[1] or day(0), r[0]))
    assert got == sorted((a[0], str(a[2]) if a[2] is not None else None, str(b[2])) for a, b in itertools.pairwise(order) if a[3] == b[3] and b[2] is not None)


def test_algorithms_tasks(spark, tasks):
    """Rounds of walks, paths and trees: dealt links aren't read by 60 tasks."""
    g = ring(spark)
    start = spark.sql("SELECT '1' query_id, '1' user_id, 1L wid, '0' vertex_id, 2 h, 3 k").coalesce(1)
    for name, query, most in [("reach", graph.reachable, 60), ("strong", graph.strongly_connected, 110), ("paths", graph.shortest_paths, 120), ("tree", graph.sampled_tree, 60)]:
        rows, n = tasks(lambda q=query: q(g, start).collect(), name)
        assert len(rows) == {"reach": 12, "strong": 12, "paths": 11, "tree": 14}[name] and n < most


def plain_paths(links, start):
    """Best (distance, hops, path) by rounds in which every improved vertex is expanded."""
    best, frontier, out = {start: (0.0, 0, [start])}, [start], {}
    for (a, b), w in links.items():
        out.setdefault(a, []).append((b, w))
    while frontier:
        found = {}
        for u in frontier:
            d, h, p = best[u]
            for v, w in out.get(u, ()):
                if v not in p:
                    found[v] = min(found.get(v, (d + w, h + 1, p + [v])), (d + w, h + 1, p + [v]))
        frontier = [v for v, x in found.items() if v not in best or x < best[v]]
        best |= {v: found[v] for v in frontier}
    return {v: x for v, x in best.items() if v != start}


@pytest.mark.parametrize("weights", [[0.1, 0.2, 0.3, 0.7], [0.0, 1.0], [1.0, 40.0, 500.0]])
def test_paths_with_bound(spark, weights):
    """Random links, ties, weights of 0, two starts, of which one reaches few."""
    rng = random.Random(len(weights))
    links = {(str(a), str(b)): rng.choice(weights) for a in range(60) for b in rng.sample(range(60), 4) if a != b}
    links |= {("x", "y"): 900.0, ("y", "z"): 0.1, ("x", "z"): 901.0, ("z", "x"): 5.0}
    g = spark.createDataFrame([(1, a, b, w) for (a, b), w in links.items()], GRAPH)
    asked = spark.createDataFrame([("1", "1", 1, "0"), ("2", "1", 1, "x")], "query_id string, user_id string, wid long, vertex_id string")
    got = {(r.vertex_id, r.target_id): (r.distance, r.path) for r in graph.shortest_paths(g, asked).collect()}
    want = {(s, v): (x[0], x[2]) for s in ("0", "x") for v, x in plain_paths(links, s).items()}
    assert got == want


def test_path_rounds_read_best_labels_only(spark, monkeypatch):
    """No round reads the labels of all rounds before it."""
    read = []
    everything = graph.Rounds.all
    monkeypatch.setattr(graph.Rounds, "all", lambda self: read.append(self.root) or everything(self))
    start = spark.sql("SELECT '1' query_id, '1' user_id, 1L wid, '0' vertex_id")
    assert graph.shortest_paths(ring(spark), start).count() == 11
    assert not read
