"""Example graphs and queries with the values expected of them."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidegraph.plans.engine import Engine
from tidegraph.sources.edges import read_edges, read_queries
from tidegraph.storage import LogConfig

DATA = Path(__file__).parent / "fixtures"


def answers(spark, edges, queries, config=LogConfig(paradigm=1)):
    rows = Engine(config).answer(read_edges(spark, str(DATA / f"{edges}.txt")), read_queries(spark, str(DATA / f"{queries}.txt"))).collect()
    return {int(r.query_id): r for r in rows}


def component(row):
    m = re.search(r"component id of node \S+ is (\S+)\. .*:\[(.*)\]", row.result)
    return m[1], m[2].split(", ")


def strong(row):
    m = re.search(r"component id of node \S+ is (\S+)\. .*are:  (.*)$", row.result)
    return m[1], m[2].split()


def paths(row):
    return {v: (float(d), p.replace(", ", ">")) for v, d, p in re.findall(r"id: (\S+) distance: (\S+) path: \[(.*?)\];", row.result)}


def bag(row):
    return sorted(row.result.split("are: ")[1].split())


@pytest.fixture(scope="module")
def demo(spark):
    return answers(spark, "demo_edges", "demo_query")


def test_demo_components(demo):
    assert component(demo[1]) == ("1", ["1", "3", "6", "7", "8"])
    for q in (5, 8):
        assert component(demo[q]) == ("1", ["1", "3", "4", "6", "7", "8", "9"])


def test_demo_paths(demo):
    assert paths(demo[2]) == {"1": (20, "3>8>6>1"), "6": (15, "3>8>6"), "7": (15, "3>8>7"), "8": (5, "3>8")}
    assert paths(demo[9]) == {"1": (10, "7>6>1"), "3": (15, "7>8>3"), "4": (5, "7>4"), "6": (5, "7>6"), "8": (10, "7>8"), "9": (5, "7>9")}


def test_demo_samples(demo):
    for q in (3, 7):
        assert {"3->6", "3->8"} <= set(bag(demo[q])) <= {"3->6", "3->8", "6->1", "6->7", "6->8", "8->6", "8->7"}
    assert set(bag(demo[10])) <= {"6->1", "6->3", "6->8", "7->4", "7->6", "7->8", "7->9", "8->3", "8->6"}


def ranks(row, iteration):
    part = re.search(rf"[{{ ]{iteration}={{(.*?)}}", row.result)[1]
    return {k: None if v == "null" else round(float(v), 6) for k, v in (x.split("=") for x in part.split(", "))}


def test_demo_ranks(demo):
    assert ranks(demo[4], 1) == {"1": 0.25625, "2": 1, "3": 0.745, "4": 0.32, "5": 1, "6": 2.19, "7": 2.29625, "8": 0.8725, "9": 0.32}
    assert ranks(demo[4], 10) == {"1": 0.356143, "2": 1, "3": 1.187358, "4": 0.40115, "5": 1, "6": 1.934747, "7": 1.453252, "8": 1.266199, "9": 0.40115}


def test_components(spark):
    one = answers(spark, "example_cc_edges_1", "query_cc_1")
    assert component(one[1]) == ("0", list("0123")) and component(one[2]) == ("4", list("4567")) and component(one[4]) == ("0", list("01234567"))
    two = answers(spark, "example_cc_edges_2", "query_cc_2")
    assert all(component(r) == ("1", list("1234")) for r in two.values())


def test_strong_components(spark):
    got = {(r.vertex_id, r.wid): strong(r) for r in answers(spark, "example_scc_edges_1", "query_scc_1").values()}
    values = sorted((v, *x) for (v, _), x in got.items())
    assert values == sorted([("6", "4", ["4", "5"]), ("5", "4", ["4", "6"]), ("4", "4", ["5", "6"]), ("3", "3", []), ("2", "0", ["0", "1"]), ("1", "0", ["0", "2"]), ("7", "7", []), ("7", "3", ["3"])])
    for k, members, least in ((2, "02456", "0"), (3, "01234", "0"), (4, "1234", "1")):
        for r in answers(spark, f"example_scc_edges_{k}", f"query_scc_{k}").values():
            assert strong(r) == (least, [m for m in members if m != r.vertex_id])


def test_paths(spark):
    got = {r.vertex_id: r for r in answers(spark, "example_sssp_edges_1", "query_sssp_1").values()}
    assert paths(got["1"]) == {"2": (45, "1>3>4>2"), "3": (10, "1>3"), "4": (25, "1>3>4"), "5": (45, "1>5"), "6": (28, "1>3>4>6")}
    assert paths(got["5"]) == {"1": (90, "5>4>2>3>1"), "2": (55, "5>4>2"), "3": (70, "5>4>2>3"), "4": (35, "5>4"), "6": (38, "5>4>6")}
    assert got["6"].status == "isolated" and got["6"].result.endswith("no shortest path from node 6 because there are no outgoing edge from it!")


def test_samples(spark):
    one = {bag(r)[0] and len([e for e in bag(r) if e.startswith("1->")]): bag(r) for r in answers(spark, "example_gnnsampling_edges_1", "query_gnnsampling_1").values()}
    assert set(one) == {1, 2} and set(one[2]) <= {"1->2", "1->3", "1->4", "1->5", "2->6", "2->7", "3->8", "4->9"}
    two = {r.vertex_id: bag(r) for r in answers(spark, "example_gnnsampling_edges_2", "query_gnnsampling_2").values()}
    assert two["1"] == ["1->2", "2->0"]
    assert two["5"] == sorted("0->1 0->1 1->2 2->0 5->0 5->6 6->0 6->2 6->4".split())


def test_ranks(spark):
    rows = answers(spark, "example_pagerank_edges_1", "query_pagerank_1")
    firsts = [ranks(rows[q], 1) for q in sorted(rows)]
    assert firsts == [{"1": 1, "2": 0.575, "3": 1.425, "4": None, "5": None}, {"1": 1, "2": 0.575, "3": 1.425, "4": 0.15, "5": 0.2775}, {"1": 1, "2": 0.575, "3": 2.275, "4": 0.15, "5": 0.2775}]
    assert ranks(rows[max(rows)], 10) == {"1": 1.710461, "2": 0.864395, "3": 1.8303, "4": 0.15, "5": 0.2775}


def test_layouts_agree(spark):
    texts = [{q: r.result for q, r in answers(spark, "example_cc_edges_1", "query_cc_1", LogConfig(paradigm=p)).items()} for p in (1, 2, 3, 4)]
    assert all(t == texts[0] for t in texts)


def test_cache_and_problems(spark):
    edges = read_edges(spark, str(DATA / "demo_edges.txt"))
    queries = spark.createDataFrame([("1", "1", "3", "connected-components", 0, 100, None), ("1", "1", "3", "connected-components", 0, 100, None), ("2", "1", "x", "connected-components", 0, 100, None), ("3", "1", "3", "nothing", 0, 1, None), ("4", "1", "3", "gnn-sampling", 0, 9, None)], "query_id string, user_id string, vertex_id string, query_type string, start_t long, end_t long, parameter_map map<string,string>")
    engine = Engine(LogConfig(paradigm=1))
    first = {r.query_id: (r.status, r.result) for r in engine.answer(edges, queries).collect()}
    assert {k: v[0] for k, v in first.items()} == {"1": "ok", "2": "isolated", "3": "error", "4": "error"}
    again = engine.answer(edges.limit(0), queries.where(F.col("query_id") == "1")).collect()
    assert [(r.status, r.result) for r in again] == [first["1"]]
    fresh = engine.answer(edges.limit(0), queries.where(F.col("query_id") == "1"), version=1).collect()
    assert [r.status for r in fresh] == ["isolated"]
