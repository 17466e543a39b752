"""Edges and queries as streams give what a batch over the same files gives."""

import json
import random
from pathlib import Path

import pytest

from tidegraph.operators import graph
from tidegraph.operators.state import metric_records
from tidegraph.plans.engine import Engine
from tidegraph.sources.edges import edges_from_json, json_stream, numbered_lines, raw_edge_list, read_edges, synthetic_edges, unkeyed
from tidegraph.storage import LogConfig, read_log, read_window
from tidegraph.streaming.service import answer_queries, asked_edges, dump_text, ingest_edges

DATA = Path(__file__).parent / "fixtures"


def test_stream(spark, tmp_path):
    (tmp_path / "edges").mkdir()
    (tmp_path / "queries").mkdir()
    (tmp_path / "edges/1.txt").write_text((DATA / "example_cc_edges_1.txt").read_text())
    (tmp_path / "queries/1.txt").write_text((DATA / "query_cc_1.txt").read_text())
    config = LogConfig(paradigm=4, interval=10)
    log = str(tmp_path / "log")
    ingest_edges(json_stream(spark, str(tmp_path / "edges")), log, str(tmp_path / "c1"), config, str(tmp_path / "metrics")).awaitTermination()
    assert read_log(spark, log, config).count() == 14
    assert spark.read.parquet(str(tmp_path / "metrics")).count() == 1
    plan = read_window(spark, log, config, 0, 20)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "PushedFilters: [IsNotNull(timestamp)" in plan
    out = str(tmp_path / "out")
    answer_queries(json_stream(spark, str(tmp_path / "queries")), log, out, str(tmp_path / "c2"), Engine(config), str(tmp_path / "filter")).awaitTermination()
    times = metric_records(spark.read.parquet(str(tmp_path / "filter")), "time", ["batch"], [])
    assert [r.key for r in times.collect()] == ["1"] and {"time", "overall_time", "average_time"} == set(json.loads(times.first().value))
    asked = spark.createDataFrame([(0, 20), (30, 10)], "start_t long, end_t long")
    plan = asked_edges(spark, log, config, asked)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and asked_edges(spark, log, config, asked.where("start_t > end_t")).count() == 0
    records = spark.read.option("recursiveFileLookup", "true").parquet(out)
    got = {r.key: json.loads(r.value)["result_string"] for r in records.collect()}
    assert got["1 1"].endswith("[0, 1, 2, 3]") and len(got) == 3
    dump_text(records, str(tmp_path / "dump"))
    assert spark.read.text(str(tmp_path / "dump")).count() == 3


def test_sources(spark):
    keyed = spark.createDataFrame([('53: {"src_id": "53", "dst_id": "28", "timestamp": "9986248"}',), ("junk",)], "value string")
    row = edges_from_json(unkeyed(keyed)).first()
    assert (row.src_id, row.dst_id, row.weight, row.timestamp) == ("53", "28", None, 9986248)
    raw = spark.createDataFrame([("1 2 3",), ("bad",)], "value string")
    assert sorted((r.src_id, r.dst_id, r.timestamp) for r in raw_edge_list(raw, mirror=True).collect()) == [("1", "2", 3), ("2", "1", 3)]
    assert synthetic_edges(spark, 500, span=1000, mirror=False).select("timestamp").distinct().count() == 500


def test_arrival_order(spark, tmp_path):
    """Lines keep their order over files whose names hold blanks, larger files last, and over splits of a file."""
    rows = []
    for name, n in (("a 1.txt", 30), ("b%2.txt", 3000), ("c.txt", 5)):
        lines = [f"{len(rows) + i} 7 {i}" for i in range(n)]
        (tmp_path / name).write_text("\n".join(lines) + "\n")
        rows += lines
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        lines = numbered_lines(spark, str(tmp_path))
        assert [r.value for r in lines.orderBy("seq").collect()] == rows and lines.select("seq").distinct().count() == len(rows)
        capped = raw_edge_list(lines, mirror=True, rows=40).orderBy("seq").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(r.src_id, r.dst_id) for r in capped] == [x for i in range(40) for x in ((str(i), "7"), ("7", str(i)))]
    with pytest.raises(ValueError):
        raw_edge_list(spark.createDataFrame([("1 2 3",)], "value string"), rows=1)
    edges = read_edges(spark, str(DATA / "example_cc_edges_1.txt")).orderBy("seq").collect()
    want = [json.loads(x) for x in (DATA / "example_cc_edges_1.txt").read_text().splitlines() if x.strip()]
    assert [(r.src_id, r.dst_id) for r in edges] == [(e["src_id"], e["dst_id"]) for e in want]


def test_walks(spark):
    """Reach and strong components of graphs with and without edges both ways, against a plain search; queries of one vertex share it."""
    dice = random.Random(5)
    for both_ways in (False, True):
        pairs = {(str(dice.randrange(40)), str(dice.randrange(40))) for _ in range(50)}
        if both_ways:
            pairs |= {(b, a) for a, b in pairs}
        graphs = spark.createDataFrame([(1, a, b, 1.0) for a, b in pairs], "wid long, src_id string, dst_id string, weight double")
        assert graph._both_ways(graphs) is both_ways and not graph._both_ways(graphs.union(spark.createDataFrame([(1, "x", "y", 1.0)] * 2, graphs.schema)))
        queries = spark.createDataFrame([(f"{v}.{twin}", "u", 1, str(v)) for v in range(40) for twin in range(2)], "query_id string, user_id string, wid long, vertex_id string")

        def reach(v, pairs=pairs):
            seen, todo = set(), [v] if any(a == v for a, b in pairs) else []
            while todo:
                u = todo.pop()
                if u not in seen:
                    seen.add(u)
                    todo += [b for a, b in pairs if a == u]
            return seen

        want = {(f"{v}.{twin}", m) for v in range(40) for twin in range(2) for m in reach(str(v))}
        found = graph.reachable(graphs, queries).collect()
        assert {(r.query_id, r.member_id) for r in found} == want and len(found) == len(want)
        strong = {(q, m) for q, m in want if m == q.split(".")[0] or q.split(".")[0] in reach(m)}
        found = graph.strongly_connected(graphs, queries).collect()
        assert {(r.query_id, r.member_id) for r in found} == strong and len(found) == len(strong)
