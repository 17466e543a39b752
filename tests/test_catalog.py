"""Registered queries against their SQL, on the smallest tables."""

import datetime
import itertools
import re
from pathlib import Path

import duckdb
import pytest

from tidegraph import catalog

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test tables")


def plain(rows):
    return sorted(str([round(float(x), 6) if isinstance(x, float) else str(x) if isinstance(x, datetime.date) else x for x in r]) for r in rows)


@pytest.mark.parametrize("name", list(catalog.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("events", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = catalog.queries()[name](spark, str(SF))
    found = con.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    want = found.fetchall()
    assert plain([tuple(r) for r in got.select(*columns).collect()]) == plain(want)


def whole_graph():
    """Successors of every user over the whole table, by a plain loop."""
    rows = duckdb.sql(f"SELECT event_type, user_id FROM read_parquet('{SF}/events.parquet') ORDER BY event_type, ts, event_id").fetchall()
    out = {}
    for (kind, u), (after, v) in itertools.pairwise(rows):
        if kind == after:
            out.setdefault(str(u), set()).add(str(v))
    return out


def test_whole_span(spark):
    follow = whole_graph()
    got = {(str(r.src_id), str(r.dst_id)) for r in catalog.queries()["a1_out_neighbours"](spark, str(SF)).collect()}
    assert got == {(u, v) for u in follow for v in follow[u]}
    reach, todo = set(), ["8"]
    while todo:
        u = todo.pop()
        if u not in reach:
            reach.add(u)
            todo += follow.get(u, ())
    status = {r.query_id: r.status for r in catalog.queries()["p6_p7_p9_engine_status"](spark, str(SF)).collect()}
    assert status == {k: "ok" if k < 7 else "isolated" if k == 7 else "error" for k in range(1, 11)}
    records = [str(r) for r in catalog.queries()["k1_f1_result_records"](spark, str(SF)).collect()]
    found = [set(re.search(r":\[(.*?)\]", r)[1].split(", ")) for r in records if "connected" in r and "component id of node" in r and ":[" in r]
    assert len(records) == 10 and len(found) == 2 and all(x == reach for x in found)
