"""Result texts, keys and JSON values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISOLATED = {
    "connected-components": "no connected component found for node {} because it is isolated!",
    "strongly-connected-components": "no connected component found for node {} because it is isolated!",
    "single-source-shortest-path": "no shortest path from node {} because there are no outgoing edge from it!",
    "gnn-sampling": "no results found for node {} because it is isolated!",
}


def head() -> Column:
    return F.concat(F.lit("Result of query "), F.col("query_id"), F.lit(" by user "), F.col("user_id"))


def isolated(query_type: str) -> Column:
    before, after = ISOLATED[query_type].split("{}")
    return F.concat(head(), F.lit(f": {before}"), F.col("vertex_id"), F.lit(after))


def by_number(ids: Column) -> Column:
    """Sorted by number where all ids are numbers, else by text."""
    keyed = F.transform(ids, lambda x: F.struct(x.try_cast("bigint").alias("n"), x.alias("id")))
    return F.transform(F.array_sort(keyed), lambda x: x["id"])


def component_text() -> Column:
    return F.concat(head(), F.lit(": connected component id of node "), F.col("vertex_id"), F.lit(" is "), F.col("component_id"), F.lit(". All node ids that contain in the same component are:["), F.array_join(by_number(F.col("members")), ", "), F.lit("]"))


def strong_text() -> Column:
    return F.concat(head(), F.lit(": Strongly connected component id of node "), F.col("vertex_id"), F.lit(" is "), F.col("component_id"), F.lit(". Other node ids that contain in the same component are:  "), F.array_join(by_number(F.array_remove("members", F.col("vertex_id"))), " "))


def paths_text() -> Column:
    """``paths``: array of (target_id, distance, path)."""
    keyed = F.array_sort(F.transform("paths", lambda x: F.struct(x["target_id"].try_cast("bigint").alias("n"), x.alias("p"))))
    one = F.transform(keyed, lambda x: F.concat(F.lit("id: "), x["p"]["target_id"], F.lit(" distance: "), x["p"]["distance"].cast("string"), F.lit(" path: ["), F.array_join(x["p"]["path"], ", "), F.lit("];")))
    return F.concat(head(), F.lit(": shortest path(s) from node "), F.col("vertex_id"), F.lit(" to others: "), F.array_join(one, ""))


def sample_text() -> Column:
    """``tree``: array of (hop, src_id, dst_id)."""
    return F.concat(head(), F.lit(", edges including in the gnn-sampling are: "), F.array_join(F.transform(F.array_sort("tree"), lambda e: F.concat(e["src_id"], F.lit("->"), e["dst_id"], F.lit(" "))), ""))


def ranks_text() -> Column:
    """``ranks``: array of (iteration, array of (number, vertex_id, rank))."""
    value = lambda x: F.concat(x["vertex_id"], F.lit("="), F.coalesce(x["rank"].cast("string"), F.lit("null")))
    one = F.transform(F.array_sort("ranks"), lambda r: F.concat(r["iteration"].cast("string"), F.lit("={"), F.array_join(F.transform(r["values"], value), ", "), F.lit("}")))
    return F.concat(F.lit("{"), F.array_join(one, ", "), F.lit("}"))


def egress(result: Column, time_ms: Column) -> tuple[Column, Column]:
    """K1: key and JSON value of a result record."""
    return F.concat_ws(" ", "query_id", "user_id").alias("key"), F.to_json(F.struct(result.alias("result_string"), time_ms.cast("string").alias("time"))).alias("value")
