"""What measured flows ask of a network: traffic between end points and load on links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def routed_flows(flows: DataFrame, routes: DataFrame) -> DataFrame:
    """Flows (graph, routing, route_no, offered_bandwidth, tos) with the nodes of their route; flows without one are left out."""
    return flows.join(routes.select("routing", "route_no", "nodes"), ["routing", "route_no"]).filter(F.size("nodes") > 0)


def traffic_matrix(routed: DataFrame) -> DataFrame:
    """graph, src, dst, flows, avg_bw, tos: the flows of each pair of end points that has any, and its commonest ToS.

    Counts and sums are combined before the shuffle, per ToS, so a busy pair is a few rows a task. Ties: the
    smaller ToS.
    """
    ends = routed.select("graph", F.get("nodes", F.lit(0)).alias("src"), F.element_at("nodes", -1).alias("dst"), "tos", "offered_bandwidth")
    cells = ends.groupBy("graph", "src", "dst", "tos").agg(F.count("*").alias("n"), F.sum("offered_bandwidth").alias("bw"))
    return cells.groupBy("graph", "src", "dst").agg(
        F.sum("n").alias("flows"), (F.sum("bw") / F.sum("n")).alias("avg_bw"), F.min(F.struct((-F.col("n")).alias("less"), "tos")).alias("most")).select(
        "graph", "src", "dst", "flows", "avg_bw", F.col("most.tos").alias("tos"))


def link_loads(routed: DataFrame) -> DataFrame:
    """graph, src, dst, flows, bandwidth: flows over each directed link of their routes, and what they offer together.

    A route's flows are added up first, so that only distinct routes are unnested.
    """
    per_route = routed.groupBy("graph", "nodes").agg(F.count("*").alias("n"), F.sum("offered_bandwidth").alias("bw"))
    hops = F.transform(F.slice("nodes", 2, F.greatest(F.size("nodes") - 1, F.lit(0))), lambda node, i: F.struct(F.get("nodes", i).alias("src"), node.alias("dst")))
    return per_route.select("graph", "n", "bw", F.inline(hops)).groupBy("graph", "src", "dst").agg(
        F.sum("n").alias("flows"), F.sum("bw").alias("bandwidth"))
