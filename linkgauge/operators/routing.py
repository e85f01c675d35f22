"""Shortest paths inside many small topologies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkgauge.session import materialize


def all_pairs_paths(edges: DataFrame, directed: bool = False) -> DataFrame:
    """Shortest hop path for every ordered pair of connected nodes of every graph.

    Breadth first: each round extends the paths found in the round before by one edge and keeps
    pairs not seen yet; on ties the smallest path wins. Rounds end at the largest diameter. Each
    round is written to the shared folder, so the plan stays short and survives lost executors.
    """
    forward = edges.select("graph", "src", "dst").filter(F.col("src") != F.col("dst"))
    if not directed:
        forward = forward.unionByName(
            forward.select("graph", F.col("dst").alias("src"), F.col("src").alias("dst"))
        )
    links = materialize(forward.distinct(), "links")
    reached = materialize(
        links.select("graph", "src", "dst", F.array("src", "dst").alias("path")), "paths"
    )
    frontier = reached
    while True:
        step = frontier.join(
            links.select("graph", F.col("src").alias("dst"), F.col("dst").alias("next")), ["graph", "dst"]
        )
        grown = (
            step.filter((F.col("next") != F.col("src")) & ~F.array_contains("path", F.col("next")))
            .select("graph", "src", F.col("next").alias("dst"), F.concat("path", F.array("next")).alias("path"))
            .groupBy("graph", "src", "dst").agg(F.min("path").alias("path"))
            .join(reached.select("graph", "src", "dst"), ["graph", "src", "dst"], "left_anti")
        )
        frontier = materialize(grown, "paths")
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    return reached


def route_table(paths: DataFrame) -> DataFrame:
    """Paths as (graph, src, dst, hops, route text)."""
    return paths.select(
        "graph", "src", "dst", (F.size("path") - 1).alias("hops"),
        F.array_join(F.transform("path", lambda n: n.cast("string")), ",").alias("route"),
    )
