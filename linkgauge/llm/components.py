"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkgauge.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of every node in (a, b).

    Each round writes its edges to the shared folder. Rounds grow with the logarithm of a component's
    width, not its length; minima are partial before each shuffle and hubs meet only in joins.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "edges")
    before = None
    while True:
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _star(both, now_only_larger=True)
        small = materialize(_star(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), False), "edges")
        state = small.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").bitwiseAND(F.lit(0xFFFFFFFF)))).first()
        now = small
        if state == before:
            break
        before = state
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionAll(nodes.select(F.col("component").alias("node"), "component").distinct())


def _star(edges: DataFrame, now_only_larger: bool) -> DataFrame:
    """large: neighbours above a node go to its least neighbour; small: neighbours below it (and itself) do."""
    least = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    joined = edges.join(least, edges["a"] == least["u"])
    if now_only_larger:
        return joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a != b").distinct()
