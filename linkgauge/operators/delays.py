"""Simulator lines to one row per flow with its path and topology facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkgauge.functions.numeric import log_target, loss_rate
from linkgauge.functions.parsing import (
    RESULT_FIELDS, class_weight, line_head, line_records, measured_result, moving_traffic, numbers, path_hops,
    readable_result_line, readable_traffic_line, weight_list,
)
from linkgauge.functions.rules import scenario_of, tos_to_class
from linkgauge.session import materialize
from linkgauge.sources.archives import routing_name

LINK_BANDWIDTH = 100000  # fixed value: capacity of every simulated link


def pair_records(lines: DataFrame) -> DataFrame:
    """Traffic and result records of a line side by side by position, cut to the shorter list.

    Both lists sit in the same row, so this positional join moves no data.
    """
    listed = lines.withColumns({"_t": line_records(F.col("traffic_line")), "_r": line_records(F.col("sim_line"))})
    length = F.least(F.size("_t"), F.size("_r"))
    zipped = F.arrays_zip(F.slice("_t", 1, length).alias("traffic"), F.slice("_r", 1, length).alias("result"))
    pairs = F.transform(zipped, lambda pair, i: F.struct(
        i.alias("position"), pair["traffic"].alias("traffic"), pair["result"].alias("result")))
    return listed.withColumn("pairs", pairs).drop("_t", "_r")


def surviving_flows(lines: DataFrame, strict: bool = False) -> DataFrame:
    """One row per measured flow with the number of its route line.

    By default flows are renumbered after dropping unmeasured ones, so an unmeasured flow shifts
    the routes of all later ones. ``strict`` numbers by pair position instead: only self paths,
    which have no route line, are left out before numbering. Numbering happens inside the line's
    own array; the numbers of a record are only parsed for flows that remain.
    """
    paired = pair_records(lines)
    rest = [c for c in paired.columns if c != "pairs"]
    if strict:
        numbered = F.filter("pairs", lambda p: moving_traffic(p["traffic"]))
    else:
        numbered = F.filter("pairs", lambda p: moving_traffic(p["traffic"]) & measured_result(p["result"]))
    flows = paired.select(*rest, F.posexplode(numbered).alias("route_no", "pair"))
    if strict:
        flows = flows.filter(measured_result(F.col("pair.result")))
    texts = flows.select(
        *rest, "route_no", "pair.position",
        F.split("pair.traffic", ",").alias("_t"), F.split("pair.result", ",").alias("_r"),
    )
    number = lambda name, i: F.trim(F.get(name, F.lit(i))).try_cast("double")
    return texts.select(
        *rest, "route_no", "position",
        number("_t", 0).try_cast("int").alias("time_distribution"),
        number("_t", 1).alias("offered_bandwidth"),
        F.trim(F.element_at("_t", -1)).try_cast("double").try_cast("int").alias("tos"),
        *[number("_r", i).alias(name) for i, name in enumerate(RESULT_FIELDS)],
    )


def route_facts(pairs: DataFrame, routes: DataFrame, nodes: DataFrame) -> DataFrame:
    """Hops and topology facts per (graph, routing, route_no, slot).

    ``pairs`` are the distinct (graph, routing) of a manifest with ``flows``, the most flows of a line: only the first
    ``flows`` routes can be used, so the facts grow with the flows and not with pairs times routes. A slot is a ToS
    code, cut at the longest weight list: from there on every code gets the same equal share.
    """
    longest = nodes.agg(F.coalesce(F.max(F.size(weight_list(F.col("policy"), F.col("weights")))), F.lit(0)))
    reached = pairs.join(routes, (pairs["routing"] == routes["routing"]) & (F.col("route_no") < F.col("flows"))).select(
        "graph", routes["routing"], "route_no", "nodes")
    used = reached.select("*", F.explode(F.sequence(F.lit(0), longest.scalar())).alias("tos"))
    keys = ["graph", "routing", "route_no", "tos"]
    topology = path_topology(used, nodes, keys)
    return used.select(*keys, path_hops(F.col("nodes")).alias("hops")).join(topology, keys, "left").withColumnRenamed(
        "tos", "slot")


def path_topology(paths: DataFrame, nodes: DataFrame, id_columns: list[str]) -> DataFrame:
    """Dominant policy (ties: smallest name), mean and smallest class weight over a path's nodes.

    ``paths`` has the id columns, ``graph``, ``nodes`` and ``tos``; ``nodes`` has graph, node,
    policy and weights. A group is one path, as long as its hops. Nodes that a graph does not have count for
    nothing: see ``unknown_nodes``.
    """
    steps = paths.select(*id_columns, "graph", "tos", F.explode("nodes").alias("node"))
    facts = nodes.select("graph", "node", "policy", weight_list(F.col("policy"), F.col("weights")).alias("weight_list"))
    weight = class_weight(F.col("weight_list"), F.col("tos"))
    return (
        steps.join(facts, ["graph", "node"]).withColumn("weight", weight)
        .groupBy(*id_columns).agg(
            F.mode("policy", deterministic=True).alias("scheduling_policy"),
            F.avg("weight").alias("tos_queue_weight"),
            F.min("weight").alias("min_tos_weight"),
        )
    )


def unknown_nodes(lines: DataFrame, routes: DataFrame, nodes: DataFrame) -> DataFrame:
    """graph, routing, node: nodes on routes that simulations use in a known graph which does not have them."""
    pairs = with_manifest(lines).select("graph", "routing").distinct().join(nodes.select("graph").distinct(), "graph", "left_semi")
    # the nodes of a routing first: its routes are many, and each belongs to every graph the routing is used with
    known = routes.select("routing", F.explode("nodes").alias("node")).distinct()
    steps = pairs.join(known, "routing")
    return steps.join(nodes, ["graph", "node"], "left_anti").select("graph", "routing", "node")


def with_manifest(lines: DataFrame) -> DataFrame:
    """The parts of a manifest line: simulation number, graph file and routing name; NULL where one is not there."""
    parts = F.split(F.trim("manifest_line"), ";")
    return lines.withColumns({
        "sim_num": F.trim(F.get(parts, F.lit(0))).try_cast("int"),
        "graph": F.trim(F.get(parts, F.lit(1))),
        "routing": routing_name(F.get(parts, F.lit(2))),
    })


def skipped_lines(lines: DataFrame) -> DataFrame:
    """archive, line_no, reason of the simulations that are left out because a line cannot be read."""
    reasons = {
        "manifest line": F.col("sim_num").isNull() | F.col("routing").isNull(),
        "result line": ~F.coalesce(readable_result_line(F.col("sim_line")), F.lit(False)),
        "traffic line": ~F.coalesce(readable_traffic_line(F.col("traffic_line")), F.lit(False)),
    }
    first = F.coalesce(*[F.when(wrong, F.lit(reason)) for reason, wrong in reasons.items()])
    return with_manifest(lines).select("archive", "line_no", first.alias("reason")).filter(F.col("reason").isNotNull())


def flow_rows(lines: DataFrame, nodes: DataFrame, routes: DataFrame, strict: bool = False) -> DataFrame:
    """The delay table: one row per measured flow.

    ``lines`` has archive, line_no, sim_line, traffic_line and manifest_line. Path facts are
    computed once per (graph, route, ToS slot), not once per flow.
    """
    manifest = with_manifest(lines)
    readable = manifest.filter(
        F.col("sim_num").isNotNull() & F.col("routing").isNotNull()
        & readable_result_line(F.col("sim_line")) & readable_traffic_line(F.col("traffic_line"))
    ).withColumn("max_avg_lambda", numbers(line_head(F.col("traffic_line"))).getItem(0))
    flows = surviving_flows(readable, strict)
    longest = nodes.agg(F.coalesce(F.max(F.size(weight_list(F.col("policy"), F.col("weights")))), F.lit(0)))
    flows = flows.withColumns({
        "simulation_id": F.concat("archive", F.lit("_"), F.col("sim_num")),
        "slot": F.least(F.col("tos"), longest.scalar()),
    })
    # written first: one row per route and slot, so Spark sees its true size and joins it by broadcast if small
    pairs = manifest.groupBy("graph", "routing").agg(F.max(F.size(line_records(F.col("traffic_line")))).alias("flows"))
    facts = materialize(route_facts(materialize(pairs, "pairs"), routes, nodes), "routes")
    sizes = nodes.groupBy("graph").agg(F.count("*").cast("int").alias("graph_nodes"))
    joined = flows.join(facts, ["graph", "routing", "route_no", "slot"], "left").join(sizes, "graph", "left")
    return joined.select(
        "simulation_id",
        scenario_of(F.col("graph")).alias("scenario"),
        "tos",
        tos_to_class(F.col("tos")).alias("qos_class"),
        "offered_bandwidth",
        "time_distribution",
        F.coalesce("hops", F.lit(1)).alias("routing_hops"),
        F.coalesce("graph_nodes", F.lit(0)).alias("n_nodes"),
        "max_avg_lambda",
        F.lit(LINK_BANDWIDTH).alias("link_bandwidth"),
        F.coalesce("scheduling_policy", F.lit("unknown")).alias("scheduling_policy"),
        F.coalesce("tos_queue_weight", F.lit(33.0)).alias("tos_queue_weight"),
        F.coalesce("min_tos_weight", F.lit(33.0)).alias("min_tos_weight"),
        "avg_delay",
        "jitter",
        loss_rate(F.col("pkts_transmitted"), F.col("pkts_dropped")).alias("packet_loss_rate"),
        "delay_p10",
        "delay_p50",
        "delay_p90",
        "actual_bandwidth",
        log_target(F.col("avg_delay")).alias("log_avg_delay"),
    )
