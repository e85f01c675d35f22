"""Queries for simulator records, paths, topologies and loads."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.adapters import (
    EDGES_SQL, NODES_SQL, ROUTES_SQL, SIM_SQL, edges, nodes, routes, sim_lines, table,
)
from catalog.registry import query, r, rounded
from linkgauge.functions.parsing import path_hops, result_records, traffic_records
from linkgauge.operators import delays, loads, routing

RECORDS = "list_filter(string_split(split_part({line}, '|', 2), ';'), lambda v: trim(v) <> '')"
RES = RECORDS.format(line="sim_line")
TRA = RECORDS.format(line="traffic_line")
VALUES = "string_split({rec}, ',')"


@query("result_records", f"""
WITH s AS ({SIM_SQL}), e AS (SELECT line_no, unnest({RES}) AS rec, unnest(range(0, len({RES}))) AS pos FROM s)
SELECT line_no, cast(pos AS int) AS pos, cast(v[1] AS double) AS actual_bandwidth, cast(v[4] AS double) AS avg_delay,
 cast(v[10] AS double) AS delay_p90, cast(v[11] AS double) AS jitter
FROM (SELECT line_no, pos, string_split(rec, ',') AS v FROM e) WHERE len(v) >= 11 AND cast(v[4] AS double) >= 0""")
def result_records_query(spark, sf):
    parsed = sim_lines(spark, sf).select("line_no", F.posexplode(result_records(F.col("sim_line"))).alias("pos", "rec"))
    return parsed.filter(F.col("rec").isNotNull()).select(
        "line_no", "pos", "rec.actual_bandwidth", "rec.avg_delay", "rec.delay_p90", "rec.jitter")


@query("traffic_records", f"""
WITH s AS ({SIM_SQL}), e AS (SELECT line_no, unnest({TRA}) AS rec, unnest(range(0, len({TRA}))) AS pos FROM s)
SELECT line_no, cast(pos AS int) AS pos, cast(v[1] AS int) AS time_distribution, cast(v[2] AS double) AS offered_bandwidth,
 cast(v[-1] AS int) AS tos
FROM (SELECT line_no, pos, string_split(rec, ',') AS v FROM e) WHERE cast(v[1] AS double) >= 0""")
def traffic_records_query(spark, sf):
    parsed = sim_lines(spark, sf).select(
        "line_no", F.posexplode(traffic_records(F.col("traffic_line"))).alias("pos", "rec"))
    return parsed.filter(F.col("rec").isNotNull()).select(
        "line_no", "pos", "rec.time_distribution", "rec.offered_bandwidth", "rec.tos")


FLOWS_CTE = f"""s AS ({SIM_SQL}),
a AS (SELECT line_no, unnest({RES}) AS rec, unnest(range(0, len({RES}))) AS pos FROM s),
b AS (SELECT line_no, unnest({TRA}) AS rec, unnest(range(0, len({TRA}))) AS pos FROM s),
ra AS (SELECT line_no, pos, string_split(rec, ',') AS v FROM a), rb AS (SELECT line_no, pos, string_split(rec, ',') AS t FROM b),
z AS (SELECT ra.line_no, ra.pos, v, t, coalesce(len(v) >= 11 AND cast(v[4] AS double) >= 0, false) AS measured,
  cast(t[1] AS double) >= 0 AS moving FROM ra JOIN rb ON ra.line_no = rb.line_no AND ra.pos = rb.pos)"""

SHIFTED = ("f AS (SELECT *, cast(row_number() OVER (PARTITION BY line_no ORDER BY pos) - 1 AS int) AS route_no FROM z "
           "WHERE measured AND moving)")
STRICT = ("f AS (SELECT * FROM (SELECT *, cast(row_number() OVER (PARTITION BY line_no ORDER BY pos) - 1 AS int) AS route_no "
          "FROM z WHERE moving) WHERE measured)")


@query("surviving_flows", f"WITH {FLOWS_CTE}, {SHIFTED} SELECT line_no, cast(pos AS int) AS position, route_no FROM f")
def surviving_flows(spark, sf):
    return delays.surviving_flows(sim_lines(spark, sf)).select("line_no", "position", "route_no")


@query("surviving_flows_strict", f"WITH {FLOWS_CTE}, {STRICT} SELECT line_no, cast(pos AS int) AS position, route_no FROM f")
def surviving_flows_strict(spark, sf):
    return delays.surviving_flows(sim_lines(spark, sf), strict=True).select("line_no", "position", "route_no")


WEIGHT = ("CASE WHEN policy = 'SP' THEN CASE tos WHEN 0 THEN 100e0 WHEN 1 THEN 0e0 WHEN 2 THEN 0e0 ELSE 100e0 / 3 END "
          "WHEN tos < len(string_split(weights, ',')) THEN cast(trim(string_split(weights, ',')[tos + 1]) AS double) "
          "ELSE 100e0 / len(string_split(weights, ',')) END")


def _topology_cte(paths: str, keys: str) -> str:
    """Path facts in SQL: mode by count then name, mean and smallest weight."""
    return f"""st AS (SELECT {keys}, policy, {WEIGHT} AS w FROM (SELECT {keys}, unnest(nodes) AS node FROM {paths}) x
  JOIN n USING (graph, node)),
pc AS (SELECT {keys}, policy, count(*) AS c FROM st GROUP BY ALL),
pm AS (SELECT {keys}, policy AS scheduling_policy FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY c DESC, policy)
  AS k FROM pc) WHERE k = 1),
tp AS (SELECT {keys}, scheduling_policy, avg(w) AS tos_queue_weight, min(w) AS min_tos_weight
  FROM st JOIN pm USING ({keys}) GROUP BY ALL)"""


@query("path_topology", f"""
WITH n AS ({NODES_SQL}), ro AS ({ROUTES_SQL}), d AS (SELECT DISTINCT graph FROM n),
p AS (SELECT routing, route_no, graph, cast(route_no % 4 AS int) AS tos, nodes FROM ro JOIN d
  ON right(graph, 5) = concat(cast(route_no % 7 AS varchar), '.txt')), {_topology_cte('p', 'routing, route_no, graph, tos')}
SELECT routing, route_no, graph, tos, scheduling_policy, {r('tos_queue_weight', 'min_tos_weight')} FROM tp""")
def path_topology(spark, sf):
    graphs = nodes(spark, sf).select("graph").distinct()
    tail = F.concat((F.col("route_no") % 7).cast("string"), F.lit(".txt"))
    paths = routes(spark, sf).join(graphs, F.right("graph", F.lit(5)) == tail).select(
        "routing", "route_no", "graph", (F.col("route_no") % 4).cast("int").alias("tos"), "nodes")
    keys = ["routing", "route_no", "graph", "tos"]
    return rounded(delays.path_topology(paths, nodes(spark, sf), keys))


@query("path_hops", f"WITH ro AS ({ROUTES_SQL}) SELECT routing, route_no, cast(greatest(1, len(nodes) - 1) AS int) AS hops FROM ro")
def path_hops_query(spark, sf):
    return routes(spark, sf).select("routing", "route_no", path_hops(F.col("nodes")).alias("hops"))


@query("delay_table", f"""
WITH {FLOWS_CTE}, {SHIFTED}, n AS ({NODES_SQL}), ro AS ({ROUTES_SQL}),
m AS (SELECT line_no, concat(archive, '_', split_part(manifest_line, ';', 1)) AS simulation_id,
  split_part(manifest_line, ';', 2) AS graph, replace(split_part(manifest_line, ';', 3), '.txt', '') AS routing,
  cast(split_part(traffic_line, '|', 1) AS double) AS max_avg_lambda FROM s),
fl AS (SELECT m.*, route_no, v, t, cast(t[-1] AS int) AS tos FROM f JOIN m USING (line_no)),
up AS (SELECT DISTINCT graph, routing, route_no, tos FROM fl), p AS (SELECT up.*, ro.nodes FROM up JOIN ro USING (routing, route_no)),
{_topology_cte('p', 'graph, routing, route_no, tos')},
sz AS (SELECT graph, cast(count(*) AS int) AS n_nodes FROM n GROUP BY 1)
SELECT simulation_id, CASE WHEN regexp_extract(fl.graph, '^graph_([^_]+_[^_]+_[^_]+)_\\d+\\.txt', 1) = '' THEN 'unknown'
  ELSE regexp_extract(fl.graph, '^graph_([^_]+_[^_]+_[^_]+)_\\d+\\.txt', 1) END AS scenario, fl.tos,
 CASE fl.tos WHEN 0 THEN 'Gold' WHEN 1 THEN 'Silver' WHEN 2 THEN 'Bronze' ELSE concat('tos_', cast(fl.tos AS varchar)) END AS qos_class,
 cast(t[2] AS double) AS offered_bandwidth, cast(t[1] AS int) AS time_distribution,
 cast(greatest(1, coalesce(len(ro.nodes), 0) - 1) AS int) AS routing_hops, coalesce(n_nodes, 0) AS n_nodes, max_avg_lambda,
 cast(100000 AS int) AS link_bandwidth, coalesce(scheduling_policy, 'unknown') AS scheduling_policy,
 round(coalesce(tos_queue_weight, 33e0), 6) AS tos_queue_weight, round(coalesce(min_tos_weight, 33e0), 6) AS min_tos_weight,
 cast(v[4] AS double) AS avg_delay, cast(v[11] AS double) AS jitter,
 round(CASE WHEN cast(v[2] AS double) + cast(v[3] AS double) > 0 THEN cast(v[3] AS double) / (cast(v[2] AS double) + cast(v[3] AS double))
  ELSE 0e0 END, 6) AS packet_loss_rate, cast(v[6] AS double) AS delay_p10, cast(v[8] AS double) AS delay_p50,
 cast(v[10] AS double) AS delay_p90, cast(v[1] AS double) AS actual_bandwidth,
 round(ln(greatest(cast(v[4] AS double), 1e-9)), 6) AS log_avg_delay
FROM fl LEFT JOIN ro ON fl.routing = ro.routing AND fl.route_no = ro.route_no
 LEFT JOIN tp ON fl.graph = tp.graph AND fl.routing = tp.routing AND fl.route_no = tp.route_no AND fl.tos = tp.tos
 LEFT JOIN sz ON fl.graph = sz.graph""")
def delay_table(spark, sf):
    return rounded(delays.flow_rows(sim_lines(spark, sf), nodes(spark, sf), routes(spark, sf).drop("route")))


@query("all_pairs_paths", f"""
WITH RECURSIVE e0 AS ({EDGES_SQL}), e AS (SELECT DISTINCT graph, src, dst FROM (SELECT graph, src, dst FROM e0 UNION ALL
  SELECT graph, dst, src FROM e0) WHERE src <> dst),
p(graph, src, dst, path) AS (SELECT graph, src, dst, [src, dst] FROM e UNION ALL
  SELECT p.graph, p.src, e.dst, list_append(p.path, e.dst) FROM p JOIN e ON p.graph = e.graph AND p.dst = e.src
  WHERE NOT list_contains(p.path, e.dst))
SELECT graph, src, dst, cast(len(path) - 1 AS int) AS hops, array_to_string(path, ',') AS route FROM (
 SELECT *, row_number() OVER (PARTITION BY graph, src, dst ORDER BY len(path), path) AS k FROM p) WHERE k = 1""")
def all_pairs_paths(spark, sf):
    return routing.route_table(routing.all_pairs_paths(edges(spark, sf)))


ROUTED = f"""WITH {FLOWS_CTE}, {SHIFTED}, ro AS ({ROUTES_SQL}),
m AS (SELECT line_no, split_part(manifest_line, ';', 2) AS graph, replace(split_part(manifest_line, ';', 3), '.txt', '') AS routing FROM s),
fl AS (SELECT graph, nodes, cast(t[2] AS double) AS bw, cast(t[-1] AS int) AS tos FROM f JOIN m USING (line_no) JOIN ro USING (routing, route_no))"""


def routed(spark, sf):
    """The measured flows of the simulator lines with the nodes of their routes."""
    flows = delays.surviving_flows(delays.with_manifest(sim_lines(spark, sf)))
    return loads.routed_flows(flows, routes(spark, sf))


@query("traffic_matrix", f"""{ROUTED}, c AS (SELECT graph, nodes[1] AS src, nodes[-1] AS dst, tos, count(*) AS n, sum(bw) AS bw FROM fl GROUP BY ALL)
SELECT graph, src, dst, cast(sum(n) AS bigint) AS flows, round(sum(bw) / sum(n), 6) AS avg_bw, arg_min(tos, -n * 1000 + tos) AS tos FROM c GROUP BY 1, 2, 3""")
def traffic_matrix(spark, sf):
    """What the measured flows ask for between end points."""
    return rounded(loads.traffic_matrix(routed(spark, sf)))


@query("link_loads", f"""{ROUTED}, h AS (SELECT graph, bw, nodes, unnest(range(1, len(nodes))) AS i FROM fl)
SELECT graph, nodes[i] AS src, nodes[i + 1] AS dst, count(*) AS flows, round(sum(bw), 4) AS bandwidth FROM h GROUP BY 1, 2, 3""")
def link_loads(spark, sf):
    """What the measured flows put on each link of their routes."""
    return rounded(loads.link_loads(routed(spark, sf)), 4)
