"""Queries from raw files: the given tables are written as archives, graphs, routes and text files, then prepared."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.adapters import (
    NODES_SQL, ROUTES_SQL, SIM_SQL, nodes, packets, routes, sim_lines, table, throughput_wide,
)
from catalog.preparation import FLOW_FEATURE_SQL, PACKET_KEYS, raw_flow_columns
from catalog.registry import ORACLES, query, rounded
import catalog.simulation  # noqa: F401  registers the SQL used here
from linkgauge.operators import links
from linkgauge.operators.flows import RAW_COLUMNS
from linkgauge.plans import datasets
from linkgauge.session import materialize, scratch_path
from linkgauge.sources import archives, files
from linkgauge.sources.archives import MEMBERS


def write_named(df, folder: str) -> str:
    """A plain text file for each row of (name, text). Written by tasks."""

    def write(batches):
        import pandas as pd

        filesystem, base = files.located(folder)
        filesystem.create_dir(base, recursive=True)
        for batch in batches:
            for row in batch.itertuples():
                with filesystem.open_output_stream(f"{base}/{row.name}", compression=None) as out:
                    out.write(row.text.encode())
            yield pd.DataFrame({"name": batch["name"]})

    df.mapInPandas(write, "name string").write.format("noop").mode("overwrite").save()
    return folder


def write_archives(lines, folder: str) -> str:
    """A tar.gz for each name of (name, member, place, line): the lines of each member in order.

    A task streams sorted lines into an archive and holds one batch of them. A member's size stands before its data, so a
    row with the size comes before its lines. Members without text are left out.
    """

    def write(batches):
        import gzip
        import tarfile
        from itertools import batched, groupby
        from operator import itemgetter

        import pyarrow as pa

        filesystem, base = files.located(folder)
        filesystem.create_dir(base, recursive=True)
        rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("name", "member", "size", "line")), strict=True))
        for name, archive in groupby(rows, itemgetter(0)):
            with filesystem.open_output_stream(f"{base}/{name}", compression=None) as out, gzip.GzipFile(fileobj=out, mode="wb", compresslevel=6) as packed:
                for member, texts in groupby(archive, itemgetter(1)):
                    info = tarfile.TarInfo(f"results/{names[member]}")
                    info.size = next(texts)[2]
                    if not info.size:
                        continue
                    packed.write(info.tobuf())
                    ahead = ""
                    for some in batched((text[3] for text in texts), 1000):
                        packed.write((ahead + "\n".join(some)).encode())
                        ahead = "\n"
                    packed.write(bytes(-info.size % tarfile.BLOCKSIZE))
                packed.write(bytes(2 * tarfile.BLOCKSIZE))
            yield pa.RecordBatch.from_pydict({"name": pa.array([name], pa.string())})

    names = list(MEMBERS)
    sizes = lines.groupBy("name", "member").agg((F.sum(F.octet_length("line") + 1) - 1).alias("size"))
    order = ["name", "member", "size", "place", "line"]
    every = lines.withColumn("size", F.lit(None).cast("long")).select(order).unionAll(
        sizes.select("name", "member", "size", F.lit(None).cast("long"), F.lit(None).cast("string")))
    # an archive is written by one task; its lines are sorted there, on disk when they are many
    sorted_lines = every.repartition("name").sortWithinPartitions("name", "member", F.col("size").desc_nulls_last(), "place", "line")
    sorted_lines.select("name", "member", "size", "line").mapInArrow(write, "name string").write.format("noop").mode("overwrite").save()
    return folder


def lines_text(order: str, line: str):
    """All lines of a group as one text, in order."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, F.col(line).alias("line")))), lambda x: x["line"]), "\n")


def result_archives(spark, sf, folder: str) -> str:
    """The simulator lines as archives; three more that cannot be used, and one with lines that cannot."""
    lines = materialize(sim_lines(spark, sf), "lines")
    cut = lines.filter("archive = 'sim3'").withColumns({"archive": F.lit("uneven"), "traffic_line": F.when(
        F.col("line_no") % 3 != 0, F.col("traffic_line"))})
    gone = lines.filter("archive = 'sim4'").withColumns({"archive": F.lit("gone"), "manifest_line": F.lit(None)})
    odd = lines.filter("line_no % 97 = 0").withColumns({"archive": F.lit("odd"), "sim_line": F.lit("1,2|x")})
    every = lines.unionByName(cut).unionByName(gone).unionByName(odd)
    texts = F.array(*[F.struct(F.lit(i).alias("member"), F.col(c).alias("line")) for i, c in enumerate(MEMBERS.values())])
    rows = every.select(F.concat("archive", F.lit(".tar.gz")).alias("name"), F.col("line_no").cast("long").alias("place"), F.inline(texts))
    return write_archives(rows.filter(F.col("line").isNotNull()), folder)


def graph_files(spark, sf, folder: str) -> str:
    """Nodes as GML; each node is linked to the next one of its graph."""
    node = F.format_string('  node [\n    id %d\n    label "%d"\n    schedulingPolicy "%s"\n    schedulingWeights "%s"\n  ]', "node", "node", "policy", "weights")
    # neighbours are paired as a whole: a lambda that looks a neighbour up sorts all numbers again for each element
    numbers = F.sort_array(F.collect_set("node"))
    last = F.greatest(F.size(numbers) - 1, F.lit(0))
    edge = F.zip_with(F.slice(numbers, F.lit(1), last), F.slice(numbers, F.lit(2), last), lambda a, b: F.format_string(
        "  edge [\n    source %d\n    target %d\n    bandwidth %d\n  ]", a, b, b * 1000))
    text = F.concat(F.lit("graph [\n  levelsToS 3\n"), lines_text("node", "block"), F.lit("\n"), F.array_join(edge, "\n"), F.lit("\n]\n"))
    given = nodes(spark, sf).withColumn("block", node)
    return write_named(given.groupBy("graph").agg(text.alias("text")).select(F.col("graph").alias("name"), "text"), folder)


def route_files(spark, sf, folder: str) -> str:
    """A line for each route number; a number without a route has a line that is no path."""
    given = routes(spark, sf).select("routing", "route_no", "route")
    spans = given.groupBy("routing").agg(F.max("route_no").alias("top")).select("routing", F.explode(F.sequence(F.lit(0), "top")).alias("route_no"))
    full = spans.join(given, ["routing", "route_no"], "left").withColumn("route", F.coalesce("route", F.lit("none")))
    text = full.groupBy("routing").agg(lines_text("route_no", "route").alias("text"))
    return write_named(text.select(F.concat("routing", F.lit(".txt")).alias("name"), "text"), folder)


def delay_inputs(spark, sf):
    base = scratch_path(spark, "raw")
    return [result_archives(spark, sf, f"{base}/archives"), graph_files(spark, sf, f"{base}/graphs"), route_files(spark, sf, f"{base}/routes")]


@query("prepare_delay_dataset", ORACLES["delay_table"])
def prepare_delay_dataset(spark, sf):
    """Archives, graphs and routes from files: the same rows as from the tables; unusable archives add none."""
    return rounded(datasets.prepare_delay_dataset(spark, *delay_inputs(spark, sf))[0])


@query("delay_inputs_skipped", f"""
WITH s AS ({SIM_SQL}), n AS ({NODES_SQL}), ro AS ({ROUTES_SQL}),
u AS (SELECT DISTINCT split_part(manifest_line, ';', 2) AS graph, replace(split_part(manifest_line, ';', 3), '.txt', '') AS routing FROM s),
st AS (SELECT DISTINCT u.graph, u.routing, unnest(ro.nodes) AS node FROM u JOIN ro USING (routing) WHERE u.graph IN (SELECT graph FROM n)),
c AS (SELECT count(*) AS a, count(*) FILTER (WHERE line_no % 3 <> 0) AS b FROM s WHERE archive = 'sim3')
SELECT routing AS source, cast(NULL AS int) AS line_no, concat('node ', node, ' is not in ', graph) AS reason FROM st ANTI JOIN n USING (graph, node)
UNION ALL SELECT 'uneven', NULL, concat('line counts differ: input_files.txt=', a, ', simulationResults.txt=', a, ', traffic.txt=', b) FROM c WHERE a > b
UNION ALL SELECT 'gone', NULL, 'input_files.txt: no such member' WHERE EXISTS (SELECT * FROM s WHERE archive = 'sim4')
UNION ALL SELECT 'odd', cast(row_number() OVER (ORDER BY line_no) - 1 AS int), 'unreadable result line' FROM s WHERE line_no % 97 = 0
UNION ALL SELECT routing, cast(no AS int), 'not a path of node numbers' FROM (
 SELECT routing, unnest(range(0, max(route_no) + 1)) AS no FROM ro GROUP BY 1) x ANTI JOIN ro ON ro.routing = x.routing AND ro.route_no = x.no""")
def delay_inputs_skipped(spark, sf):
    """Everything of the raw files that the delay table does not hold, and why."""
    return datasets.prepare_delay_dataset(spark, *delay_inputs(spark, sf))[1]


@query("scan_archives", f"""
WITH s AS ({SIM_SQL}), o AS (SELECT *, cast(row_number() OVER (PARTITION BY archive ORDER BY line_no) - 1 AS int) AS no FROM s)
SELECT archive, 'simulationResults.txt' AS member, no AS line_no, sim_line AS line FROM o UNION ALL
SELECT archive, 'traffic.txt', no, traffic_line FROM o UNION ALL SELECT archive, 'input_files.txt', no, manifest_line FROM o""")
def scan_archives(spark, sf):
    """The lines of the archives that hold the tables' rows."""
    folder = result_archives(spark, sf, scratch_path(spark, "archives"))
    return archives.scan_archives(spark, folder).filter("line IS NOT NULL AND archive LIKE 'sim%'").drop("error")


@query("scan_routes", f"SELECT routing, route_no, array_to_string(nodes, ',') AS route FROM ({ROUTES_SQL})")
def scan_routes(spark, sf):
    scanned = archives.scan_routes(spark, route_files(spark, sf, scratch_path(spark, "routes")))
    return scanned.filter(F.col("nodes").isNotNull()).select("routing", "route_no", F.array_join(F.col("nodes").cast("array<string>"), ",").alias("route"))


@query("scan_topology_nodes", f"SELECT graph, node, policy, weights FROM ({NODES_SQL})")
def scan_topology_nodes(spark, sf):
    return archives.scan_topologies(spark, graph_files(spark, sf, scratch_path(spark, "graphs")))[0]


@query("scan_topology_edges", f"""
SELECT graph, src, dst, dst * 1000e0 AS bandwidth FROM (SELECT graph, node AS src, lead(node) OVER (PARTITION BY graph ORDER BY node) AS dst
 FROM (SELECT DISTINCT graph, node FROM ({NODES_SQL}))) WHERE dst IS NOT NULL""")
def scan_topology_edges(spark, sf):
    return archives.scan_topologies(spark, graph_files(spark, sf, scratch_path(spark, "graphs")))[1]


LINK_SQL = ORACLES["link_features"].replace("s.source_file\n", "concat(s.testbed, '_tput_all_Throughput.csv') AS source_file\n")


@query("prepare_link_dataset", LINK_SQL)
def prepare_link_dataset(spark, sf):
    """Throughput and packet files of both testbeds, with a saved row index, to the link feature table."""
    folder = scratch_path(spark, "links")
    gaps = links.inter_arrival(packets(spark, sf), PACKET_KEYS)
    for testbed in datasets.TESTBEDS:
        here = throughput_wide(spark, sf).filter(F.col("testbed") == testbed).drop("testbed", "source_file", "order_id")
        here.select(F.lit(0).alias(" "), "*").write.option("header", "true").csv(f"{folder}/{datasets.THROUGHPUT_FILE.format(testbed)}")
        sent = gaps.filter(F.col("testbed") == testbed).select(
            F.lit(0).alias(" "), F.col("epoch").alias("Timestamp"), "iat", "gnb", "sdr", F.col("bw_mhz").alias("bw"), "slots", "ratio", "direction")
        sent.write.option("header", "true").csv(f"{folder}/{datasets.PACKET_FILE.format(testbed)}")
    features = datasets.prepare_link_dataset(spark, folder)
    return rounded(features.withColumns({c: F.round(c, 4) for c in ("latency_ms", "flow_duration_sec")}), 9)


@query("prepare_flow_dataset", "SELECT * EXCLUDE (source_file) FROM (" + FLOW_FEATURE_SQL + ")")
def prepare_flow_dataset(spark, sf):
    """Flow files with more columns than are used, spaces around their names and days of two layouts."""
    folder = scratch_path(spark, "flows")
    raw = raw_flow_columns(spark, sf)
    for number, order in enumerate((RAW_COLUMNS, list(reversed(RAW_COLUMNS)))):
        part = raw.filter(F.pmod(F.xxhash64("row_id"), F.lit(2)) == number)
        part.select(*[F.col(c).alias(f" {c}") for c in order], F.lit("x").alias("Unused")).write.option("header", "true").csv(f"{folder}/days{number}")
    return rounded(datasets.prepare_flow_dataset(spark, folder).drop("source_file"))


def mixed_folder(spark, sf) -> str:
    """Datasets of several formats and layouts, one broken Parquet file, one empty text file, one excluded file."""
    root = scratch_path(spark, "mixed")
    customers = table(spark, sf, "customer").select("c_custkey", "c_acctbal", F.col("c_mktsegment").alias("Label"))
    customers.filter("c_custkey % 2 = 0").write.option("header", "true").csv(f"{root}/customers/even")
    customers.filter("c_custkey % 2 = 1").select("Label", "c_custkey").write.option("header", "true").option("sep", "\t").format("csv").save(f"{root}/customers/odd")
    table(spark, sf, "part").select("p_partkey", "p_retailprice", F.col("p_brand").alias("target")).write.parquet(f"{root}/parts")
    documents = table(spark, sf, "supplier").groupBy((F.col("s_suppkey") % 8).alias("part")).agg(
        F.to_json(F.collect_list(F.struct("s_suppkey", "s_acctbal"))).alias("text"))
    write_named(documents.select(F.format_string("whole_%d.json", "part").alias("name"), "text"), f"{root}/suppliers")
    odd = spark.createDataFrame([("broken.parquet", "not parquet"), ("empty.csv", ""), ("skip_me.csv", "a\n1\n")], "name string, text string")
    write_named(odd, f"{root}/parts")
    return root


@query("inspect_datasets", """
SELECT 'customers' AS dataset, count(*) AS total_rows, 0 AS failed_files, count(DISTINCT c_mktsegment) AS labels, max(c_custkey)::DOUBLE AS highest FROM customer WHERE c_custkey % 2 = 0
UNION ALL SELECT 'parts', count(*), 2, count(DISTINCT p_brand), max(p_partkey) FROM part
UNION ALL SELECT 'suppliers', count(*), 0, 0, max(s_suppkey) FROM supplier""")
def inspect_datasets(spark, sf):
    """Summary of every dataset below a folder; unreadable files are counted and the rest goes on."""
    root = mixed_folder(spark, sf)
    summaries, labels, errors = datasets.inspect_datasets(spark, root, exclude=["skip_me", "customers/odd"])
    keys = {"customers": "c_custkey", "parts": "p_partkey", "suppliers": "s_suppkey"}
    out = None
    for name, summary in summaries.items():
        facts = summary.agg(
            F.max(F.when(F.col("name") == "total_rows", F.col("count"))).alias("total_rows"),
            F.max(F.when(F.col("name") == keys[name], F.col("max"))).alias("highest"))
        known = labels[name].agg(F.count("*").alias("labels")) if name in labels else spark.range(1).select(F.lit(0).cast("long").alias("labels"))
        failed = errors.filter(F.col("dataset") == name).agg(F.count("*").cast("int").alias("failed_files"))
        row = facts.crossJoin(known).crossJoin(failed).select(F.lit(name).alias("dataset"), "total_rows", "failed_files", "labels", "highest")
        out = row if out is None else out.unionByName(row)
    return out


@query("file_errors", """SELECT dataset, file, error_type FROM (VALUES ('parts', 'broken.parquet', 'ArrowInvalid'), ('parts', 'empty.csv', 'EmptyDataError')) t(dataset, file, error_type)
WHERE EXISTS (SELECT * FROM part)""")
def file_errors(spark, sf):
    """One row for each file that cannot be read."""
    listed = files.discover(spark, mixed_folder(spark, sf), ["skip_me"])
    bad = listed.join(files.probe(listed), "path").filter(F.col("error_type").isNotNull())
    return bad.select("dataset", F.element_at(F.split("path", "/"), -1).alias("file"), "error_type")


@query("discovered_datasets", """SELECT 'customers' AS dataset, 'csv' AS suffix UNION ALL SELECT 'parts', 'parquet' UNION ALL
SELECT 'parts', 'csv' UNION ALL SELECT 'suppliers', 'json' WHERE EXISTS (SELECT * FROM supplier)""")
def discovered_datasets(spark, sf):
    """Datasets are the first folder below the root, however deep a file is."""
    return files.discover(spark, mixed_folder(spark, sf)).select("dataset", "suffix").distinct()
