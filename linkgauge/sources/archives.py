"""Simulator inputs: result archives, route files and topology files."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from linkgauge.functions.parsing import path_nodes
from linkgauge.session import materialize
from linkgauge.sources.files import located

# The three text members of a result archive.
MEMBERS = {"simulationResults.txt": "sim_line", "traffic.txt": "traffic_line", "input_files.txt": "manifest_line"}

# error: why a line, a member or the rest of the archive could not be read
LINE_SCHEMA = "archive string, member string, line_no int, line string, error string"
NODE_SCHEMA = "graph string, node int, policy string, weights string"
EDGE_SCHEMA = "graph string, src int, dst int, bandwidth double"
SKIPPED_SCHEMA = "archive string, member string, line_no int, reason string"
BATCH_LINES = 10_000


class ArchivePart(InputPartition):
    """One archive; a gzip stream can only be read from its start."""

    def __init__(self, path: str):
        super().__init__(path)


class ArchiveReader(DataSourceReader):
    """Lines of the text members, as Arrow batches while the archive is unpacked."""

    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self) -> list[ArchivePart]:
        return [ArchivePart(path) for path in self.paths]

    def read(self, partition: ArchivePart) -> Iterator:
        import pyarrow as pa

        schema = pa.schema([("archive", pa.string()), ("member", pa.string()), ("line_no", pa.int32()), ("line", pa.string()), ("error", pa.string())])
        rows: list[tuple] = []
        for row in archive_lines(partition.value):
            rows.append(row)
            if len(rows) >= BATCH_LINES:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


class ArchiveSource(DataSource):
    """``spark.read.format("result_archives").option("paths", json list)``: a partition for each archive."""

    @classmethod
    def name(cls) -> str:
        return "result_archives"

    def schema(self) -> str:
        return LINE_SCHEMA

    def reader(self, schema) -> ArchiveReader:
        import json

        return ArchiveReader(json.loads(self.options["paths"]))


def archive_lines(path: str) -> Iterator[tuple]:
    """(archive, member, line_no, line, error) of one tar.gz, read as a stream: what is held is one line.

    The first member of each kind counts. Bytes that are not UTF-8 become U+FFFD and an error of their line. An
    archive that breaks off is an error without member, after the lines that could be read.
    """
    import tarfile

    archive = path.rsplit("/", 1)[-1].removesuffix(".gz").replace(".tar", "")
    seen: set[str] = set()
    try:
        filesystem, inner = located(path)
        with filesystem.open_input_stream(inner, compression="gzip") as stream, tarfile.open(fileobj=stream, mode="r|") as tar:
            for member in tar:
                suffix = next((s for s in MEMBERS if member.name.endswith(s)), None)
                if suffix is None or suffix in seen or not member.isfile():
                    continue
                seen.add(suffix)
                kept = 0
                for raw in tar.extractfile(member):
                    if raw.strip():
                        line = raw.rstrip(b"\r\n")
                        text = line.decode("utf-8", "replace")
                        yield archive, suffix, kept, text, "bytes that are not UTF-8" if "\ufffd" in text and text.encode() != line else None
                        kept += 1
            while stream.read(1 << 20):  # the checksum stands at the end of the stream
                pass
    except Exception as error:
        yield archive, None, None, None, f"{type(error).__name__}: {error}"
        return
    for suffix in MEMBERS:
        if suffix not in seen:
            yield archive, suffix, None, None, "no such member"


def scan_archives(spark: SparkSession, folder: str) -> DataFrame:
    """The non-blank lines of the three members of each tar.gz file, and what could not be read (see ``LINE_SCHEMA``).

    Only the listing is read here; each archive is a partition, unpacked as a stream.
    """
    import json

    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.tar.gz").load(folder).select("path")
    paths = sorted(r["path"] for r in listed.toLocalIterator())
    if not paths:
        return spark.createDataFrame([], LINE_SCHEMA)
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("result_archives").option("paths", json.dumps(paths)).load()


def join_members(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The three members side by side by (archive, line number), and what was skipped (see ``SKIPPED_SCHEMA``).

    An archive is left out when it breaks off, a member is missing or the line counts differ. Lines with broken
    bytes stay and are reported. Lines are written once: an archive can only be unpacked by one task, its lines can
    then be read by many and column by column.
    """
    if "error" not in lines.columns:
        lines = lines.withColumn("error", F.lit(None).cast("string"))
    read = materialize(lines, "members")
    told = read.filter(F.col("error").isNotNull()).select("archive", "member", "line_no", F.col("error").alias("reason"))
    counts = read.filter(F.col("line").isNotNull()).groupBy("archive", "member").count()
    spans = counts.groupBy("archive").agg(F.min("count").alias("low"), F.max("count").alias("high"), F.sort_array(F.collect_list(
        F.concat_ws("=", "member", F.col("count").cast("string")))).alias("each"))
    uneven = spans.filter("low < high").select(
        "archive", F.lit(None).cast("string").alias("member"), F.lit(None).cast("int").alias("line_no"),
        F.concat(F.lit("line counts differ: "), F.array_join("each", ", ")).alias("reason"))
    # at most a few rows for each archive; written, so Spark sees how small it is and does not shuffle the lines
    skipped = materialize(told.unionAll(uneven), "skipped")
    broken = skipped.filter(F.col("line_no").isNull()).select("archive").distinct()
    wide = [F.max(F.when(F.col("member") == member, F.col("line"))).alias(column) for member, column in MEMBERS.items()]
    kept = read.filter(F.col("line").isNotNull()).join(broken, "archive", "left_anti")
    return materialize(kept.groupBy("archive", "line_no").agg(*wide), "lines"), skipped


def scan_routes(spark: SparkSession, folder: str) -> DataFrame:
    """One comma path per non-blank line: (routing, route_no, nodes); name without '.txt'.

    A line with anything but whole numbers keeps its number and has no nodes: see ``bad_routes``.
    """
    text = spark.read.option("pathGlobFilter", "*").text(folder).select(
        F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("position"),
        "value",
    )
    lines = text.filter(F.trim("value") != "")
    return number_routes(lines.withColumn("routing", routing_name(F.col("file"))))


def bad_routes(routes: DataFrame) -> DataFrame:
    """routing, route_no, reason of the lines that are no path."""
    return routes.filter(F.col("nodes").isNull()).select("routing", "route_no", F.lit("not a path of node numbers").alias("reason"))


def routing_name(col):
    return F.regexp_replace(F.trim(col), r"\.txt$", "")


def number_routes(lines: DataFrame) -> DataFrame:
    """Number the lines of each route file by position.

    A window only sees one block of a file; the lines of the blocks before come from a small table.
    """
    before = Window.partitionBy("routing").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = lines.groupBy("routing", "block").agg(F.count("*").alias("rows")).select(
        "routing", "block", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before")
    )
    inside = Window.partitionBy("routing", "block").orderBy("position")
    return lines.join(blocks, ["routing", "block"]).select(
        "routing",
        (F.col("before") + F.row_number().over(inside) - 1).cast("int").alias("route_no"),
        path_nodes(F.col("value")).alias("nodes"),
    )


def _entry(block: Column, name: str) -> Column:
    """The value of a key in a GML block, quoted or plain; NULL without it."""
    plain = F.regexp_extract(block, rf"(?:^|\s){name}\s+(?:\"([^\"]*)\"|([^\s\"]+))", 1)
    bare = F.regexp_extract(block, rf"(?:^|\s){name}\s+([^\s\"]+)", 1)
    return F.when(plain != "", plain).when(bare != "", bare)


def scan_topologies(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Node table (policy, weights) and edge table of the GML files in a folder.

    A file is read as one text and its blocks are found by one pattern, all in the JVM. An edge's ends are the labels
    of its nodes. Values that are no numbers give NULL: see ``bad_topologies``.
    """
    texts = spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("graph"), "value")

    def blocks(kind: str) -> DataFrame:
        return texts.select("graph", F.explode(F.regexp_extract_all("value", F.lit(rf"(?s)\b{kind}\s*\[(.*?)\]"), F.lit(1))).alias("block"))

    named = blocks("node").select(
        "graph", _entry(F.col("block"), "id").alias("id"), F.coalesce(_entry(F.col("block"), "label"), _entry(F.col("block"), "id")).try_cast("int").alias("node"),
        F.coalesce(_entry(F.col("block"), "schedulingPolicy"), F.lit("WFQ")).alias("policy"),
        F.coalesce(_entry(F.col("block"), "schedulingWeights"), F.lit("60,30,10")).alias("weights"))
    ends = blocks("edge").select("graph", *[_entry(F.col("block"), c).alias(c) for c in ("source", "target")], _entry(F.col("block"), "bandwidth").try_cast("double").alias("bandwidth"))
    for end, column in (("source", "src"), ("target", "dst")):
        labels = named.select("graph", F.col("id").alias(end), F.col("node").alias(column))
        ends = ends.join(labels, ["graph", end], "left")
    return named.select("graph", "node", "policy", "weights"), ends.select("graph", "src", "dst", "bandwidth")


def bad_topologies(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """graph, reason: nodes without a number, edges to unknown nodes, weights that are no numbers."""
    weights = F.exists(F.split("weights", ","), lambda w: F.trim(w).try_cast("double").isNull()) & (F.col("policy") != "SP")
    found = [
        nodes.filter(F.col("node").isNull()).select("graph", F.lit("a node without a number").alias("reason")),
        nodes.filter(weights).select("graph", F.lit("weights that are no numbers").alias("reason")),
        edges.filter(F.col("src").isNull() | F.col("dst").isNull()).select("graph", F.lit("an edge to an unknown node").alias("reason")),
    ]
    return reduce(DataFrame.unionAll, found)
