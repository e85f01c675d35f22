"""Raw folders to prepared tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkgauge.functions.numeric import number_in_text, whole
from linkgauge.operators.delays import flow_rows, skipped_lines, unknown_nodes
from linkgauge.operators.flows import RAW_COLUMNS, flow_features
from linkgauge.operators.links import CONFIG_KEYS, delay_by_config, link_features, unpivot_directions
from linkgauge.operators.profiling import (
    clean_dataset, cleaning_summary, dataset_summary, detect_label, label_counts,
)
from linkgauge.operators.splitting import quota_sample
from linkgauge.session import materialize
from linkgauge.sources.archives import bad_routes, bad_topologies, join_members, scan_archives, scan_routes, scan_topologies
from linkgauge.sources.files import (
    align_columns, discover, drop_index, missing_tokens_to_null, probe, prune_columns, scan_dataset, scan_delimited,
    split_header, strip_columns,
)
from linkgauge.sources.sinks import write_table

# Names of the link measurement files.
TESTBEDS = ["ntnu", "wue"]
THROUGHPUT_FILE = "{}_tput_all_Throughput.csv"
PACKET_FILE = "{}_owd_Packets_with_IATs.csv"


def _delimited(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    header = spark.read.text(path).head(1)[0][0]
    return missing_tokens_to_null(scan_delimited(spark, path, split_header(header, sep), sep))


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def probed_files(spark: SparkSession, root: str, exclude: list[str] | None = None) -> tuple[dict, list]:
    """Readable files by dataset and error rows; only the listing reaches the driver."""
    listed = discover(spark, root, exclude)
    joined = listed.join(probe(listed), "path").orderBy("path")
    readable: dict[str, list] = {}
    errors = []
    for row in joined.toLocalIterator():
        entry = row.asDict()
        if entry["error_type"]:
            errors.append((entry["dataset"], entry["path"], entry["error_type"], entry["error_message"]))
            readable.setdefault(entry["dataset"], [])
        else:
            readable.setdefault(entry["dataset"], []).append(entry)
    return readable, errors


def inspect_datasets(
    spark: SparkSession, root: str, label: str | None = None, exclude: list[str] | None = None
) -> tuple[dict[str, DataFrame], dict[str, DataFrame], DataFrame]:
    """Summary and label counts per dataset, and a table of unreadable files."""
    readable, errors = probed_files(spark, root, exclude)
    summaries, labels = {}, {}
    for dataset, files in sorted(readable.items()):
        failed = sum(1 for e in errors if e[0] == dataset)
        if not files:
            continue
        df = scan_dataset(spark, files)
        found = detect_label(df.columns, label)
        summaries[dataset] = dataset_summary(df, len(files) + failed, failed, found)
        if found:
            labels[dataset] = label_counts(df, found)
    table = spark.createDataFrame(errors, "dataset string, file string, error_type string, error_message string")
    return summaries, labels, table


def clean_datasets(
    spark: SparkSession, root: str, output: str, policy: str = "all", required: list[str] | None = None,
    label: str | None = None, threshold: float = 0.60, exclude: list[str] | None = None,
) -> DataFrame:
    """Clean every dataset below a folder, write each, return one summary row per dataset."""
    readable, errors = probed_files(spark, root, exclude)
    if errors:
        raise ValueError(f"unreadable files: {[e[1] for e in errors]}")
    summaries = []
    for dataset, files in sorted(readable.items()):
        df = scan_dataset(spark, files)
        cleaned, facts = clean_dataset(df, policy, required, label)
        path = f"{output}/{dataset}"
        write_table(cleaned, path)
        written = spark.read.schema(cleaned.schema).parquet(path)
        summaries.append(cleaning_summary(dataset, df, written, facts, policy, threshold).withColumn(
            "input_files", F.lit(len(files))).withColumn("cleaned_output", F.lit(path)))
    return align_columns(summaries)


def typed_keys(df: DataFrame, bandwidth: str) -> DataFrame:
    """Configuration keys of text files as numbers, so that ``20`` and ``20.0`` meet; a ratio may be a word."""
    keys = {c: whole(number_in_text(F.col(c))).cast("int") for c in (bandwidth, "slots", "rep") if c in df.columns}
    ratio = F.coalesce(number_in_text(F.col("ratio")).cast("string"), F.col("ratio"))
    return df.withColumns({**keys, "ratio": ratio})


def load_throughput(spark: SparkSession, folder: str) -> DataFrame:
    """Throughput files of all testbeds that exist, with provenance columns."""
    frames = []
    for testbed in TESTBEDS:
        path = f"{folder}/{THROUGHPUT_FILE.format(testbed)}"
        if _exists(spark, path):
            frames.append(drop_index(_delimited(spark, path)).withColumns({
                "testbed": F.lit(testbed), "source_file": F.lit(path.rsplit("/", 1)[-1])}))
    if not frames:
        raise FileNotFoundError(f"no throughput files found in {folder}")
    return typed_keys(align_columns(frames), "bw")


def load_packets(spark: SparkSession, folder: str) -> DataFrame | None:
    frames = []
    for testbed in TESTBEDS:
        path = f"{folder}/{PACKET_FILE.format(testbed)}"
        if _exists(spark, path):
            raw = _delimited(spark, path)
            frames.append(raw.select(
                F.lit(testbed).alias("testbed"), "gnb", "sdr", F.col("bw").alias("bw_mhz"), "slots", "ratio",
                "direction", F.col("Timestamp").try_cast("double").alias("epoch"),
                F.col("iat").try_cast("double").alias("iat")))
    return typed_keys(align_columns(frames), "bw_mhz") if frames else None


def prepare_link_dataset(
    spark: SparkSession, folder: str, capacity_mbps: float = 150.0, skip_packets: bool = False
) -> DataFrame:
    """Throughput and packet files to the link feature table."""
    throughput = unpivot_directions(load_throughput(spark, folder))
    packets = None if skip_packets else load_packets(spark, folder)
    delays = None if packets is None else delay_by_config(packets, ["testbed", *CONFIG_KEYS])
    table = link_features(throughput, delays, capacity_mbps)
    return table.withColumns({c: F.col(c).try_cast("int") for c in ("bw_mhz", "slots", "rep")})


def prepare_flow_dataset(
    spark: SparkSession, folder: str, sample: int | None = None, capacity_mbps: float = 1000.0, seed: int = 42
) -> DataFrame:
    """Flow CSV files to the flow feature table, optionally an even sample per file.

    Unreadable CSV files stop the job. Whole rows are parsed (a pruned parse misses rows that are too long).
    """
    readable, errors = probed_files(spark, folder)
    if errors := [e for e in errors if e[1].lower().endswith(".csv")]:
        raise ValueError(f"unreadable files: {[e[1] for e in errors]}")
    layouts: dict[str, list[str]] = {}
    for files in readable.values():
        for entry in files:
            if entry["suffix"] == "csv":
                layouts.setdefault(entry["header"], []).append(entry["path"])
    if not layouts:
        raise FileNotFoundError(f"no CSV files found in {folder}")
    frames = []
    for header, paths in layouts.items():
        names = split_header(header, ",")
        raw = scan_delimited(spark, paths, names, source_file="source_file")
        frames.append(prune_columns(missing_tokens_to_null(strip_columns(raw)), [*RAW_COLUMNS, "source_file"]))
    features = flow_features(align_columns(frames), capacity_mbps)
    if sample is None:
        return features
    identity = [c for c in features.columns if c != "source_file"]
    return quota_sample(features, "source_file", identity, sample, seed)


def prepare_delay_dataset(
    spark: SparkSession, archives: str, graphs: str, routes: str, strict: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Result archives, topologies and routes to the delay table, and a table of what was skipped.

    The second table has source (an archive, graph or routing), line_no and reason: archives that break off, lack a
    member or have uneven line counts, lines with broken bytes or without the numbers they need, bad graphs and
    routes, and nodes of routes that a graph does not have. Nothing of this ends the job.
    """
    nodes, edges = scan_topologies(spark, graphs)
    nodes, edges, paths = (materialize(t, "inputs") for t in (nodes, edges, scan_routes(spark, routes)))
    lines, skipped = join_members(scan_archives(spark, archives))
    number = F.col("line_no").cast("int").alias("line_no")
    none = F.lit(None).cast("int").alias("line_no")
    reports = [
        skipped.select(F.col("archive").alias("source"), number, F.concat_ws(": ", "member", "reason").alias("reason")),
        skipped_lines(lines).select(F.col("archive").alias("source"), number, F.concat(F.lit("unreadable "), "reason").alias("reason")),
        bad_topologies(nodes, edges).select(F.col("graph").alias("source"), none, "reason"),
        bad_routes(paths).select(F.col("routing").alias("source"), F.col("route_no").alias("line_no"), "reason"),
        unknown_nodes(lines, paths, nodes).select(
            F.col("routing").alias("source"), none, F.concat(F.lit("node "), F.col("node").cast("string"), F.lit(" is not in "), "graph").alias("reason")),
    ]
    return flow_rows(lines, nodes.filter(F.col("node").isNotNull()), paths, strict), reduce(DataFrame.unionAll, reports)
