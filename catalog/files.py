"""Queries for file formats: the given tables written out in a format and read back by a scan."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.adapters import table
from catalog.registry import query
from linkgauge.session import scratch_path
from linkgauge.sources import files, sinks


@query("scan_delimited", """
SELECT cast(c_custkey AS varchar) AS key, concat(c_name, ', "', c_mktsegment, '"') AS name,
 CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END AS segment FROM customer""")
def scan_delimited(spark, sf):
    """Quoted separators and missing-value texts survive a CSV file."""
    path = scratch_path(spark, "csv")
    table(spark, sf, "customer").select(
        F.col("c_custkey").alias("key"), F.format_string('%s, "%s"', "c_name", "c_mktsegment").alias(" name "),
        F.when(F.col("c_custkey") % 7 == 0, F.lit("N/A")).otherwise(F.col("c_mktsegment")).alias("segment"),
    ).write.option("header", "true").option("escape", '"').csv(path)
    scanned = files.scan_delimited(spark, path, files.split_header("key, name ,segment", ","))
    return files.missing_tokens_to_null(scanned)


@query("scan_delimited_long_rows", """
SELECT cast(p_partkey AS varchar) AS key, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_name END AS name FROM part
WHERE p_partkey % 11 <> 0""")
def scan_delimited_long_rows(spark, sf):
    """Rows with too many fields are skipped, short rows are padded."""
    path = scratch_path(spark, "tsv")
    line = (
        F.when(F.col("p_partkey") % 11 == 0, F.concat_ws("\t", F.col("p_partkey").cast("string"), "p_name", F.lit("more")))
        .when(F.col("p_partkey") % 5 == 0, F.col("p_partkey").cast("string"))
        .otherwise(F.concat_ws("\t", F.col("p_partkey").cast("string"), "p_name"))
    )
    table(spark, sf, "part").select(line.alias("value")).write.text(path)
    return files.scan_delimited(spark, path, ["key", "name"], "\t", header=False)


@query("scan_quoted_line_breaks", """
SELECT cast(c_custkey AS varchar) AS key, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE concat(c_name, chr(10), '"', c_mktsegment, '",', chr(10)) END AS name
FROM customer WHERE c_custkey % 11 <> 0""")
def scan_quoted_line_breaks(spark, sf):
    """Fields with line breaks, quotes and separators; short rows are padded, long rows skipped."""
    path = scratch_path(spark, "csv")
    name = F.concat(F.lit('"'), F.col("c_name"), F.lit('\n""'), "c_mktsegment", F.lit('"",\n"'))
    key = F.col("c_custkey").cast("string")
    line = F.when(F.col("c_custkey") % 11 == 0, F.concat_ws(",", key, name, F.lit('"more\n"'))).when(F.col("c_custkey") % 5 == 0, key).otherwise(F.concat_ws(",", key, name))
    table(spark, sf, "customer").select(line.alias("value")).write.text(path)
    return files.scan_records(spark, path, ["key", "name"], header=False)


@query("scan_json_lines", "SELECT event_id, event_type, value FROM events")
def scan_json_lines(spark, sf):
    path = scratch_path(spark, "json")
    table(spark, sf, "events").select("event_id", "event_type", "value").write.json(path)
    return files.scan_json(spark, path, lines=True).select("event_id", "event_type", "value")


@query("write_partitioned", "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")
def write_partitioned(spark, sf):
    path = scratch_path(spark, "table")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    sinks.write_table(orders, path, ["o_orderstatus"])
    return spark.read.schema(orders.schema).parquet(path)


@query("append_report", """
SELECT o_orderpriority, count(*) AS rows, cast(1 AS int) AS run FROM orders GROUP BY 1
UNION ALL SELECT o_orderpriority, count(*), 2 FROM orders GROUP BY 1""")
def append_report(spark, sf):
    path = scratch_path(spark, "report")
    for run in (1, 2):
        counts = table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("rows"))
        sinks.append_report(counts.withColumn("run", F.lit(run)), path)
    return spark.read.parquet(path).filter(F.length("run_timestamp") == 19).drop("run_timestamp")


@query("discover_files")
def discover_files(spark, sf):
    """Every table file with its size and dataset name."""
    found = files.discover(spark, sf)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("file"), "length", "suffix", "dataset")
