"""Recorded flows to the common feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkgauge.functions.numeric import MISSING_TOKENS, clip, finite, number_of, parsed_once, whole
from linkgauge.functions.rules import (
    clean_label_keep, infer_application, infer_protocol, recommend_bandwidth_flow,
)

# The raw columns that are read.
RAW_COLUMNS = [
    "Destination Port", "Flow Duration", "Total Fwd Packets", "Total Backward Packets",
    "Total Length of Fwd Packets", "Total Length of Bwd Packets", "Flow Bytes/s", "Flow IAT Mean",
    "Flow IAT Std", "RST Flag Count", "Label",
]

# Columns of the common feature table, in order.
FEATURE_COLUMNS = [
    "latency_ms", "jitter_ms", "packet_loss_percent", "bandwidth_utilization_percent",
    "actual_throughput_mbps", "flow_duration_sec", "packet_count", "protocol", "application_type",
    "link_type", "time_of_day",
]
TARGET = "recommended_bandwidth_percent"
FLOW_TRACE_COLUMNS = ["attack_label", "is_attack", "source_file", "destination_port", "byte_count"]


def flow_features(df: DataFrame, capacity_mbps: float = 1000.0) -> DataFrame:
    """Latency, jitter, loss and load proxies per flow; a row with any missing value is dropped.

    ``df`` holds the raw columns (names already trimmed) and ``source_file``. Rows are dropped on
    the raw values, so the filter sits right above the scan and derives nothing twice; texts are parsed once, below it.
    """
    df = parsed_once(df, [c for c in RAW_COLUMNS if c != "Label"])
    value = lambda name: finite(number_of(df, name))
    label = F.when(~F.col("Label").isin(MISSING_TOKENS), F.col("Label"))
    base = df.select(
        value("Flow IAT Mean").alias("iat_mean"),
        value("Flow IAT Std").alias("iat_std"),
        value("Flow Bytes/s").alias("bytes_per_sec"),
        value("Flow Duration").alias("duration_us"),
        value("RST Flag Count").alias("resets"),
        (whole(value("Total Fwd Packets")) + whole(value("Total Backward Packets")))
        .alias("packet_count"),
        (value("Total Length of Fwd Packets") + value("Total Length of Bwd Packets")).alias("byte_count"),
        whole(value("Destination Port")).alias("destination_port"),
        clean_label_keep(label).alias("attack_label"),
        "source_file",
    ).dropna(subset=["iat_mean", "iat_std", "bytes_per_sec", "duration_us", "packet_count", "byte_count",
                     "destination_port", "source_file"])
    mbps = F.col("bytes_per_sec") * 8 / 1_000_000
    features = base.select(
        (F.col("iat_mean") / 1000).alias("latency_ms"),
        (F.col("iat_std") / 1000).alias("jitter_ms"),
        F.when(F.col("resets") > 0, F.lit(1.0)).otherwise(F.lit(0.0)).alias("packet_loss_percent"),
        clip(mbps / F.lit(float(capacity_mbps)) * 100, 0, 100).alias("bandwidth_utilization_percent"),
        mbps.alias("actual_throughput_mbps"),
        (F.col("duration_us") / 1_000_000).alias("flow_duration_sec"),
        "packet_count",
        infer_protocol(F.col("destination_port")).alias("protocol"),
        infer_application(F.col("destination_port")).alias("application_type"),
        F.lit("unknown").alias("link_type"),
        F.lit(-1).alias("time_of_day"),
        "attack_label",
        (F.upper("attack_label") != "BENIGN").cast("int").alias("is_attack"),
        "source_file",
        "destination_port",
        "byte_count",
    )
    points = recommend_bandwidth_flow(
        F.col("application_type"), F.col("latency_ms"), F.col("jitter_ms"), F.col("packet_loss_percent"),
        F.col("bandwidth_utilization_percent"), F.col("is_attack"),
    )
    return features.withColumn(TARGET, points).select(*FEATURE_COLUMNS, TARGET, *FLOW_TRACE_COLUMNS)
