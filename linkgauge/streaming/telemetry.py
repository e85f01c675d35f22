"""Telemetry as streams. Every function takes and returns a DataFrame, streaming or not."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkgauge.functions.numeric import share
from linkgauge.functions.rules import sla_threshold
from linkgauge.operators.profiling import profile_columns


def event_time(df: DataFrame, column: str = "ts", late: str | None = "10 minutes") -> DataFrame:
    """Zone-less time to a timestamp, with a watermark that bounds the state."""
    timed = df.withColumn(column, F.col(column).cast("timestamp"))
    return timed.withWatermark(column, late) if late else timed


def profile_columns_stream(df: DataFrame) -> DataFrame:
    """Running profile of all columns: the batch operator, whose state is one row of counters."""
    return profile_columns(df)


def delay_windows(packets: DataFrame, keys: list[str], size: str = "1 day", time: str = "ts") -> DataFrame:
    """Mean gap, packet count and duration per key and tumbling window of event time."""
    return packets.filter(F.col("iat") > 0).groupBy(F.window(time, size).alias("w"), *keys).agg(
        F.count("*").alias("packet_count"), F.sum("iat").alias("flow_duration_sec"),
        F.avg("iat").alias("mean_iat"),
    ).select(
        F.col("w.start").alias("window_start"), *keys, "packet_count", "flow_duration_sec",
        (F.col("mean_iat") * 1000).alias("latency_ms"),
    )


def sla_monitor(
    delays: DataFrame, sla_ms: dict[str, float], alarm_rate: float = 0.1, size: str = "1 day",
    slide: str | None = None, time: str = "ts",
) -> DataFrame:
    """Violations, rate and alarm per window and class; give ``slide`` for overlapping windows."""
    window = F.window(time, size, slide) if slide else F.window(time, size)
    over = F.col("delay_ms") > sla_threshold(F.col("qos_class"), sla_ms)
    counts = delays.groupBy(window.alias("w"), "qos_class").agg(
        F.count("*").alias("rows"), F.count_if(over).alias("violations")
    )
    rate = share(F.col("violations"), F.col("rows"))
    return counts.select(
        F.col("w.start").alias("window_start"), "qos_class", "rows", "violations", rate.alias("violation_rate"),
        (rate > alarm_rate).alias("alarm"),
    )


def bursts(packets: DataFrame, keys: list[str], gap: str = "5 minutes", time: str = "ts") -> DataFrame:
    """Packet trains: packets of a key closer than the gap; length and packet count per burst."""
    grouped = packets.groupBy(F.session_window(time, gap).alias("s"), *keys).agg(
        F.count("*").alias("packets"), F.min(time).alias("first_ts"), F.max(time).alias("last_ts")
    )
    length = (F.unix_micros("last_ts") - F.unix_micros("first_ts")) / 1e6
    return grouped.select(*keys, "first_ts", "packets", length.alias("burst_sec"))


def open_bursts(state: DataFrame, keys: list[str]) -> DataFrame:
    """The bursts that ``bursts`` has not closed, from its state (``runner.open_state``)."""
    v = lambda name: F.col(f"value.{name}")
    length = (F.unix_micros(v("max")) - F.unix_micros(v("min"))) / 1e6
    return state.select(*[F.col(f"key.{k}").alias(k) for k in keys], v("min").alias("first_ts"), v("count").alias("packets"), length.alias("burst_sec"))


def recommend_batch(pattern: DataFrame, predict_log_delay, profiles=None, sla_ms=None) -> DataFrame:
    """The profile to use for one micro-batch of traffic, or ``infeasible``."""
    from linkgauge.operators.allocation import evaluate_profiles

    best = evaluate_profiles(pattern, predict_log_delay, profiles, sla_ms).filter("recommended")
    return best.select(
        F.when(F.col("sla_feasible"), F.col("profile")).otherwise(F.lit("infeasible")).alias("decision"),
        "profile", "sla_feasible", "traffic_rows", "weighted_violation_score", "weighted_delay_score",
    )
