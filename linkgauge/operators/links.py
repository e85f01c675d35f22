"""Radio link measurements and packet captures to the common feature table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkgauge.functions.numeric import clip, percent_of
from linkgauge.operators.flows import FEATURE_COLUMNS, TARGET
from linkgauge.operators.joining import null_safe_join
from linkgauge.session import materialize

# rows of a (key, time slice) that one task sorts; fuller slices are cut into at most CUTS parts
SLICE_ROWS = 1_000_000
CUTS = 1 << 20

# Keys of one radio configuration.
CONFIG_KEYS = ["gnb", "sdr", "bw_mhz", "slots", "ratio", "direction"]
SHARED_COLUMNS = ["testbed", "source_file", "gnb", "sdr", "bw", "slots", "ratio", "rep", "scenario"]
PAIRED_COLUMNS = ["mbpsactual", "meanjitterms", "meanloss", "mbpsoffered"]
LINK_TRACE_COLUMNS = [
    "testbed", "gnb", "sdr", "bw_mhz", "slots", "ratio", "rep", "direction", "offered_throughput_mbps", "source_file",
]


def unpivot_directions(wide: DataFrame) -> DataFrame:
    """One row per direction from paired ``_uplink`` / ``_downlink`` columns, in one scan."""
    sides = [
        F.struct(F.lit(side).alias("direction"),
                 *[F.col(f"{name}_{side}").cast("double").alias(name) for name in PAIRED_COLUMNS])
        for side in ("uplink", "downlink")
    ]
    shared = [F.col(c).alias("bw_mhz") if c == "bw" else F.col(c) for c in SHARED_COLUMNS]
    return wide.select(*shared, F.inline(F.array(*sides)))


def epoch_seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def iat_filter(packets: DataFrame) -> DataFrame:
    """Without the first packet of each burst (iat = 0) and unknown gaps."""
    return packets.filter(F.col("iat") > 0)


def delay_by_config(packets: DataFrame, keys: list[str]) -> DataFrame:
    """Mean gap as latency, packet count, total duration and hour of the first packet per key.

    ``packets`` has the keys, ``epoch`` (seconds) and ``iat`` (seconds). The first packet is the
    earliest by time. Rows are combined on the map side, so one hot configuration costs nothing extra.
    """
    grouped = iat_filter(packets).dropna(subset=keys).groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum("iat").alias("total"), F.var_pop("iat").alias("variance"),
        F.min("epoch").alias("first_epoch"),
    )
    hour = F.floor(F.col("first_epoch") / 3600) % 24
    return grouped.select(
        *keys,
        (F.col("total") / F.col("n") * 1000).alias("latency_ms"),
        F.col("n").alias("packet_count"),
        F.col("total").alias("flow_duration_sec"),
        F.sqrt("variance").alias("iat_std_sec"),
        F.coalesce(hour.cast("int"), F.lit(-1)).alias("time_of_day"),
    )


def _sliced(packets: DataFrame, keys: list[str], slice_seconds: float, time: str, most: int) -> tuple[DataFrame, DataFrame]:
    """``packets`` with ``_slice``, a number that grows with time, and the end of each (key, slice).

    A slice of more than ``most`` rows is cut into as many equal parts as make it even a quarter as full; slices are
    counted anyway for their ends, so nothing more is read when none is.
    """
    sliced = packets.withColumn("_slice", F.floor(F.col(time) / F.lit(float(slice_seconds))) * CUTS)
    counts = materialize(sliced.groupBy(*keys, "_slice").agg(
        F.max(time).alias("_end"), F.min(time).alias("_low"), F.count("*").alias("_rows")), "slices")
    full = counts.filter((F.col("_rows") > most) & (F.col("_low") < F.col("_end")))
    if full.isEmpty():
        return sliced, counts.select(*keys, "_slice", "_end")
    cuts = F.least(F.lit(CUTS), F.ceil(F.col("_rows") * 4 / F.lit(most)))
    # written, so that Spark sees how small it is: one row for each full slice
    cut = materialize(full.select(*keys, "_slice", "_low", (F.col("_end") - F.col("_low")).alias("_width"), cuts.alias("_cuts")), "cuts")
    inside = F.least(F.floor((F.col(time) - F.col("_low")) / F.col("_width") * F.col("_cuts")), F.col("_cuts") - 1)
    finer = null_safe_join(sliced, cut, [*keys, "_slice"], "left").withColumn("_slice", F.col("_slice") + F.coalesce(inside, F.lit(0)))
    finer = finer.drop("_low", "_width", "_cuts")
    return finer, finer.groupBy(*keys, "_slice").agg(F.max(time).alias("_end"))


def _with_previous(packets: DataFrame, keys: list[str], slice_seconds: float, time: str, last: DataFrame | None, most: int = SLICE_ROWS):
    """Add ``_slice`` and ``_previous``, the time of the packet before of the same key.

    Time is cut into slices and a window only sorts one (key, slice). The last time of the
    slice before comes from a small table with one row per (key, slice).
    """
    sliced, found = _sliced(packets, keys, slice_seconds, time, most)
    by_time = Window.partitionBy(*keys).orderBy("_slice")
    ends = found.select(*keys, "_slice", F.lag("_end").over(by_time).alias("_before"))
    if last is not None:
        ends = null_safe_join(ends, last, keys, "left").withColumn("_before", F.coalesce("_before", "last")).drop("last")
    inside = Window.partitionBy(*keys, "_slice").orderBy(time)
    return (
        null_safe_join(sliced, ends, [*keys, "_slice"])
        .withColumn("_previous", F.coalesce(F.lag(time).over(inside), F.col("_before")))
        .drop("_before")
    )


def inter_arrival(
    packets: DataFrame, keys: list[str], slice_seconds: float = 3600.0, time: str = "epoch",
    last: DataFrame | None = None, slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Gap to the previous packet of the same key in seconds; 0 for the first packet.

    NULL keys are a key of their own; a packet without time stays and has no gap.

    ``last`` (keys, last) continues from packets seen earlier.
    """
    gap = F.coalesce(F.col(time) - F.col("_previous"), F.lit(0.0))
    linked = _with_previous(packets, keys, slice_seconds, time, last, slice_rows)
    return linked.withColumn("iat", F.when(F.col(time).isNotNull(), F.greatest(F.lit(0.0), gap))).drop("_slice", "_previous")


def burst_table(
    packets: DataFrame, keys: list[str], gap_seconds: float, slice_seconds: float = 3600.0, time: str = "epoch",
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Packet trains: first and last time, packets and length per burst of each key.

    Bursts inside one time slice are finished there. Only the first and the last piece of a
    slice can belong to a burst across slices; these few rows are joined up per key. Packets without
    time belong to no train.
    """
    linked = _with_previous(packets.filter(F.col(time).isNotNull()), keys, slice_seconds, time, None, slice_rows)
    opens = F.col("_previous").isNull() | (F.col(time) - F.col("_previous") >= float(gap_seconds))
    inside = Window.partitionBy(*keys, "_slice").orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    pieces = (
        linked.withColumn("_piece", F.sum(opens.cast("int")).over(inside))
        .groupBy(*keys, "_slice", "_piece")
        .agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count("*").alias("packets"))
    )
    newest = F.max("_piece").over(Window.partitionBy(*keys, "_slice"))
    pieces = pieces.withColumn("_edge", (F.col("_piece") == 0) | (F.col("_piece") == newest))
    done = pieces.filter(~F.col("_edge")).select(*keys, "first", "last", "packets")
    along = Window.partitionBy(*keys).orderBy("_slice", "_piece").rowsBetween(Window.unboundedPreceding, 0)
    joined = (
        pieces.filter("_edge").withColumn("_burst", F.sum((F.col("_piece") > 0).cast("int")).over(along))
        .groupBy(*keys, "_burst")
        .agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("packets").alias("packets"))
        .drop("_burst")
    )
    return done.unionByName(joined).withColumn("burst_sec", F.col("last") - F.col("first"))


def link_features(throughput: DataFrame, delays: DataFrame | None, capacity_mbps: float = 150.0) -> DataFrame:
    """Throughput rows with delay facts of their configuration; -1 where nothing was measured.

    ``delays`` comes from ``delay_by_config`` with keys testbed + ``CONFIG_KEYS``: one row per
    configuration, aggregated before the join.
    """
    if delays is None:
        joined = throughput.withColumns({
            "latency_ms": F.lit(-1.0), "packet_count": F.lit(-1).cast("bigint"),
            "flow_duration_sec": F.lit(-1.0), "time_of_day": F.lit(-1),
        })
    else:
        keys = ["testbed", *CONFIG_KEYS]
        facts = delays.select(*keys, "latency_ms", "packet_count", "flow_duration_sec", "time_of_day")
        joined = throughput.join(facts, keys, "left").withColumns({
            "latency_ms": F.coalesce("latency_ms", F.lit(-1.0)),
            "packet_count": F.coalesce("packet_count", F.lit(-1).cast("bigint")),
            "flow_duration_sec": F.coalesce("flow_duration_sec", F.lit(-1.0)),
            "time_of_day": F.coalesce("time_of_day", F.lit(-1)),
        })
    return joined.select(
        "*",
        F.col("meanjitterms").alias("jitter_ms"),
        clip(F.col("meanloss") * 100, 0, 100).alias("packet_loss_percent"),
        clip(F.col("mbpsoffered") / F.lit(float(capacity_mbps)) * 100, 0, 100).alias("bandwidth_utilization_percent"),
        F.col("mbpsactual").alias("actual_throughput_mbps"),
        F.lit("UDP").alias("protocol"),
        F.lit("throughput_test").alias("application_type"),
        F.lit("5G").alias("link_type"),
        percent_of(F.col("mbpsactual"), F.col("mbpsoffered")).alias(TARGET),
        F.col("mbpsoffered").alias("offered_throughput_mbps"),
    ).select(*FEATURE_COLUMNS, TARGET, *LINK_TRACE_COLUMNS)
