"""Stream queries, run to the end of the given tables and compared with the batch answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.adapters import DELAY_SQL, PACKET_KEYS_SQL, PACKETS, packet_columns, table
from catalog.allocation import CANDIDATES, SUMMARY, _scores, formula
from catalog.registry import query, r, rounded
from linkgauge.operators.links import burst_table
from linkgauge.session import scratch_path
from linkgauge.streaming import runner, telemetry


PARTS = 4
# the events in four parts that arrive one after the other, every tenth row one part late
PART_SQL = f"""x AS (SELECT *, epoch_us(ts) / 1e6 AS seconds FROM events), b AS (SELECT min(seconds) AS low, max(seconds) AS high FROM x),
e AS (SELECT x.*, cast(least(floor((seconds - low) / ((high - low) / {PARTS} + 1)) + CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END, {PARTS - 1}) AS int) AS part
 FROM x, b),
m AS (SELECT part, date_trunc('milliseconds', max(ts)) AS top FROM e GROUP BY 1),
k AS (SELECT part, max(top) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL '1 day' AS mark FROM m)"""


def arrivals(spark, sf):
    """A folder into which the parts arrive, one for each step of the iteration; yields (folder, schema).

    The events are read once and written by part; every run of a query after a step is a restart.
    """
    events = table(spark, sf, "events")
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    low, high = events.agg(F.min(seconds), F.max(seconds)).first()
    part = F.floor((seconds - low) / ((high - low) / PARTS + 1)) + F.when(F.col("event_id") % 10 == 0, 1).otherwise(0)
    waiting, folder = scratch_path(spark, "waiting"), scratch_path(spark, "events")
    events.withColumn("part", F.least(part, F.lit(PARTS - 1)).cast("int")).write.partitionBy("part").parquet(waiting)
    for number in range(PARTS):
        spark.read.schema(events.schema).parquet(f"{waiting}/part={number}").write.mode("append").parquet(folder)
        yield folder, events.schema


def run_arrivals(spark, sf, run):
    """The result of ``run(stream, path)`` after the last part; each part is a run of its own from the same path."""
    base, out = scratch_path(spark, "stream"), None
    for folder, schema in arrivals(spark, sf):
        out = run(runner.file_stream(spark, folder, schema), base)
    return out


COUNTED = ("event_id", "event_type", "value")


def _counter_sql(column: str) -> str:
    v = f"try_cast(cast({column} AS varchar) AS double)"
    return (f"SELECT '{column}' AS \"column\", count({column}) AS non_null_count, count(*) - count({column}) AS missing_count, "
            f"count({v}) AS numeric_count, cast(0 AS bigint) AS infinite_count, "
            f"round(min({v}), 6) AS min, round(max({v}), 6) AS max, round(avg({v}), 6) AS mean FROM events")


@query("stream_profile", " UNION ALL ".join(_counter_sql(c) for c in COUNTED))
def stream_profile(spark, sf):
    """All fields of the running profile, over four parts with restarts."""
    def run(events, base):
        return runner.run_updates(telemetry.profile_columns_stream(events.select(*COUNTED)), ["column"], path=base)

    out = run_arrivals(spark, sf, run)
    return rounded(out.select("column", "non_null_count", "missing_count", "numeric_count", "infinite_count", "min", "max", "mean"))


@query("stream_delay_windows", """
SELECT time_bucket(INTERVAL '1 day', ts) AS window_start, event_type, count(*) AS packet_count,
 round(sum(value), 4) AS flow_duration_sec, round(avg(value) * 1000, 4) AS latency_ms FROM events WHERE value > 0 GROUP BY 1, 2""")
def stream_delay_windows(spark, sf):
    """A watermark that waits longer than any row is late: nothing is lost."""
    def run(events, base):
        timed = telemetry.event_time(events, late="365 days").withColumn("iat", F.col("value"))
        return runner.run_updates(telemetry.delay_windows(timed, ["event_type"]), ["window_start", "event_type"], path=base)

    return rounded(run_arrivals(spark, sf, run).withColumn("window_start", F.col("window_start").cast("timestamp_ntz")), 4)


CLASS_OF_EVENT = "CASE event_type WHEN 'click' THEN 'Gold' WHEN 'view' THEN 'Silver' ELSE 'Bronze' END"
LIMIT_OF_CLASS = "CASE qos_class WHEN 'Gold' THEN 30e0 WHEN 'Silver' THEN 50e0 ELSE 60e0 END"
SLA = {"Gold": 30.0, "Silver": 50.0, "Bronze": 60.0}
MONITOR = f"""SELECT w AS window_start, qos_class, count(*) AS rows, count(*) FILTER (WHERE value > {LIMIT_OF_CLASS}) AS violations,
 round(count(*) FILTER (WHERE value > {LIMIT_OF_CLASS}) / count(*), 6) AS violation_rate,
 count(*) FILTER (WHERE value > {LIMIT_OF_CLASS}) / count(*) > 0.35e0 AS alarm FROM d GROUP BY 1, 2"""


def _monitor_sql(windows: str) -> str:
    """A row counts for a window unless the watermark (a day behind the parts before) has passed its end."""
    return f"""WITH {PART_SQL}, o AS ({windows}),
d AS (SELECT w, {CLASS_OF_EVENT} AS qos_class, value FROM o JOIN k USING (part) WHERE mark IS NULL OR w + INTERVAL '1 day' > mark) {MONITOR}"""


def _monitor(spark, sf, slide):
    def run(events, base):
        timed = telemetry.event_time(events, late="1 day")
        delays = timed.select("ts", F.expr(CLASS_OF_EVENT).alias("qos_class"), F.col("value").alias("delay_ms"))
        return runner.run_updates(telemetry.sla_monitor(delays, SLA, 0.35, "1 day", slide), ["window_start", "qos_class"], path=base)

    return rounded(run_arrivals(spark, sf, run).withColumn("window_start", F.col("window_start").cast("timestamp_ntz")))


@query("stream_sla_monitor", _monitor_sql("SELECT *, time_bucket(INTERVAL '1 day', ts) AS w FROM e"))
def stream_sla_monitor(spark, sf):
    """Rows that come a part late are too late for a watermark of one day."""
    return _monitor(spark, sf, None)


@query("stream_sla_monitor_sliding", _monitor_sql(
    "SELECT e.*, time_bucket(INTERVAL '6 hours', ts) - to_hours(6 * i) AS w FROM e, range(0, 4) t(i)"))
def stream_sla_monitor_sliding(spark, sf):
    return _monitor(spark, sf, "6 hours")


@query("stream_bursts", """
WITH p AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL '4 hours' THEN 0 ELSE 1 END AS starts FROM events
 WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
b AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts) AS burst FROM p)
SELECT user_id, min(ts) AS first_ts, count(*) AS packets, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 6) AS burst_sec
FROM b GROUP BY user_id, burst""")
def stream_bursts(spark, sf):
    """Closed bursts from the stream and open ones from its state; each restart goes on from both."""
    def run(events, base):
        timed = telemetry.event_time(events, late="120 days")
        closed = runner.run_append(telemetry.bursts(timed, ["user_id"], "4 hours"), path=base)
        return closed.unionByName(telemetry.open_bursts(runner.open_state(spark, base), ["user_id"]))

    return rounded(run_arrivals(spark, sf, run).withColumn("first_ts", F.col("first_ts").cast("timestamp_ntz")))


@query("stream_inter_arrival", f"""
WITH {PART_SQL}, p AS (SELECT part, {', '.join(f'{v} AS {c}' for c, v in PACKETS.items())}, seconds AS epoch FROM e),
o AS (SELECT *, max(epoch) OVER (PARTITION BY {PACKET_KEYS_SQL} ORDER BY part, epoch, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM p)
SELECT event_id, round(greatest(0e0, coalesce(epoch - latest, 0e0)), 5) AS iat FROM o""")
def stream_inter_arrival(spark, sf):
    """Gaps go on over parts and restarts; a packet that comes after a later one has none."""
    keys = PACKET_KEYS_SQL.split(", ")

    def run(events, base):
        return runner.run_append(runner.inter_arrival_stream(packet_columns(events), keys), path=base)

    return rounded(run_arrivals(spark, sf, run).select("event_id", "iat"), 5)


TRAFFIC = {"tos": "CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 ELSE 2 END", "qos_class": CLASS_OF_EVENT,
           "offered_bandwidth": "value * 100", "routing_hops": "user_id % 6 + 1"}
BATCH_CANDIDATES = CANDIDATES.replace(DELAY_SQL, "SELECT part, " + ", ".join(f"{v} AS {c}" for c, v in TRAFFIC.items()) + " FROM e")
BATCH_SUMMARY = SUMMARY.replace("SELECT profile_no,", "SELECT part, profile_no,").replace("GROUP BY 1, 2, 3", "GROUP BY 1, 2, 3, 4")


@query("stream_recommend", f"""
WITH {PART_SQL}, {BATCH_CANDIDATES}, {BATCH_SUMMARY},
wd AS (SELECT part, profile_no, profile, {_scores()}, cast(sum(n) AS bigint) AS traffic_rows FROM cs GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY sla_feasible DESC, violation, delay, profile_no) AS rank FROM wd)
SELECT part AS batch, CASE WHEN sla_feasible THEN profile ELSE 'infeasible' END AS decision, profile, sla_feasible, traffic_rows,
 round(violation, 6) AS weighted_violation_score, round(delay, 6) AS weighted_delay_score FROM r WHERE rank = 1""")
def stream_recommend(spark, sf):
    """One decision for each part of the traffic."""
    schema = ("decision string, profile string, sla_feasible boolean, traffic_rows bigint, "
              "weighted_violation_score double, weighted_delay_score double")

    def run(events, base):
        pattern = events.select(*[F.expr(v).alias(c) for c, v in {**TRAFFIC, "qos_class": "'Bronze'"}.items()])
        return runner.run_each_batch(pattern, lambda batch: telemetry.recommend_batch(batch, formula), schema, path=base)

    return rounded(run_arrivals(spark, sf, run))


@query("batch_delay_windows", """
SELECT time_bucket(INTERVAL '1 day', ts) AS window_start, event_type, count(*) AS packet_count,
 round(sum(value), 4) AS flow_duration_sec, round(avg(value) * 1000, 4) AS latency_ms FROM events WHERE value > 0 GROUP BY 1, 2""")
def batch_delay_windows(spark, sf):
    """The stream operators are plain DataFrame functions and take a batch just as well."""
    timed = telemetry.event_time(table(spark, sf, "events"), late=None).withColumn("iat", F.col("value"))
    out = telemetry.delay_windows(timed, ["event_type"])
    return rounded(out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")), 4)


@query("burst_table", """
WITH p AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER w < 14400 THEN 0 ELSE 1 END AS starts FROM events
 WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
b AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts) AS burst FROM p)
SELECT user_id, count(*) AS packets, round(epoch_us(min(ts)) / 1e6, 6) AS first, round(epoch_us(max(ts)) / 1e6 - epoch_us(min(ts)) / 1e6, 6) AS burst_sec
FROM b GROUP BY user_id, burst""")
def burst_table_query(spark, sf):
    events = table(spark, sf, "events").select(
        "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("epoch"))
    return rounded(burst_table(events, ["user_id"], 14400.0).select("user_id", "packets", "first", "burst_sec"))
