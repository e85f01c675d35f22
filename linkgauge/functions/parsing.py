"""Text records of the delay simulator as array expressions; no Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Order of the numbers in one result record.
RESULT_FIELDS = [
    "actual_bandwidth", "pkts_transmitted", "pkts_dropped", "avg_delay", "avg_ln_delay",
    "delay_p10", "delay_p20", "delay_p50", "delay_p80", "delay_p90", "jitter",
]


def line_head(line: Column) -> Column:
    """What stands before the first '|'."""
    return F.get(F.split(F.trim(line), r"\|", 2), F.lit(0))


def line_body(line: Column) -> Column:
    """What stands after the first '|'."""
    return F.get(F.split(F.trim(line), r"\|", 2), F.lit(1))


def line_records(line: Column) -> Column:
    """Non-empty ';' records after the first '|'."""
    return F.filter(F.split(line_body(line), r"\s*;\s*"), lambda record: F.trim(record) != "")


def numbers(record: Column) -> Column:
    return F.transform(F.split(record, ","), lambda value: F.trim(value).try_cast("double"))


def result_record(record: Column) -> Column:
    """One result record; NULL when it is short or its delay is negative (not measured)."""
    values = numbers(record)
    fields = F.struct(*[F.get(values, F.lit(i)).alias(name) for i, name in enumerate(RESULT_FIELDS)])
    delay = F.get(values, F.lit(RESULT_FIELDS.index("avg_delay")))
    return F.when((F.size(values) >= len(RESULT_FIELDS)) & ~(delay < 0), fields)


def traffic_record(record: Column) -> Column:
    """One traffic record; NULL for a path from a node to itself (first number negative)."""
    values = numbers(record)
    first = F.get(values, F.lit(0))
    fields = F.struct(
        first.try_cast("int").alias("time_distribution"),
        F.get(values, F.lit(1)).alias("offered_bandwidth"),
        F.element_at(values, -1).try_cast("int").alias("tos"),
    )
    return F.when(~(first < 0), fields)


def result_records(line: Column) -> Column:
    return F.transform(line_records(line), lambda record: result_record(record))


def traffic_records(line: Column) -> Column:
    return F.transform(line_records(line), lambda record: traffic_record(record))


def measured_result(record: Column) -> Column:
    """Whether a result record is complete and its delay not negative."""
    values = F.split(record, ",")
    delay = F.get(values, F.lit(RESULT_FIELDS.index("avg_delay"))).try_cast("double")
    return (F.size(values) >= len(RESULT_FIELDS)) & ~(delay < 0)


def moving_traffic(record: Column) -> Column:
    """Whether a traffic record belongs to a path between two different nodes."""
    return ~(F.substring_index(record, ",", 1).try_cast("double") < 0)


def _all_numbers(text: Column) -> Column:
    """Every token between ',' and ';' is a number; only whole records may be empty."""
    gap = text.rlike(r",\s*(,|;|$)") | text.rlike(r"(^|;)\s*,")
    broken = F.exists(
        F.split(text, "[,;]"), lambda v: (F.trim(v) != "") & F.trim(v).try_cast("double").isNull()
    )
    return ~gap & ~broken


def readable_result_line(line: Column) -> Column:
    """False when any number of the line cannot be read; such a simulation is left out."""
    head = F.split(line_head(line), ",")
    first = F.array_join(F.slice(head, 1, 3), ",")
    return (F.size(head) >= 3) & _all_numbers(first) & _all_numbers(line_body(line))


def readable_traffic_line(line: Column) -> Column:
    """False when the head or a first, second or last number of a flow cannot be read."""

    def broken(record: Column) -> Column:
        values = F.split(record, ",")
        number = lambda i: F.trim(F.element_at(values, i)).try_cast("double")
        first = number(1)
        short = (F.size(values) < 2) | F.when(F.size(values) >= 2, number(2)).isNull() | number(-1).isNull()
        return first.isNull() | (~(first < 0) & short)

    return line_head(line).try_cast("double").isNotNull() & ~F.exists(line_records(line), broken)


def path_nodes(text: Column) -> Column:
    """The node numbers of a comma path; NULL when anything in it is no whole number."""
    nodes = F.transform(F.split(F.trim(text), ","), lambda node: F.trim(node).try_cast("int"))
    return F.when(~F.exists(nodes, lambda node: node.isNull()), nodes)


def path_hops(nodes: Column) -> Column:
    """Edges on a path, at least 1; also 1 when there is no path."""
    return F.greatest(F.lit(1), F.coalesce(F.size(nodes), F.lit(0)) - 1)


def weight_list(policy: Column, weights: Column) -> Column:
    """Queue weights of a node; strict priority gives everything to the first class. NULL when one is no number."""
    given = F.transform(F.split(weights, ","), lambda w: F.trim(w).try_cast("double"))
    parsed = F.when(~F.exists(given, lambda w: w.isNull()), given)
    return F.when(policy == "SP", F.array(F.lit(100.0), F.lit(0.0), F.lit(0.0))).otherwise(parsed)


def class_weight(weights: Column, tos: Column) -> Column:
    """Weight of a ToS code; an equal share when the list is too short."""
    return F.when(tos < F.size(weights), F.get(weights, tos)).otherwise(F.lit(100.0) / F.size(weights))
