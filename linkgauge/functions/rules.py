"""Domain rules as native column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Service classes in priority order, their ToS codes, priorities and penalties.
CLASSES = ["Gold", "Silver", "Bronze"]
CLASS_OF_TOS = {0: "Gold", 1: "Silver", 2: "Bronze"}
CLASS_PRIORITY = {"Gold": 3, "Silver": 2, "Bronze": 1}
CLASS_PENALTY = {"Gold": 3.0, "Silver": 2.0, "Bronze": 1.0}

# Two different delay agreements in ms. Evaluation and allocation do not share them.
EVALUATION_SLA_MS = {"Gold": 30.0, "Silver": 50.0, "Bronze": 60.0}
ALLOCATION_SLA_MS = {"Gold": 20.0, "Silver": 50.0, "Bronze": 100.0}
BRONZE_SWEEP_MS = [100.0, 70.0, 60.0, 50.0]

# Candidate bandwidth splits Gold, Silver, Bronze.
PROFILES = ["60,30,10", "50,40,10", "33,33,34", "25,65,10", "80,15,5"]

# Destination ports taken as UDP.
UDP_PORTS = [53, 67, 68, 69, 123, 161, 162, 500, 4500, 5060, 5061]

# Application by destination port, first match wins.
APPLICATION_PORTS = {
    "web": [80, 443, 8080, 8443],
    "video": [554, 1935, 5004, 5005, 8081],
    "file_transfer": [20, 21],
    "mail": [25, 110, 143, 465, 587, 993, 995],
    "dns": [53],
    "ssh": [22],
    "voice": [5060, 5061],
    "database": [3306, 5432, 1433, 1521, 27017],
}

# Bandwidth points by application on top of the base of 30.
APPLICATION_BONUS = {"voice": 30, "video": 25, "database": 15, "web": 10, "file_transfer": 5}

# Class policy by protocol and port range.
PORT_POLICY = [
    ("Gold", ("TCP", "UDP"), [(5060, 5061), (53, 53)]),
    ("Gold", ("UDP",), [(16384, 32767), (123, 123), (500, 500), (4500, 4500)]),
    ("Silver", ("TCP",), [(443, 443), (80, 80), (22, 22)]),
    ("Silver", ("TCP", "UDP"), [(3389, 3389)]),
    ("Silver", ("TCP",), [(1433, 1433), (1521, 1521), (3306, 3306), (5432, 5432)]),
    ("Silver", ("TCP",), [(25, 25), (465, 465), (587, 587), (993, 993), (995, 995)]),
    ("Bronze", ("TCP",), [(20, 21), (989, 990), (445, 445), (873, 873)]),
    ("Bronze", ("TCP", "UDP"), [(49152, 65535)]),
]

# Class by known application, used before protocol and port.
APPLICATION_CLASS = {
    "voice": "Gold", "video": "Gold", "dns": "Gold", "ntp": "Gold", "tunnel": "Gold",
    "web": "Silver", "ssh": "Silver", "remote_desktop": "Silver", "database": "Silver", "mail": "Silver",
    "file_transfer": "Bronze", "smb": "Bronze", "backup": "Bronze",
}

SCENARIO_PATTERN = r"^graph_([^_]+_[^_]+_[^_]+)_\d+\.txt"


def lookup(key: Column, table: dict, default=None) -> Column:
    """A small fixed table as one CASE expression."""
    case = reduce(lambda acc, item: acc.when(key == F.lit(item[0]), F.lit(item[1])), table.items(), F)
    return case.otherwise(default if isinstance(default, Column) else F.lit(default))


def port_number(port: Column) -> Column:
    """Port as a whole number, -1 when it cannot be read."""
    return F.coalesce(port.try_cast("double").try_cast("int"), F.lit(-1))


def infer_protocol(port: Column) -> Column:
    return F.when(port_number(port).isin(UDP_PORTS), F.lit("UDP")).otherwise(F.lit("TCP"))


def infer_application(port: Column) -> Column:
    number = port_number(port)
    names = list(APPLICATION_PORTS)
    case = F.when(number.isin(APPLICATION_PORTS[names[0]]), F.lit(names[0]))
    for name in names[1:]:
        case = case.when(number.isin(APPLICATION_PORTS[name]), F.lit(name))
    return case.otherwise(F.lit("other"))


def _points(condition: Column, points: int) -> Column:
    return F.when(condition, F.lit(points)).otherwise(F.lit(0))


def _bandwidth_points(application, latency_ms, jitter_ms, loss_percent, utilization, other_bonus) -> Column:
    return (
        F.lit(30)
        + lookup(application, APPLICATION_BONUS, other_bonus)
        + _points(latency_ms > 100, 10)
        + _points(jitter_ms > 30, 10)
        + _points(loss_percent > 2, 10)
        + _points(utilization > 80, 5)
    )


def recommend_bandwidth_flow(application, latency_ms, jitter_ms, loss_percent, utilization, is_attack) -> Column:
    """Bandwidth points for a recorded flow; attacks lose 10, other applications start at 8."""
    points = _bandwidth_points(application, latency_ms, jitter_ms, loss_percent, utilization, 8)
    return F.greatest(F.lit(0), F.least(F.lit(100), points - _points(is_attack == 1, 10)))


def recommend_bandwidth_synthetic(application, latency_ms, jitter_ms, loss_percent, utilization) -> Column:
    """Bandwidth points for a synthetic flow; no attack term, other applications start at 5."""
    points = _bandwidth_points(application, latency_ms, jitter_ms, loss_percent, utilization, 5)
    return F.least(F.lit(100), points)


def clean_label(label: Column) -> Column:
    """Trimmed label with the replacement character as '-'; missing and empty become NULL."""
    return F.nullif(F.replace(F.trim(label.cast("string")), F.lit("�"), F.lit("-")), F.lit(""))


def clean_label_keep(label: Column) -> Column:
    """As ``clean_label``, but a missing label stays as the text 'nan' and empty stays empty."""
    text = F.coalesce(label.cast("string"), F.lit("nan"))
    return F.replace(F.trim(text), F.lit("�"), F.lit("-"))


def tos_to_class(tos: Column, fallback: Column | None = None) -> Column:
    """Service class of a ToS code; an unknown code becomes ``tos_<n>`` or the given class."""
    unknown = F.concat(F.lit("tos_"), tos.cast("string")) if fallback is None else fallback
    return lookup(tos, CLASS_OF_TOS, unknown)


def qos_priority(qos_class: Column) -> Column:
    return lookup(qos_class, CLASS_PRIORITY)


def sla_penalty(qos_class: Column) -> Column:
    return lookup(qos_class, CLASS_PENALTY)


def sla_threshold(qos_class: Column, sla_ms: dict[str, float]) -> Column:
    return lookup(qos_class, sla_ms)


def classify_qos(application: Column | None, protocol: Column, port: Column) -> Column:
    """Service class by application, else by protocol and port, Gold before Silver before Bronze."""
    number, transport = port_number(port), F.upper(F.trim(protocol))
    by_port = F.lit("Bronze")
    for qos_class, protocols, ranges in reversed(PORT_POLICY):
        inside = reduce(lambda a, b: a | b, [number.between(low, high) for low, high in ranges])
        by_port = F.when(transport.isin(list(protocols)) & inside, F.lit(qos_class)).otherwise(by_port)
    if application is None:
        return by_port
    return F.coalesce(lookup(F.lower(F.trim(application)), APPLICATION_CLASS), by_port)


def target_family(target: Column) -> Column:
    return (
        F.when(target == "jitter", F.lit("jitter"))
        .when(target.startswith("delay_"), F.lit("tail_delay"))
        .when(target == "packet_loss_rate", F.lit("loss"))
        .when(target == "actual_bandwidth", F.lit("throughput"))
        .otherwise(F.lit("qos_metric"))
    )


def scenario_of(graph_file: Column) -> Column:
    found = F.regexp_extract(graph_file, SCENARIO_PATTERN, 1)
    return F.when(found == "", F.lit("unknown")).otherwise(found)


def numbers_by_class(text: str, what: str, allowed, rule: str) -> dict[str, float]:
    """One number for each class from a comma list (empty parts are skipped) that ``allowed`` accepts."""
    numbers = list(map(float, filter(str.strip, text.split(","))))
    if len(numbers) != len(CLASSES) or not allowed(numbers):
        raise ValueError(f"{what} '{text}': one number for each of {', '.join(CLASSES)}, {rule}")
    return dict(zip(CLASSES, numbers, strict=True))


def parse_sla(text: str) -> dict[str, float]:
    """'20,50,100' to delay limits by class."""
    return numbers_by_class(text, "limits", lambda x: min(x) > 0, "all above zero")


def parse_profile(text: str) -> dict[str, float]:
    """'60,30,10' to weights by class."""
    return numbers_by_class(text, "profile", lambda x: min(x) >= 0 and sum(x) > 0, "none below zero and not all zero")


def parse_profiles(texts: list[str]) -> list[dict[str, float]]:
    """Profiles without repeats, in the order given."""
    parsed = list(map(parse_profile, texts))
    return [p for i, p in enumerate(parsed) if p not in parsed[:i]]


def profile_name(profile: dict[str, float]) -> str:
    return "/".join(format(profile[c], "g") for c in CLASSES)
