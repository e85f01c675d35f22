"""Edge rows of number helpers, rules and parsers."""

import pytest
from pyspark.sql import functions as F

from linkgauge.functions import numeric, rules
from linkgauge.functions.parsing import path_hops, result_records, traffic_records
from linkgauge.operators import flows, links


def values(spark, expr, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr.alias("v")).collect()]


def test_clip_keeps_missing(spark):
    assert values(spark, numeric.clip(F.col("x"), 0, 10), [(None,), (-1.0,), (5.0,), (50.0,)], "x double") == [None, 0, 5, 10]


def test_percent_of_zero(spark):
    rows = [(5.0, 0.0), (0.0, 0.0), (5.0, 10.0), (20.0, 10.0), (None, 10.0), (-1.0, 0.0)]
    assert values(spark, numeric.percent_of(F.col("a"), F.col("b")), rows, "a double, b double") == [100, None, 50, 100, None, 0]


def test_finite(spark):
    rows = [(float("nan"),), (float("inf"),), (float("-inf"),), (1.0,), (None,)]
    assert values(spark, numeric.finite(F.col("x")), rows, "x double") == [None, None, None, 1.0, None]


def test_log_target_and_loss(spark):
    got = values(spark, numeric.log_target(F.col("x")), [(0.0,), (None,), (1.0,)], "x double")
    assert got[0] == pytest.approx(-20.7232658) and got[1] is None and got[2] == 0
    assert values(spark, numeric.loss_rate(F.col("a"), F.col("b")), [(0.0, 0.0), (3.0, 1.0)], "a double, b double") == [0, 0.25]


def test_ports(spark):
    rows = [("53",), (None,), ("x",), ("443",), ("5060",), ("inf",), ("27017",)]
    assert values(spark, rules.infer_protocol(F.col("p")), rows, "p string") == ["UDP", "TCP", "TCP", "TCP", "UDP", "TCP", "TCP"]
    assert values(spark, rules.infer_application(F.col("p")), rows, "p string") == [
        "dns", "other", "other", "web", "voice", "other", "database"]


def test_class_policy(spark):
    rows = [("UDP", 20000), ("TCP", 20000), ("tcp ", 443), ("UDP", 443), ("TCP", 50000), ("UDP", 4500), ("TCP", None)]
    assert values(spark, rules.classify_qos(None, F.col("t"), F.col("p")), rows, "t string, p int") == [
        "Gold", "Bronze", "Silver", "Bronze", "Bronze", "Gold", "Bronze"]


def test_labels(spark):
    rows = [(" BENIGN ",), (None,), ("  ",), ("Web Attack � XSS",)]
    assert values(spark, rules.clean_label(F.col("x")), rows, "x string") == ["BENIGN", None, None, "Web Attack - XSS"]
    assert values(spark, rules.clean_label_keep(F.col("x")), rows, "x string") == ["BENIGN", "nan", "", "Web Attack - XSS"]


def test_bandwidth_limits_are_strict(spark):
    rows = [("voice", 100.0, 30.0, 2.0, 80.0, 0), ("voice", 101.0, 31.0, 3.0, 81.0, 0), ("dns", 0.0, 0.0, 0.0, 0.0, 1)]
    score = rules.recommend_bandwidth_flow(*[F.col(c) for c in "abcdef"])
    assert values(spark, score, rows, "a string, b double, c double, d double, e double, f int") == [60, 95, 28]


def test_scenario_and_family(spark):
    rows = [("graph_A_wfq_fixed_0.txt",), ("graph_A_wfq_0.txt",), ("xgraph_A_wfq_fixed_0.txt",)]
    assert values(spark, rules.scenario_of(F.col("x")), rows, "x string") == ["A_wfq_fixed", "unknown", "unknown"]


def test_profile_and_sla_arguments():
    assert rules.parse_profiles(["60,30,10", "60, 30, 10", "1,2,3"]) == [
        {"Gold": 60.0, "Silver": 30.0, "Bronze": 10.0}, {"Gold": 1.0, "Silver": 2.0, "Bronze": 3.0}]
    assert rules.profile_name(rules.parse_profile("33.5,33,34")) == "33.5/33/34"
    for bad in ("1,2", "1,-2,3", "0,0,0"):
        with pytest.raises(ValueError):
            rules.parse_profile(bad)
    with pytest.raises(ValueError):
        rules.parse_sla("0,1,2")


def test_records(spark):
    line = "10,1,0.5|1,2,3,0.5,-1,.1,.2,.5,.8,.9,.01;1,2,3;1,2,3,-1,-1,.1,.2,.5,.8,.9,.01; ;1,0,0,0.25,-1,.1,.2,.5,.8,.9,.02,99;"
    got = values(spark, result_records(F.col("x")), [(line,)], "x string")[0]
    assert [g["avg_delay"] if g else None for g in got] == [0.5, None, None, 0.25]
    traffic = values(spark, traffic_records(F.col("x")), [("9.5|-1;0,2000.5,7,1;2,30,10,5,2;",)], "x string")[0]
    assert [t and (t["time_distribution"], t["offered_bandwidth"], t["tos"]) for t in traffic] == [
        None, (0, 2000.5, 1), (2, 30.0, 2)]
    assert values(spark, path_hops(F.col("x")), [([1, 2, 3],), ([1],), (None,)], "x array<int>") == [2, 1, 1]


def test_flow_features_edges(spark):
    names = [*flows.RAW_COLUMNS, "source_file"]
    base = [80.0, 2e6, 3, 4, 10.0, 20.0, 1e6, 5e4, 1e4, 0, " BENIGN ", "a.csv"]

    def row(**changes):
        out = dict(zip(names, base)) | changes
        return tuple(out[n] for n in names)

    schema = ("`Destination Port` double, `Flow Duration` double, `Total Fwd Packets` int, `Total Backward Packets` int, "
              "`Total Length of Fwd Packets` double, `Total Length of Bwd Packets` double, `Flow Bytes/s` double, "
              "`Flow IAT Mean` double, `Flow IAT Std` double, `RST Flag Count` int, Label string, source_file string")
    rows = [row(), row(**{"Flow Bytes/s": float("inf")}), row(**{"Flow IAT Mean": float("nan")}),
            row(**{"Destination Port": None}), row(Label=None, **{"RST Flag Count": None}),
            row(Label="DoS", **{"RST Flag Count": 3})]
    got = flows.flow_features(spark.createDataFrame(rows, schema)).collect()
    assert [(g["attack_label"], g["is_attack"], g["packet_loss_percent"]) for g in got] == [
        ("BENIGN", 0, 0.0), ("nan", 1, 0.0), ("DoS", 1, 1.0)]
    first = got[0].asDict()
    assert first["latency_ms"] == 50.0 and first["packet_count"] == 7 and first["byte_count"] == 30.0
    assert first["actual_throughput_mbps"] == 8.0 and first["flow_duration_sec"] == 2.0
    assert first["recommended_bandwidth_percent"] == 40
    assert list(first) == [*flows.FEATURE_COLUMNS, flows.TARGET, *flows.FLOW_TRACE_COLUMNS]


def test_delay_by_config_edges(spark):
    rows = [("a", 0.0, 5.0), ("a", 0.5, 86399.0), ("a", 1.5, 86400.0), ("b", 1.0, None), (None, 1.0, 1.0), ("c", 0.0, 1.0),
            ("d", None, 2.0)]
    packets = spark.createDataFrame(rows, "k string, iat double, epoch double")
    got = {r["k"]: r for r in links.delay_by_config(packets, ["k"]).collect()}
    assert set(got) == {"a", "b"}
    assert got["a"]["latency_ms"] == 1000.0 and got["a"]["packet_count"] == 2 and got["a"]["flow_duration_sec"] == 2.0
    assert got["a"]["time_of_day"] == 23 and got["b"]["time_of_day"] == -1
