"""Rows that the given tables lack: NULL keys, NULL values, infinities, odd number texts, unknown classes."""

import math

import pytest
from pyspark.sql import functions as F

from linkgauge.functions.numeric import number_in_text, whole
from linkgauge.operators import allocation, comparison, flows, links, ordering, profiling, splitting

INF = float("inf")


def test_inter_arrival_keeps_every_row(spark):
    rows = [("a", 1.0), ("a", 3.0), ("a", None), (None, 5.0), (None, 9.0), (None, None)]
    out = links.inter_arrival(spark.createDataFrame(rows, "k string, epoch double"), ["k"]).collect()
    assert sorted([(r.k, r.epoch, r.iat) for r in out], key=repr) == sorted(
        [("a", 1.0, 0.0), ("a", 3.0, 2.0), ("a", None, None), (None, 5.0, 0.0), (None, 9.0, 4.0), (None, None, None)], key=repr)


def test_bursts_with_null_keys(spark):
    rows = [(None, 1.0), (None, 1.5), (None, 9.0), ("a", None)]
    out = links.burst_table(spark.createDataFrame(rows, "k string, epoch double"), ["k"], 2.0).collect()
    assert sorted((r.first, r.packets) for r in out) == [(1.0, 2), (9.0, 1)]


def test_folds_and_samples_keep_null_groups(spark):
    df = spark.range(40).withColumn("label", F.when(F.col("id") % 4 > 0, F.lit("x")))
    folds = splitting.stratified_kfold(df, "label", ["id"], 5)
    assert folds.count() == 40 and folds.groupBy("label", "fold").count().agg(F.max("count") - F.min("count")).first() is not None
    assert sorted(r["count"] for r in folds.filter("label IS NULL").groupBy("fold").count().collect()) == [2] * 5
    assert splitting.quota_sample(df, "label", ["id"], 10).filter("label IS NULL").count() == 5


def test_describe_keeps_groups_without_values(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", None), (None, 7.0)], "k string, v double")
    out = {r.k: r for r in profiling.describe_by(df, ["k"], "v").collect()}
    assert out["b"]["count"] == 0 and out["b"].p50 is None and out[None].p50 == 7.0 and out["a"].p50 == 2.0


def test_percentiles_with_infinities(spark):
    df = spark.createDataFrame([(x,) for x in (-INF, 1.0, INF, INF, INF)], "v double")
    row = ordering.exact_percentiles(df, [], "v", {"p25": 0.25, "p90": 0.9, "p0": 0.0}).first()
    assert (row.p25, row.p90, row.p0) == (1.0, INF, -INF)


def test_all_traffic_rows_count(spark):
    rows = [(0, "Gold", 5.0), (0, "Silver", INF), (0, "tos_3", 4.0), (0, None, 1.0)]
    scored = spark.createDataFrame(rows, "profile_no int, qos_class string, pred_ms double")
    sla = {"Gold": 20.0, "Silver": 50.0, "Bronze": 100.0}
    summary = allocation.class_delay_summary(scored, sla)
    assert summary.count() == 4
    parsed = [{"Gold": 60.0, "Silver": 30.0, "Bronze": 10.0}]
    row = allocation.profile_scores(summary, parsed, sla).first()
    assert row.traffic_rows == 4 and row.gold_rows == 1 and row.bronze_rows == 0 and not row.sla_feasible


@pytest.mark.parametrize("text,value", [
    ("12f", None), ("7d", None), ("0f", None), ("0d", None), ("1.5", 1.5), (" -3e2 ", -300.0), ("inf", INF), ("-Infinity", -INF), (".5", 0.5), ("5.", 5.0),
    ("NaN", math.nan), ("", None), ("1 2", None), ("0x1p3", None), ("İnf", None), (None, None),
])
def test_number_texts(spark, text, value):
    got = spark.createDataFrame([(text,)], "t string").select(number_in_text(F.col("t"))).first()[0]
    assert got == value or value is not None and math.isnan(value) and math.isnan(got)


def test_text_column_is_not_a_constant_zero(spark):
    df = spark.createDataFrame([("0d", 0), ("0f", 0)], "code string, zero int")
    assert profiling.constant_zero_columns(profiling.profile_columns(df), None) == ["zero"]


def test_whole_numbers_written_as_doubles(spark):
    assert spark.sql("SELECT 80.0D AS a, 80.5D AS b").select(whole(F.col("a")), whole(F.col("b"))).first()[:] == (80, None)
    names = [*flows.RAW_COLUMNS, "source_file"]
    values = {n: "1.0" for n in names} | {"Destination Port": "80.0", "Total Fwd Packets": "3.0", "Total Backward Packets": "2", "Label": "BENIGN", "source_file": "f"}
    row = flows.flow_features(spark.createDataFrame([tuple(values[n] for n in names)], ", ".join(f"`{n}` string" for n in names))).first()
    assert row.destination_port == 80 and row.packet_count == 5


@pytest.mark.parametrize("method", ["exact", "normal"])
def test_signed_rank_method_is_the_callers(spark, method):
    gaps = [0.1, 0.2, -0.3, 0.4, 0.4, 0.0, 0.7]
    rows = [(m, i, 1.0 + (g if m == "x" else 0.0)) for i, g in enumerate(gaps) for m in ("x", "y")]
    row = comparison.paired_compare(spark.createDataFrame(rows, "model string, fold int, score double"), "x", "y", method=method).first()
    assert row.wilcoxon_method == method
    if method == "exact":  # all 2^6 sign patterns, ties at their mean rank
        ranks, smaller = [1, 2, 3, 4.5, 4.5, 6], 3
        sums = [sum(r for k, r in enumerate(ranks) if bits >> k & 1) for bits in range(64)]
        assert row.wilcoxon_p == pytest.approx(min(1.0, 2 * sum(s <= smaller for s in sums) / 64))


def test_link_keys_meet_whatever_their_writing(spark):
    from linkgauge.plans.datasets import typed_keys

    rows = [("20", "2.0", "1", "0.50"), ("20.0", "2", "1.0", ".5"), ("x", None, "1", "DDSU")]
    out = typed_keys(spark.createDataFrame(rows, "bw string, slots string, rep string, ratio string"), "bw").collect()
    assert out[0] == out[1] == (20, 2, 1, "0.5") and out[2] == (None, None, 1, "DDSU")


def test_other_classes_come_last(spark):
    from linkgauge.operators.evaluation import class_order

    df = spark.createDataFrame([("tos_3",), ("Bronze",), ("Gold",), (None,), ("Silver",)], "c string")
    assert [r.c for r in df.orderBy(class_order(F.col("c")), F.col("c").desc()).collect()] == ["Gold", "Silver", "Bronze", "tos_3", None]
