"""Exact ranks, samples, folds, percentiles and AUC against brute force, with one hot group."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linkgauge.operators import evaluation, links, ordering, splitting


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds most rows, one has a single row, many values repeat."""
    rng = random.Random(3)
    rows = [(i, "hot" if i % 10 < 7 else f"g{i % 4}", float(rng.choice([1, 1, 2, rng.random() * 100])))
            for i in range(5000)] + [(5000, "one", 7.0)]
    return spark.createDataFrame(rows, "id int, grp string, v double").repartition(6)


def test_percentiles_match_numpy(skewed):
    wanted = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p90": 0.9, "p100": 1.0}
    got = {r["grp"]: r for r in ordering.exact_percentiles(skewed, ["grp"], "v", wanted, cell_rows=5).collect()}
    frame = skewed.toPandas()
    assert set(got) == set(frame["grp"])
    for name, part in frame.groupby("grp"):
        for column, p in wanted.items():
            assert got[name][column] == pytest.approx(np.quantile(part["v"], p), abs=1e-12)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6, allow_nan=False), min_size=1, max_size=60), st.floats(0, 1))
def test_percentile_property(spark, numbers, p):
    df = spark.createDataFrame([(x,) for x in numbers], "v double")
    got = ordering.exact_percentiles(df, [], "v", {"q": p}, cell_rows=2).head()["q"]
    assert got == pytest.approx(np.quantile(numbers, p), rel=1e-9, abs=1e-9)


def test_percentiles_of_all_magnitudes(spark):
    """Cells are cut again and again: tiny, huge and infinite numbers, neighbours in the last bit, one value for most rows."""
    rng = np.random.default_rng(4)
    near = [1.0]
    for _ in range(300):
        near.append(float(np.nextafter(near[-1], 2)))
    groups = {"near": near, "one": [7.25] * 500, "wide": [float(x) for x in rng.choice([-1, 1], 400) * 10.0 ** rng.uniform(-300, 300, 400)],
              "inf": [float("-inf"), -5e-324, 0.0, -0.0, 5e-324, 1e308, float("inf"), float("inf")], "hot": [1.5] * 300 + [1.5 + i * 1e-9 for i in range(200)]}
    df = spark.createDataFrame([(g, x) for g, v in groups.items() for x in v] + [(None, 3.0)], "g string, v double")
    for p in (0.0, 0.31, 0.5, 0.997, 1.0):
        got = {r["g"]: r["q"] for r in ordering.exact_percentiles(df, ["g"], "v", {"q": p}, cell_rows=3).collect()}
        assert got.pop(None) == 3.0
        for g, v in groups.items():
            with np.errstate(invalid="ignore"):
                low, high = sorted(v)[int(np.floor((len(v) - 1) * p))], sorted(v)[int(np.ceil((len(v) - 1) * p))]
            at = (len(v) - 1) * p
            assert got[g] == (low if low == high else pytest.approx(low + (high - low) * (at - np.floor(at)), rel=1e-15))


def test_auc_over_many_ranges(spark):
    """Scores of several groups in many ranges; rows without score or label count for nothing."""
    rng = random.Random(8)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *[i / 40 for i in range(40)]]), rng.choice([0, 1, 1, None])) for _ in range(900)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["g"]: r for r in evaluation.auc_roc(spark.createDataFrame(rows, "g string, score double, label int"), ["g"]).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    for g in ("a", "b", None):
        pos, neg = ([s for x, s, y in rows if x == g and s is not None and y == label] for label in (1, 0))
        won = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
        assert (got[g]["positives"], got[g]["negatives"]) == (len(pos), len(neg)) and got[g]["auc_roc"] == pytest.approx(won / len(pos) / len(neg))


def test_percentiles_of_nothing(spark):
    empty = spark.createDataFrame([(None,)], "v double")
    assert ordering.exact_percentiles(empty, [], "v", {"q": 0.5}).head()["q"] is None


def test_hash_rank_is_a_permutation(skewed):
    keyed = skewed.withColumn("key", ordering.hash_key(1, "id"))
    ranks = ordering.hash_rank(keyed, "key", ["grp"], prefix=1).toPandas()
    for _, part in ranks.groupby("grp"):
        assert sorted(part["rank"]) == list(range(1, len(part) + 1))
        assert list(part.sort_values("rank")["key"]) == sorted(part["key"])


def test_sample_sizes(skewed):
    assert splitting.sample_rows(skewed, ["id"], 123).count() == 123
    assert splitting.sample_rows(skewed, ["id"], 10**6).count() == 5001
    sizes = {r["grp"]: r["count"] for r in splitting.quota_sample(skewed, "grp", ["id"], 600).groupBy("grp").count().collect()}
    groups = skewed.select("grp").distinct().count()
    assert sizes["one"] == 1 and sizes["hot"] == 600 // groups
    again = splitting.sample_rows(skewed.repartition(3), ["id"], 50)
    assert {r["id"] for r in again.collect()} == {r["id"] for r in splitting.sample_rows(skewed, ["id"], 50).collect()}


def test_quota_is_at_least_one(skewed):
    assert splitting.quota_sample(skewed, "grp", ["id"], 1).groupBy("grp").count().filter("count <> 1").count() == 0


def test_exact_split_and_folds(skewed):
    split = splitting.train_test_split(skewed, ["id"], 0.2, exact=True)
    assert split.filter("is_test").count() == 1001  # ceil(5001 * 0.2)
    folds = [r["count"] for r in splitting.kfold(skewed, ["id"], 4, exact=True).groupBy("fold").count().collect()]
    assert sum(folds) == 5001 and max(folds) - min(folds) <= 1
    loose = splitting.kfold(skewed, ["id"], 4)
    assert loose.count() == 5001 and loose.select("fold").distinct().count() == 4
    by_label = splitting.stratified_kfold(skewed, "grp", ["id"], 5).groupBy("grp", "fold").count().toPandas()
    for _, part in by_label.groupby("grp"):
        assert part["count"].max() - part["count"].min() <= 1


def test_fold_errors(spark):
    tiny = spark.range(3)
    with pytest.raises(ValueError):
        splitting.kfold(tiny, ["id"], 5)
    assert splitting.kfold(tiny, ["id"], 1).filter("fold is not null").count() == 0


def test_auc_with_ties(spark):
    rng = random.Random(5)
    rows = [(float(rng.choice([0.1, 0.1, 0.2, rng.random()])), int(rng.random() < 0.3)) for _ in range(800)]
    scored = spark.createDataFrame(rows, "score double, label int").repartition(5)
    pos = [s for s, y in rows if y == 1]
    neg = [s for s, y in rows if y == 0]
    brute = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert evaluation.auc_roc(scored).head()["auc_roc"] == pytest.approx(brute, abs=1e-12)


def _packets(spark):
    rng = random.Random(9)
    rows = [(i, "hot" if rng.random() < 0.7 else "b", rng.choice([rng.random() * 5000, 77.0])) for i in range(1500)]
    rows.append((9999, "one", 1.0))
    return rows, spark.createDataFrame(rows, "id int, k string, epoch double").repartition(5)


def test_inter_arrival_matches_sorted_diff(spark):
    rows, packets = _packets(spark)
    for width in (50.0, 100000.0):
        got = links.inter_arrival(packets, ["k"], width).toPandas()
        assert len(got) == len(rows)
        for key, part in got.groupby("k"):
            times = sorted(t for _, k, t in rows if k == key)
            expected = sorted([0.0, *np.diff(times)])
            assert sorted(part["iat"]) == pytest.approx(expected)


def test_bursts_match_brute_force(spark):
    rows, packets = _packets(spark)
    expected = []
    for key in {k for _, k, _ in rows}:
        times = sorted(t for _, k, t in rows if k == key)
        start, last, n = times[0], times[0], 1
        for t in times[1:]:
            if t - last >= 10.0:
                expected.append((key, start, last, n))
                start, n = t, 0
            last, n = t, n + 1
        expected.append((key, start, last, n))
    for width in (3.0, 60.0, 1e6):
        got = links.burst_table(packets, ["k"], 10.0, width).select("k", "first", "last", "packets").collect()
        assert sorted(map(tuple, got)) == sorted(expected)


def test_latest_run(spark):
    rows = [("m", "a", "2026-01-01", 1), ("m", "a", "2026-01-02", 2), ("m", "b", "2026-01-01", 3)]
    report = spark.createDataFrame(rows, "model string, slice_value string, run_timestamp string, x int")
    got = evaluation.latest_run(report, ["model", "slice_value"])
    assert got.columns == report.columns
    assert sorted(r["x"] for r in got.collect()) == [2, 3]


def test_slices_of_one_row_and_flat_truth(spark):
    rows = [("Gold", "s", "p", 1.0, 1.5), ("Silver", "s", "p", 1e6, 1e6 + 1), ("Silver", "t", "p", 1e6, 1e6)]
    scored = spark.createDataFrame(rows, "qos_class string, scenario string, scheduling_policy string, y_true double, y_pred double")
    scored = scored.withColumns({"true_ms": F.col("y_true"), "pred_ms": -F.col("y_pred")})
    got = {(r["slice_type"], r["slice_value"]): r for r in evaluation.slice_metrics(scored).collect()}
    assert got[("qos_class", "Gold")]["r2_log_delay"] is None
    assert got[("qos_class", "Silver")]["r2_log_delay"] is None
    assert got[("overall", "all")]["rows"] == 3
    assert got[("qos_class", "Gold")]["rmsle_delay_ms"] == pytest.approx(np.log(2))
    assert sum(r["rows"] for k, r in got.items() if k[0] == "scenario") == 3


def test_full_time_slices_are_cut(spark):
    """A key with most packets in one hour: no slice keeps more rows than allowed, and gaps and trains stay the same."""
    rng = random.Random(12)
    rows = [("hot", 7200 + rng.random() * 3000) for _ in range(3000)] + [("hot", float(i * 900)) for i in range(40)] + [("k", 5.0), (None, 6.0), (None, 8.5), ("k", None)]
    df = spark.createDataFrame(rows, "k string, epoch double")
    sliced, _ = links._sliced(df, ["k"], 3600.0, "epoch", 100)
    assert sliced.groupBy("k", "_slice").count().agg(F.max("count")).first()[0] <= 100
    key = lambda r: tuple((x is not None, x) for x in r)
    for build in (lambda n: links.inter_arrival(df, ["k"], slice_rows=n), lambda n: links.burst_table(df, ["k"], 2.0, slice_rows=n)):
        whole, cut = (sorted((tuple(r) for r in build(n).collect()), key=key) for n in (10**6, 100))
        assert len(whole) == len(cut) and all(a == pytest.approx(b) for a, b in zip(whole, cut, strict=True))
