"""Published result numbers recomputed from their own parts."""

import pytest
from pyspark.sql import functions as F

from linkgauge.functions import rules
from linkgauge.operators import allocation, comparison, evaluation

# Profile, mean delay in ms of Gold, Silver and Bronze, violation and delay score, in rank order.
ALLOCATIONS = [
    ("60/30/10", 24.470300674438477, 24.219194412231445, 30.81458854675293, 0.6705451011657715, 4.947458763122558),
    ("80/15/5", 24.989158630371094, 30.615755081176758, 31.27170753479004, 0.7483737945556643, 5.285721073150635),
    ("25/65/10", 25.015138626098633, 24.284076690673828, 30.81458854675293, 0.7522707939147948, 5.031779747009277),
    ("33/33/34", 25.11932945251465, 24.55421257019043, 33.915401458740234, 0.7678994178771974, 5.089221935272217),
    ("50/40/10", 25.26804542541504, 24.796018600463867, 30.81458854675293, 0.790206813812256, 5.0901934432983404),
]

# R² of two models on the same five folds.
FIRST_FOLDS = [0.764496, 0.775073, 0.777675, 0.737076, 0.772646]
SECOND_FOLDS = [0.767598, 0.774630, 0.776877, 0.740322, 0.770474]


def test_allocation_scores(spark):
    profiles = rules.parse_profiles(rules.PROFILES)
    numbers = {rules.profile_name(p): i for i, p in enumerate(profiles)}
    rows = [
        (numbers[name], c, n, ms, 0.0, 0.0, 0.0)
        for name, *means, _, _ in ALLOCATIONS for c, n, ms in zip(rules.CLASSES, (4592, 8991, 15697), means)
    ]
    summary = spark.createDataFrame(
        rows, "profile_no int, qos_class string, rows bigint, mean_delay_ms double, p90_delay_ms double, "
              "max_delay_ms double, violation_rate double")
    scores = allocation.rank_profiles(allocation.profile_scores(summary, profiles, rules.ALLOCATION_SLA_MS))
    got = scores.orderBy("rank").collect()
    assert [r["profile"] for r in got] == [a[0] for a in ALLOCATIONS]
    for row, (_, *_, violation, delay) in zip(got, ALLOCATIONS):
        assert not row["sla_feasible"] and row["traffic_rows"] == 29280
        assert row["weighted_violation_score"] == pytest.approx(violation, abs=1e-9)
        assert row["weighted_delay_score"] == pytest.approx(delay, abs=1e-9)


def test_published_paired_comparison(spark):
    row = comparison.paired_compare(_scores(spark, FIRST_FOLDS, SECOND_FOLDS), "a", "b").head()
    assert row["paired_ttest_p"] == pytest.approx(0.6202417393803225, abs=2e-4)  # scores are rounded to 6 digits
    assert row["wilcoxon_p"] == 0.8125 and row["tests_agree"]
    assert row["mean_diff"] == pytest.approx(-0.0005872672278786295, abs=1e-6)
    assert row["practical_conclusion"] == "no_meaningful_difference"


def test_sla_confusion_counts(spark):
    """4592 rows, 1319 violations, 1193 said, 1186 right: P .994132, R .899166, F1 .944268."""
    cells = [("Gold", 40.0, 40.0, 1186), ("Gold", 40.0, 20.0, 1319 - 1186), ("Gold", 20.0, 40.0, 1193 - 1186),
             ("Gold", 20.0, 20.0, 4592 - 1319 - 7)]
    scored = spark.createDataFrame(cells, "qos_class string, true_ms double, pred_ms double, n int")
    scored = scored.select("qos_class", "true_ms", "pred_ms", F.explode(F.sequence(F.lit(1), "n")))
    row = evaluation.sla_confusion(scored, rules.EVALUATION_SLA_MS).head()
    assert (row["rows"], row["actual_violations"], row["predicted_violations"]) == (4592, 1319, 1193)
    assert row["precision"] == pytest.approx(0.994132, abs=1e-6)
    assert row["recall"] == pytest.approx(0.899166, abs=1e-6)
    assert row["f1_score"] == pytest.approx(0.944268, abs=1e-6)


def test_scale_pos_weight(spark):
    labels = spark.range(14013 + 1684).select((F.col("id") < 1684).cast("int").alias("label"))
    row = evaluation.class_weights(labels).head()
    assert row["scale_pos_weight"] == pytest.approx(8.32125890736342)
    assert row["positive_weight"] == pytest.approx(15697 / (2 * 1684))


def _scores(spark, first, second):
    rows = [(i, "a", float(x)) for i, x in enumerate(first)] + [(i, "b", float(x)) for i, x in enumerate(second)]
    return spark.createDataFrame(rows, "fold int, model string, score double")


def test_paired_tests_against_known_values(spark):
    # differences 1..5 with one negative: t, W and the exact p by hand enumeration
    row = comparison.paired_compare(_scores(spark, [2, 3, 1, 5, 6], [1, 1, 4, 1, 1]), "a", "b").head()
    assert row["w"] == 3.0
    assert row["wilcoxon_p"] == pytest.approx(10 / 32)  # 5 of 32 sign patterns reach a sum of 3 or less
    # mean 1.8, sd 3.1145; two-sided p of t with 4 degrees of freedom has a closed form
    t = row["t"]
    assert t == pytest.approx(1.8 / (3.1144823 / 5**0.5), rel=1e-6)
    x = t / (4 + t * t) ** 0.5
    assert row["paired_ttest_p"] == pytest.approx(1 - x * (1 + (1 - x * x) / 2), abs=1e-12)
    assert row["practical_conclusion"] == "no_meaningful_difference"


def test_paired_tests_all_equal_and_fold_mismatch(spark):
    same = comparison.paired_compare(_scores(spark, [1, 2, 3], [1, 2, 3]), "a", "b").head()
    assert same["wilcoxon_p"] == 1.0 and same["paired_ttest_p"] is None
    broken = comparison.paired_compare(_scores(spark, [1, 2, 3], [1, 2]), "a", "b")
    with pytest.raises(Exception, match="do not match"):
        broken.collect()


def test_wilcoxon_exact_small_w(spark):
    """Five folds with W = 6 have an exact p of 0.8125."""
    row = comparison.paired_compare(_scores(spark, [1, 2, -3, -4, 5], [0, 0, 0, 0, 0]), "a", "b").head()
    assert row["w"] == 7.0
    row = comparison.paired_compare(_scores(spark, [1, -2, 3, -4, 5], [0, 0, 0, 0, 0]), "a", "b").head()
    assert row["w"] == 6.0 and row["wilcoxon_p"] == pytest.approx(0.8125)
