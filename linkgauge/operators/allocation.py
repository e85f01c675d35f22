"""Scoring candidate bandwidth splits and ranking them by the agreed delays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkgauge.functions.numeric import delay_ms
from linkgauge.functions.rules import (
    ALLOCATION_SLA_MS, CLASS_PENALTY, CLASSES, PROFILES, parse_profiles, profile_name, sla_threshold,
    tos_to_class,
)
from linkgauge.operators.joining import null_safe_join
from linkgauge.operators.ordering import exact_percentiles
from linkgauge.operators.profiling import require_columns
from linkgauge.session import materialize


def traffic_pattern(df: DataFrame) -> DataFrame:
    """Traffic with its class read from ToS; an unknown ToS keeps the given class."""
    require_columns(df, ["tos", "qos_class"])
    return df.withColumn("tos", F.col("tos").try_cast("bigint")).withColumn(
        "qos_class", tos_to_class(F.col("tos"), F.col("qos_class"))
    )


def profile_column(profiles: list[dict[str, float]]) -> Column:
    """The candidate profiles as one array literal."""
    return F.array(*[
        F.struct(
            F.lit(i).alias("profile_no"), F.lit(profile_name(p)).alias("profile"),
            *[F.lit(p[c]).alias(f"{c.lower()}_weight") for c in CLASSES],
        )
        for i, p in enumerate(profiles)
    ])


def apply_profiles(pattern: DataFrame, profiles: list[dict[str, float]]) -> DataFrame:
    """Every traffic row under every profile: policy WFQ, both weights from the row's class.

    The profiles are a literal array that is unnested in place: one scan, no join.
    """
    candidates = pattern.select("*", F.inline(profile_column(profiles)))
    weight = F.lit(None).cast("double")
    for c in CLASSES:
        weight = F.when(F.col("qos_class") == c, F.col(f"{c.lower()}_weight")).otherwise(weight)
    return candidates.withColumns({
        "scheduling_policy": F.lit("WFQ"), "tos_queue_weight": weight, "min_tos_weight": weight,
    })


def class_delay_summary(scored: DataFrame, sla_ms: dict[str, float]) -> DataFrame:
    """Per profile and class: rows, mean, exact p90, largest delay and violation rate.

    Classes without an agreement, NULL among them, keep their rows and have no violation rate.
    """
    known = scored
    limit = sla_threshold(F.col("qos_class"), sla_ms)
    keys = ["profile_no", "qos_class"]
    basic = known.groupBy(*keys).agg(
        F.count("*").alias("rows"), F.avg("pred_ms").alias("mean_delay_ms"), F.max("pred_ms").alias("max_delay_ms"),
        F.avg((F.col("pred_ms") > limit).cast("double")).alias("violation_rate"),
    )
    tails = exact_percentiles(known, keys, "pred_ms", {"p90_delay_ms": 0.9})
    return null_safe_join(basic, tails, keys, "left")


def profile_scores(summary: DataFrame, profiles: list[dict[str, float]], sla_ms: dict[str, float]) -> DataFrame:
    """One wide row per profile: class columns, feasibility, violation and delay scores.

    Feasible means every class is present and its mean delay is within its agreement.
    """
    named = summary.sparkSession.range(len(profiles)).select(
        F.col("id").cast("int").alias("profile_no")
    ).withColumn("_p", F.get(profile_column(profiles), F.col("profile_no")))
    wide = []
    for c in CLASSES:
        here = F.col("qos_class") == c
        prefix = c.lower()
        wide.append(F.coalesce(F.max(F.when(here, F.col("rows"))), F.lit(0)).alias(f"{prefix}_rows"))
        for name in ("mean_delay_ms", "p90_delay_ms", "max_delay_ms", "violation_rate"):
            wide.append(F.max(F.when(here, F.col(name))).alias(f"{prefix}_{name}"))
    by_profile = summary.groupBy("profile_no").agg(F.sum("rows").alias("all_rows"), *wide)
    joined = named.join(by_profile, "profile_no", "left")
    feasible, violation, delay = F.lit(True), F.lit(0.0), F.lit(0.0)
    for c in CLASSES:
        mean = F.col(f"{c.lower()}_mean_delay_ms")
        load = mean / F.lit(sla_ms[c])
        feasible = feasible & F.coalesce(mean <= sla_ms[c], F.lit(False))
        violation = violation + F.coalesce(F.lit(CLASS_PENALTY[c]) * F.greatest(F.lit(0.0), load - 1), F.lit(0.0))
        delay = delay + F.coalesce(F.lit(CLASS_PENALTY[c]) * load, F.lit(0.0))
    counted = F.coalesce(F.col("all_rows"), F.lit(0))
    out = joined.select(
        F.col("_p.profile").alias("profile"), *[F.col(f"_p.{c.lower()}_weight") for c in CLASSES],
        counted.alias("traffic_rows"),
        *[F.col(f"{c.lower()}_{n}") for c in CLASSES
          for n in ("mean_delay_ms", "p90_delay_ms", "max_delay_ms", "violation_rate")],
        *[F.coalesce(F.col(f"{c.lower()}_rows"), F.lit(0)).alias(f"{c.lower()}_rows") for c in CLASSES],
        *[F.lit(sla_ms[c]).alias(f"{c.lower()}_sla_ms") for c in CLASSES],
        feasible.alias("sla_feasible"), violation.alias("weighted_violation_score"),
        delay.alias("weighted_delay_score"), "profile_no",
    )
    return out


def rank_profiles(scores: DataFrame) -> DataFrame:
    """Feasible first, then smallest violation, then smallest delay; rank 1 is recommended.

    The table has one row per candidate profile given by the caller.
    """
    order = Window.partitionBy(F.lit(0)).orderBy(
        F.desc("sla_feasible"), "weighted_violation_score", "weighted_delay_score", "profile_no"
    )
    ranked = scores.withColumn("rank", F.row_number().over(order))
    return ranked.withColumn("recommended", F.col("rank") == 1).drop("profile_no")


def evaluate_profiles(
    pattern: DataFrame, predict_log_delay, profiles: list[str] | None = None, sla_ms: dict[str, float] | None = None,
) -> DataFrame:
    """Rank candidate profiles for a traffic pattern.

    ``predict_log_delay`` takes the candidate table and returns it with ``y_pred`` (log seconds);
    all profiles are scored in one pass. The scored delays are written once to the shared folder,
    because the exact percentiles read them more than once and a model may be costly.
    """
    parsed = parse_profiles(profiles or PROFILES)
    sla = sla_ms or ALLOCATION_SLA_MS
    candidates = apply_profiles(traffic_pattern(pattern), parsed)
    scored = predict_log_delay(candidates).select(
        "profile_no", "qos_class", delay_ms(F.col("y_pred")).alias("pred_ms")
    )
    scored = materialize(scored, "profiles")
    return rank_profiles(profile_scores(class_delay_summary(scored, sla), parsed, sla))
