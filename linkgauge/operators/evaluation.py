"""Error metrics, slices, SLA alarms and comparisons on scored predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkgauge.functions.numeric import clip, delay_ms, share
from linkgauge.functions.rules import CLASSES, sla_threshold, target_family
from linkgauge.operators.ordering import range_positions
from linkgauge.session import materialize
from linkgauge.operators.profiling import require_columns

SLICES = ["qos_class", "scenario", "scheduling_policy"]
SCORED_COLUMNS = ["qos_class", "scenario", "scheduling_policy", "y_true", "y_pred"]
FLAT_VARIANCE = 1e-8  # fixed value: absolute tolerance below which a variance counts as zero


def with_delay_ms(scored: DataFrame, true_seconds: str | None = None) -> DataFrame:
    """Add true and predicted delay in ms to log predictions."""
    truth = F.col(true_seconds) * 1000 if true_seconds else delay_ms(F.col("y_true"))
    return scored.withColumns({"true_ms": truth, "pred_ms": delay_ms(F.col("y_pred"))})


def _moments(pairs: dict[str, tuple[str, str]]) -> list[Column]:
    """Mergeable sums for each (truth, prediction) pair: |e|, e², squared log error, mean and M2 of the truth."""
    out = [F.count("*").alias("n")]
    for name, (truth, guess) in pairs.items():
        y, p = F.col(truth), F.col(guess)
        log_gap = F.log1p(clip(p, low=0)) - F.log1p(clip(y, low=0))
        out += [
            F.sum(F.abs(p - y)).alias(f"{name}_abs"), F.sum((p - y) * (p - y)).alias(f"{name}_sq"),
            F.sum(log_gap * log_gap).alias(f"{name}_log"), F.avg(y).alias(f"{name}_mean"),
            (F.var_pop(y) * F.count(y)).alias(f"{name}_m2"),
        ]
    return out


def _finish(name: str, kinds: dict[str, str]) -> list[Column]:
    """Named metrics out of merged sums; R² is missing for one row or a flat truth."""
    n = F.col("n")
    r2 = F.when(
        (n >= 2) & (F.col(f"{name}_m2") / n > FLAT_VARIANCE), 1 - F.try_divide(F.col(f"{name}_sq"), F.col(f"{name}_m2"))
    )
    made = {
        "mae": F.col(f"{name}_abs") / n, "rmse": F.sqrt(F.col(f"{name}_sq") / n),
        "rmsle": F.sqrt(F.col(f"{name}_log") / n), "r2": r2,
    }
    return [made[kind].alias(alias) for kind, alias in kinds.items()]


def grouped_metrics(
    scored: DataFrame, by: list[str], pairs: dict[str, tuple[str, str]], names: dict[str, dict[str, str]]
) -> DataFrame:
    """Metrics per group, straight from one aggregation."""
    sums = scored.groupBy(*by).agg(*_moments(pairs))
    finished = [c for name, kinds in names.items() for c in _finish(name, kinds)]
    return sums.select(*by, F.col("n").alias("rows"), *finished)


def sliced_metrics(
    scored: DataFrame, by: list[str], slices: list[str], pairs: dict[str, tuple[str, str]],
    names: dict[str, dict[str, str]],
) -> DataFrame:
    """Metrics overall and for every value of every slice column.

    The rows are read and shuffled once, into one cell per combination of slice values; the
    slices are merged from the cells. The truth's spread is merged as M2 around the slice mean,
    so a large mean does not eat a small variance.
    """
    cells = scored.groupBy(*by, *slices).agg(*_moments(pairs))
    tags = [F.struct(F.lit("overall").alias("slice_type"), F.lit("all").alias("slice_value"))]
    tags += [F.struct(F.lit(c).alias("slice_type"), F.col(c).cast("string").alias("slice_value")) for c in slices]
    keys = [*by, "slice_type", "slice_value"]
    tagged = cells.select("*", F.inline(F.array(*tags))).filter(F.col("slice_value").isNotNull())
    slice_rows = Window.partitionBy(*keys)
    for name in pairs:
        center = F.sum(F.col("n") * F.col(f"{name}_mean")).over(slice_rows) / F.sum("n").over(slice_rows)
        tagged = tagged.withColumn(f"{name}_center", center)
    merged = [F.sum("n").alias("n")]
    for name in pairs:
        off = F.col(f"{name}_mean") - F.col(f"{name}_center")
        merged += [F.sum(f"{name}_{part}").alias(f"{name}_{part}") for part in ("abs", "sq", "log")]
        merged.append(F.sum(F.col(f"{name}_m2") + F.col("n") * off * off).alias(f"{name}_m2"))
    sums = tagged.groupBy(*keys).agg(*merged)
    finished = [c for name, kinds in names.items() for c in _finish(name, kinds)]
    return sums.select(*keys, F.col("n").alias("rows"), *finished)


LOG_NAMES = {"mae": "mae_log_delay", "rmse": "rmse_log_delay", "r2": "r2_log_delay"}
MS_NAMES = {"mae": "mae_delay_ms", "rmse": "rmse_delay_ms", "rmsle": "rmsle_delay_ms"}
DELAY_PAIRS = {"log": ("y_true", "y_pred"), "ms": ("true_ms", "pred_ms")}


def regression_metrics(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """MAE, RMSE, R² in log units and MAE, RMSE, RMSLE in ms."""
    return grouped_metrics(scored, by or [], DELAY_PAIRS, {"log": LOG_NAMES, "ms": MS_NAMES})


def slice_metrics(scored: DataFrame, by: list[str] | None = None, slices: list[str] | None = None) -> DataFrame:
    """Delay metrics overall and per service class, scenario and scheduling policy."""
    require_columns(scored, SCORED_COLUMNS)
    return sliced_metrics(scored, by or [], slices or SLICES, DELAY_PAIRS, {"log": LOG_NAMES, "ms": MS_NAMES})


def resolve_unit(targets: list[str], scale: float = 1000.0, unit: str = "ms") -> tuple[float, str]:
    """Milliseconds by default; percent when every target is a rate and the default was kept."""
    if all(target == "packet_loss_rate" for target in targets) and scale == 1000.0:
        return 100.0, "%"
    return scale, unit


def metric_slices(
    scored: DataFrame, target: str, scale: float = 1000.0, unit: str = "ms", by: list[str] | None = None
) -> DataFrame:
    """Slices of any target in its own unit and in a scaled unit."""
    scaled = scored.withColumns({"_ys": F.col("y_true") * scale, "_ps": F.col("y_pred") * scale})
    out = sliced_metrics(
        scaled, by or [], SLICES, {"raw": ("y_true", "y_pred"), "scaled": ("_ys", "_ps")},
        {
            "raw": {"mae": "mae", "rmse": "rmse", "r2": "r2_score"},
            "scaled": {"mae": "mae_scaled", "rmse": "rmse_scaled", "rmsle": "rmsle_scaled", "r2": "r2_score_scaled"},
        },
    )
    return out.withColumns({
        "target": F.lit(target), "target_family": target_family(F.lit(target)), "target_unit": F.lit("native"),
        "scaled_unit": F.lit(unit), "unit_scale": F.lit(float(scale)),
    })


def _rates(true_positive: Column, actual: Column, predicted: Column) -> dict[str, Column]:
    return {
        "precision": share(true_positive, predicted),
        "recall": share(true_positive, actual),
        "f1_score": share(2 * true_positive, actual + predicted),
    }


def sla_confusion(
    scored: DataFrame, sla_ms: dict[str, float], by: list[str] | None = None,
    truth: str = "true_ms", guess: str = "pred_ms",
) -> DataFrame:
    """Violations (strictly above the agreed ms), precision, recall and F1 per service class."""
    by = by or []
    limit = sla_threshold(F.col("qos_class"), sla_ms)
    known = scored.filter(F.col("qos_class").isin(list(sla_ms))).withColumn("sla_threshold_ms", limit)
    over, said = F.col(truth) > F.col("sla_threshold_ms"), F.col(guess) > F.col("sla_threshold_ms")
    counts = known.groupBy(*by, "qos_class", "sla_threshold_ms").agg(
        F.count("*").alias("rows"), F.count_if(over).alias("actual_violations"),
        F.count_if(said).alias("predicted_violations"), F.count_if(over & said).alias("_hits"),
    )
    rates = _rates(F.col("_hits"), F.col("actual_violations"), F.col("predicted_violations"))
    return counts.withColumns({
        "actual_violation_rate": share(F.col("actual_violations"), F.col("rows")),
        "predicted_violation_rate": share(F.col("predicted_violations"), F.col("rows")),
        **rates,
    }).drop("_hits")


def class_order(qos_class: Column) -> Column:
    """Sort key for reports: Gold, Silver, Bronze, others last."""
    place = F.array_position(F.array(*[F.lit(c) for c in CLASSES]), qos_class)
    return F.when(place > 0, place).otherwise(F.lit(len(CLASSES) + 1))


def threshold_sweep(
    scored: DataFrame, qos_class: str, thresholds_ms: list[float], by: list[str] | None = None
) -> DataFrame:
    """Violation metrics of one class under several thresholds.

    All thresholds are counted side by side in one pass; rows are not repeated per threshold.
    """
    by = by or []
    members = scored.filter(F.col("qos_class") == qos_class)
    aggregates = [F.count("*").alias("rows")]
    for i, limit in enumerate(thresholds_ms):
        over, said = F.col("true_ms") > float(limit), F.col("pred_ms") > float(limit)
        aggregates += [F.count_if(over).alias(f"a{i}"), F.count_if(said).alias(f"p{i}"),
                       F.count_if(over & said).alias(f"h{i}")]
    wide = members.groupBy(*by).agg(*aggregates)
    entries = [
        F.struct(F.lit(float(limit)).alias("sla_threshold_ms"), F.col(f"a{i}").alias("actual_violations"),
                 F.col(f"p{i}").alias("predicted_violations"), F.col(f"h{i}").alias("_hits"))
        for i, limit in enumerate(thresholds_ms)
    ]
    long = wide.select(*by, F.lit(qos_class).alias("qos_class"), "rows", F.inline(F.array(*entries)))
    return long.filter(F.col("rows") > 0).withColumns({
        "actual_violation_rate": share(F.col("actual_violations"), F.col("rows")),
        **_rates(F.col("_hits"), F.col("actual_violations"), F.col("predicted_violations")),
    }).drop("_hits")


def binary_metrics(scored: DataFrame, by: list[str] | None = None, cut: float = 0.5) -> DataFrame:
    """Precision, recall and F1 of ``score >= cut`` against ``label`` (0/1)."""
    said, true = F.col("score") >= cut, F.col("label") == 1
    counts = scored.groupBy(*(by or [])).agg(
        F.count("*").alias("rows"), F.count_if(true).alias("positives"), F.count_if(said).alias("predicted"),
        F.count_if(said & true).alias("_hits"),
    )
    return counts.withColumns(_rates(F.col("_hits"), F.col("positives"), F.col("predicted"))).drop("_hits")


def auc_roc(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve with ties averaged, exact, from counts per distinct score.

    Counts are sorted in ranges of about equal size and ranked inside a range; totals of the ranges carry the
    rest. Rows without a score take no part.
    """
    by = by or []
    counts = scored.where(F.col("score").isNotNull()).groupBy(*by, "score").agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))
    placed = range_positions(materialize(counts, "scores"), *[F.col(c) for c in [*by, "score"]])
    inside = Window.partitionBy(*by, "_part").orderBy("score").rowsBetween(Window.unboundedPreceding, 0)
    below = F.sum("neg").over(inside) - F.col("neg")
    won = F.col("pos").cast("double") * (below + F.col("neg") * 0.5)
    cells = placed.withColumn("_won", won).groupBy(*by, "_part").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum("_won").alias("won")
    )
    across = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    earlier = F.sum("neg").over(across) - F.col("neg")
    total = cells.withColumn("won", F.col("won") + F.col("pos").cast("double") * earlier).groupBy(*by).agg(
        F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"), F.sum("won").alias("won")
    )
    area = F.try_divide(F.col("won"), F.col("positives").cast("double") * F.col("negatives"))
    return total.select(*by, "positives", "negatives", area.alias("auc_roc"))


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Negative/positive ratio and balanced weight n / (2 n_c) of both classes."""
    counts = df.agg(F.count_if(F.col(label) == 1).alias("positives"), F.count_if(F.col(label) == 0).alias("negatives"))
    n = (F.col("positives") + F.col("negatives")).cast("double")
    return counts.select(
        "positives", "negatives",
        F.try_divide(F.col("negatives").cast("double"), F.col("positives").cast("double")).alias("scale_pos_weight"),
        F.try_divide(n, 2 * F.col("positives")).alias("positive_weight"),
        F.try_divide(n, 2 * F.col("negatives")).alias("negative_weight"),
    )


def cv_summary(fold_scores: DataFrame, by: list[str]) -> DataFrame:
    """Mean and population deviation of fold MAE, RMSE and R²."""
    out = []
    for name in ("mae", "rmse", "r2"):
        out += [F.avg(name).alias(f"cv_{name}_mean"), F.stddev_pop(name).alias(f"cv_{name}_std")]
    return fold_scores.groupBy(*by).agg(F.count("*").alias("cv_folds"), *out)


def latest_run(report: DataFrame, keys: list[str], order: str = "run_timestamp") -> DataFrame:
    """The last row per key; a maximum, so a key with many runs needs no sort."""
    rest = [c for c in report.columns if c not in keys and c != order]
    picked = report.groupBy(*keys).agg(F.max(F.struct(order, *rest)).alias("_last"))
    return picked.select(*keys, "_last.*").select(*report.columns)


def class_table(report: DataFrame, row: str, column: str, values: list[str], metric: str) -> DataFrame:
    """One row per model, one column per class (a figure's table)."""
    return report.groupBy(row).pivot(column, values).agg(F.first(metric, ignorenulls=True))


def rank_importance(importance: DataFrame, by: list[str]) -> DataFrame:
    """Normalised importance (unless the total is not positive) and rank per model."""
    group = Window.partitionBy(*by)
    total = F.sum("importance").over(group)
    part = F.when(total > 0, F.col("importance") / F.when(total > 0, total)).otherwise(F.col("importance"))
    order = group.orderBy(F.desc("importance"), "feature")
    return importance.withColumns({"importance_normalized": part, "rank": F.row_number().over(order)})


def top_features(attribution: DataFrame, k: int = 8) -> DataFrame:
    """The k features with the largest mean absolute contribution."""
    return attribution.orderBy(F.desc("mean_abs"), "feature").limit(k)
