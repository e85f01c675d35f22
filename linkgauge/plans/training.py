"""Model jobs from table to report."""

from __future__ import annotations

from functools import reduce
from time import perf_counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkgauge.functions.numeric import delay_ms, log_target
from linkgauge.functions.rules import EVALUATION_SLA_MS
from linkgauge.operators.allocation import evaluate_profiles
from linkgauge.operators.evaluation import (
    SLICES, auc_roc, binary_metrics, class_weights, cv_summary, grouped_metrics, metric_slices, rank_importance,
    regression_metrics, resolve_unit, sla_confusion, slice_metrics, with_delay_ms,
)
from linkgauge.operators.models import (
    Encoders, ModelSpec, boosted_model, fit_model, loss_label, loss_probabilities, loss_specs, out_of_fold, regression_specs,
)
from linkgauge.operators.profiling import require_columns, split_target
from linkgauge.operators.splitting import kfold, stratified_kfold, train_test_split
from linkgauge.plans.targets import drop_list, feature_columns
from linkgauge.session import materialize

METRIC_NAMES = {"e": {"mae": "mae", "rmse": "rmse", "r2": "r2"}}
RESULT_SCHEMA = (
    "dataset string, model string, target string, status string, error_message string, train_rows bigint, "
    "test_rows bigint, feature_count int, mae double, rmse double, r2_score double, cv_folds int, "
    "cv_mae_mean double, cv_mae_std double, cv_rmse_mean double, cv_rmse_std double, cv_r2_mean double, "
    "cv_r2_std double, training_time_sec double, inference_time_sec double, inference_time_ms_per_row double"
)
IMPORTANCE_SCHEMA = "dataset string, model string, target string, feature string, importance double"


def cross_validate(
    train: DataFrame, spec: ModelSpec, target: str, features: list[str], k: int, encoders: Encoders | None = None
) -> DataFrame:
    """MAE, RMSE and R² per fold; all three come from the same predictions."""
    scored = out_of_fold(train, spec, target, features, k, encoders=encoders)
    return grouped_metrics(scored, ["fold"], {"e": (target, "y_pred")}, METRIC_NAMES)


def benchmark_models(
    df: DataFrame, target: str, job: str, id_columns: list[str], dataset: str, specs: list[ModelSpec] | None = None,
    test_size: float = 0.2, k: int = 5, seed: int = 42, extra_drop: list[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Hold-out and cross-validated metrics, timings and importances of each model.

    Encoders are fitted once for all models, so the first that uses one has its time. A model that cannot run or predicts a non-finite number becomes a row with a status instead
    of ending the job. One row per model reaches the driver.
    """
    spark = df.sparkSession
    data = train_test_split(split_target(df, target, []), id_columns, test_size, seed)
    features = [c for c in feature_columns(data.columns, job, target, extra_drop) if c not in id_columns]
    specs = specs or regression_specs(seed=seed)
    # models on encoded inputs read nothing but these: without folds, ids are not written
    ids = id_columns if k > 1 or any(s.fit is not None and s.fit_encoded is None for s in specs) else []
    data = materialize(data.select(*dict.fromkeys([*ids, *features, target, "is_test"])), "benchmark")
    train, test = data.filter(~F.col("is_test")), data.filter("is_test")
    sizes = data.agg(F.count_if(~F.col("is_test")).alias("train"), F.count_if("is_test").alias("test")).head()
    results, importances = [], []
    encoders = Encoders(features)
    for spec in specs:
        facts = [dataset, spec.name, target]
        counted = [sizes["train"], sizes["test"], len(features)]
        if spec.fit is None:
            results.append((*facts, "skipped", spec.skip_reason, *counted, *[None] * 3, k, *[None] * 9))
            continue
        try:
            cv = [None] * 6
            if k > 1:
                folds = cross_validate(kfold(train, id_columns, k, seed), spec, target, features, k, encoders)
                row = cv_summary(folds, []).head()
                cv = [row[f"cv_{m}_{s}"] for m in ("mae", "rmse", "r2") for s in ("mean", "std")]
            started = perf_counter()
            fitted = fit_model(spec, "all", train, target, features, encoders)
            fit_seconds = perf_counter() - started
            started = perf_counter()
            scored = fitted.predict(test)
            bad = F.col("y_pred").isNull() | F.isnan("y_pred") | (F.abs("y_pred") == float("inf"))
            checked = grouped_metrics(scored.withColumn("_bad", bad.cast("int")), ["_bad"],
                                      {"e": (target, "y_pred")}, METRIC_NAMES)
            rows = {r["_bad"]: r for r in checked.toLocalIterator()}
            if 1 in rows:
                raise ValueError("model produced non-finite predictions")
            score_seconds = perf_counter() - started
            m = rows[0]
            results.append((*facts, "ok", "", *counted, m["mae"], m["rmse"], m["r2"], k, *cv, fit_seconds,
                            score_seconds, score_seconds / max(sizes["test"], 1) * 1000))
            importances += [(*facts, name, value) for name, value in fitted.importances.items()]
        except Exception as error:
            message = f"{type(error).__name__}: {error}"
            results.append((*facts, "failed", message, *counted, *[None] * 3, k, *[None] * 9))
    table = spark.createDataFrame(importances, IMPORTANCE_SCHEMA)
    return spark.createDataFrame(results, RESULT_SCHEMA), rank_importance(table, ["dataset", "model", "target"])


def delay_folds(flows: DataFrame, id_columns: list[str], k: int = 5, seed: int = 42) -> tuple[DataFrame, list[str]]:
    """The rows of the delay models with their fold, written once for all folds and models, and the model inputs.

    Only ids, inputs, slice columns and the delay are written.
    """
    require_columns(flows, ["log_avg_delay", "avg_delay", "qos_class", "scenario", "scheduling_policy"])
    data = split_target(flows, "log_avg_delay", [])
    if "fold" not in data.columns:
        data = kfold(data, id_columns, k, seed)
    features = [c for c in feature_columns(data.columns, "delay", "log_avg_delay") if c not in id_columns]
    kept = dict.fromkeys([*id_columns, *features, *SLICES, "avg_delay", "log_avg_delay", "fold"])
    return materialize(data.select(*kept), "folds"), features


def _delay_scored(data: DataFrame, features: list[str], spec: ModelSpec, k: int) -> DataFrame:
    scored = out_of_fold(data, spec, "log_avg_delay", features, k)
    return with_delay_ms(scored.withColumn("y_true", F.col("log_avg_delay")), "avg_delay").withColumn(
        "model", F.lit(spec.name)
    )


def delay_scored(
    flows: DataFrame, spec: ModelSpec, id_columns: list[str], k: int = 5, seed: int = 42
) -> DataFrame:
    """Out-of-fold log-delay predictions with ids, slice columns and delays in ms."""
    data, features = delay_folds(flows, id_columns, k, seed)
    return _delay_scored(data, features, spec, k)


def evaluate_delay_models(
    flows: DataFrame, specs: list[ModelSpec], id_columns: list[str], k: int = 5, seed: int = 42,
    sla_ms: dict[str, float] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Slice metrics and SLA confusion of several models."""
    data, features = delay_folds(flows, id_columns, k, seed)
    scored = reduce(DataFrame.unionByName, [_delay_scored(data, features, spec, k) for spec in specs])
    scored = materialize(
        scored.select("model", "qos_class", "scenario", "scheduling_policy", "y_true", "y_pred", "true_ms", "pred_ms"),
        "scored",
    )
    return slice_metrics(scored, ["model"]), sla_confusion(scored, sla_ms or EVALUATION_SLA_MS, ["model"])


def metric_target_eval(
    flows: DataFrame, target: str, spec: ModelSpec, id_columns: list[str], k: int = 5, seed: int = 42,
    scale: float = 1000.0, unit: str = "ms", sla_ms: dict[str, float] | None = None,
) -> tuple[DataFrame, DataFrame | None]:
    """Fit on the log of any outcome, score out of fold, transform back, slice."""
    require_columns(flows, ["qos_class", "scenario", "scheduling_policy", target])
    data = split_target(flows, target, []).withColumn("_log", log_target(F.col(target)))
    if "fold" not in data.columns:
        data = kfold(data, id_columns, k, seed)
    dropped = drop_list("delay", "_log")
    features = [c for c in data.columns if c not in {*dropped, *id_columns, "_log", "fold"}]
    # written once: every fold reads all rows to fit and its own to score
    data = materialize(data.select(*dict.fromkeys([*id_columns, *features, *SLICES, target, "_log", "fold"])), "folds")
    scored = out_of_fold(data, spec, "_log", features, k).select(
        "qos_class", "scenario", "scheduling_policy", F.col(target).alias("y_true"), F.exp("y_pred").alias("y_pred")
    )
    scale, unit = resolve_unit([target], scale, unit)
    slices = metric_slices(scored, target, scale, unit)
    if sla_ms is None:
        return slices, None
    scaled = scored.withColumns({"true_ms": F.col("y_true") * scale, "pred_ms": F.col("y_pred") * scale})
    return slices, sla_confusion(scaled, sla_ms)


def evaluate_loss_classifiers(
    flows: DataFrame, id_columns: list[str], k: int = 5, seed: int = 42, cut: float = 0.5,
    specs: dict | None = None, qos_class: str = "Bronze",
) -> DataFrame:
    """Precision, recall, F1 and AUC of the loss classifiers on one class."""
    require_columns(flows, ["qos_class", "packet_loss_rate"])
    data = materialize(stratified_kfold(loss_label(flows, qos_class), "label", id_columns, k, seed), "loss")
    features = [c for c in feature_columns(data.columns, "loss", "label") if c not in id_columns]
    encoders = Encoders(features)
    weights = class_weights(data).select("scale_pos_weight", "positives", "negatives")
    reports = []
    for name, (make, weighting) in (specs or loss_specs(seed=seed)).items():
        scored = materialize(
            loss_probabilities(data, make, weighting, features, k, encoders=encoders).select("label", "score"), "loss-scored")
        one = binary_metrics(scored, cut=cut).select("rows", "precision", "recall", "f1_score")
        reports.append(one.select(
            F.lit(name).alias("model"), F.lit(f"{qos_class}").alias("qos_class"), "*",
            auc_roc(scored).select("auc_roc").scalar().alias("auc_roc"),
            (weights.select("scale_pos_weight").scalar() if weighting == "ratio" else F.lit(None).cast("double"))
            .alias("scale_pos_weight"),
        ))
    return reduce(DataFrame.unionByName, reports)


def holdout_in_ms(scored: DataFrame, by: list[str]) -> DataFrame:
    """Hold-out metrics in log units and, transformed back, in ms per model."""
    both = scored.withColumns({"true_ms": delay_ms(F.col("y_true")), "pred_ms": delay_ms(F.col("y_pred"))})
    return regression_metrics(both, by)


def recommend_allocation(
    flows: DataFrame, id_columns: list[str], spec: ModelSpec | None = None, profiles: list[str] | None = None,
    sla_ms: dict[str, float] | None = None, pattern: DataFrame | None = None, seed: int = 42,
) -> DataFrame:
    """Fit a delay model on 80 % of the flows, score every profile, rank; hold-out errors attached."""
    data = train_test_split(split_target(flows, "log_avg_delay", []), id_columns, 0.2, seed)
    features = [c for c in feature_columns(data.columns, "delay", "log_avg_delay") if c not in id_columns]
    if pattern is not None:
        require_columns(pattern, features)
    data = materialize(data.select(*dict.fromkeys([*features, "log_avg_delay", "is_test"])), "allocation")
    fitted = (spec or boosted_model(seed=seed)).fit(data.filter(~F.col("is_test")), "log_avg_delay", features)
    held = grouped_metrics(
        fitted.predict(data.filter("is_test")), [], {"e": ("log_avg_delay", "y_pred")},
        {"e": {"rmse": "holdout_rmse_log_delay", "r2": "holdout_r2_log_delay"}},
    )
    traffic = (data if pattern is None else pattern).select(*features)
    ranked = evaluate_profiles(traffic, fitted.predict, profiles, sla_ms)
    return ranked.withColumns({
        name: held.select(name).scalar() for name in ("holdout_rmse_log_delay", "holdout_r2_log_delay")
    })
