"""Queries for metrics, slices, alarms, comparisons and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.adapters import DELAY_SQL, delay_flows, table
from catalog.registry import query, r, rounded
from linkgauge.functions import rules
from linkgauge.functions.numeric import log_target
from linkgauge.operators import comparison, evaluation, models, ordering
from linkgauge.plans.training import holdout_in_ms

SCORED_INPUT = ["row_id", "fold", "qos_class", "scenario", "scheduling_policy", "tos", "routing_hops", "avg_delay",
                "jitter", "packet_loss_rate", "delay_p90"]


def flows_with_log(spark, sf) -> DataFrame:
    return delay_flows(spark, sf, SCORED_INPUT).withColumn("y_true", log_target(F.col("avg_delay")))


def mean_scored(spark, sf) -> DataFrame:
    """Out-of-fold mean predictions of the log delay."""
    return evaluation.with_delay_ms(models.mean_out_of_fold(flows_with_log(spark, sf), "y_true"), "avg_delay")


def line_scored(spark, sf) -> DataFrame:
    """Out-of-fold straight-line predictions of the log delay from the hop count."""
    return evaluation.with_delay_ms(
        models.line_out_of_fold(flows_with_log(spark, sf), "routing_hops", "y_true"), "avg_delay")


FLOWS = f"fl AS ({DELAY_SQL}), lg AS (SELECT *, ln(greatest(avg_delay, 1e-9)) AS y_true FROM fl)"
MEAN_SQL = f"""{FLOWS}, fs AS (SELECT fold, sum(y_true) AS s, count(*) AS n FROM lg GROUP BY 1),
tt AS (SELECT sum(s) AS s, sum(n) AS n FROM fs),
sc AS (SELECT lg.*, (tt.s - fs.s) / (tt.n - fs.n) AS y_pred FROM lg JOIN fs USING (fold), tt),
scored AS (SELECT *, avg_delay * 1000 AS true_ms, exp(y_pred) * 1000 AS pred_ms FROM sc)"""
LINE_SQL = f"""{FLOWS}, folds AS (SELECT DISTINCT fold FROM lg),
ft AS (SELECT f.fold, regr_slope(y_true, routing_hops) AS b, regr_intercept(y_true, routing_hops) AS a
 FROM folds f JOIN lg ON lg.fold <> f.fold GROUP BY 1),
sc AS (SELECT lg.*, a + b * routing_hops AS y_pred FROM lg JOIN ft USING (fold)),
scored AS (SELECT *, avg_delay * 1000 AS true_ms, exp(y_pred) * 1000 AS pred_ms FROM sc)"""


def _metrics(y: str, p: str, kinds: dict[str, str], digits: int = 6) -> str:
    made = {
        "mae": f"avg(abs({p} - {y}))", "rmse": f"sqrt(avg(power({p} - {y}, 2)))",
        "rmsle": f"sqrt(avg(power(ln(1 + greatest({p}, 0)) - ln(1 + greatest({y}, 0)), 2)))",
        "r2": f"CASE WHEN count(*) >= 2 AND var_pop({y}) > 1e-8 THEN 1 - sum(power({p} - {y}, 2)) / (var_pop({y}) * count(*)) END",
    }
    return ", ".join(f"round({made[k]}, {digits}) AS {name}" for k, name in kinds.items())


DELAY_METRICS = _metrics("y_true", "y_pred", evaluation.LOG_NAMES) + ", " + _metrics("true_ms", "pred_ms", evaluation.MS_NAMES)
SLICE_KEYS = ("CASE grouping_id(qos_class, scenario, scheduling_policy) WHEN 7 THEN 'overall' WHEN 3 THEN 'qos_class' "
              "WHEN 5 THEN 'scenario' ELSE 'scheduling_policy' END AS slice_type, "
              "coalesce(qos_class, scenario, scheduling_policy, 'all') AS slice_value")
SETS = "GROUP BY GROUPING SETS ((), (qos_class), (scenario), (scheduling_policy))"


@query("slice_metrics", f"WITH {MEAN_SQL} SELECT {SLICE_KEYS}, count(*) AS rows, {DELAY_METRICS} FROM scored {SETS}")
def slice_metrics(spark, sf):
    return rounded(evaluation.slice_metrics(mean_scored(spark, sf)))


@query("slice_metrics_line", f"WITH {LINE_SQL} SELECT {SLICE_KEYS}, count(*) AS rows, {DELAY_METRICS} FROM scored {SETS}")
def slice_metrics_line(spark, sf):
    return rounded(evaluation.slice_metrics(line_scored(spark, sf)))


@query("regression_metrics", f"WITH {LINE_SQL} SELECT count(*) AS rows, {DELAY_METRICS} FROM scored")
def regression_metrics(spark, sf):
    return rounded(evaluation.regression_metrics(line_scored(spark, sf)))


@query("mean_out_of_fold", f"WITH {MEAN_SQL} SELECT row_id, fold, round(y_pred, 6) AS y_pred FROM scored")
def mean_out_of_fold(spark, sf):
    return rounded(mean_scored(spark, sf).select("row_id", "fold", "y_pred"))


@query("line_out_of_fold", f"WITH {LINE_SQL} SELECT row_id, fold, round(y_pred, 6) AS y_pred FROM scored")
def line_out_of_fold(spark, sf):
    return rounded(line_scored(spark, sf).select("row_id", "fold", "y_pred"))


def _metric_sql(source: str, target: str, family: str, scale: float, unit: str) -> str:
    raw = _metrics("y", "p", {"mae": "mae", "rmse": "rmse", "r2": "r2_score"})
    scaled = _metrics(f"(y * {scale}e0)", f"(p * {scale}e0)",
                      {"mae": "mae_scaled", "rmse": "rmse_scaled", "rmsle": "rmsle_scaled", "r2": "r2_score_scaled"})
    return (f"{source} SELECT {SLICE_KEYS}, count(*) AS rows, {raw}, {scaled}, '{target}' AS target, "
            f"'{family}' AS target_family, 'native' AS target_unit, '{unit}' AS scaled_unit, {scale}e0 AS unit_scale "
            f"FROM m {SETS}")


def _target_sql(target: str, family: str, scale: float, unit: str) -> str:
    source = f"""WITH fl AS ({DELAY_SQL}), lg AS (SELECT *, ln(greatest({target}, 1e-9)) AS lt FROM fl),
fs AS (SELECT fold, sum(lt) AS s, count(*) AS n FROM lg GROUP BY 1), tt AS (SELECT sum(s) AS s, sum(n) AS n FROM fs),
m AS (SELECT lg.*, {target} AS y, exp((tt.s - fs.s) / (tt.n - fs.n)) AS p FROM lg JOIN fs USING (fold), tt)"""
    return _metric_sql(source, target, family, scale, unit)


def _metric_query(spark, sf, target):
    flows = delay_flows(spark, sf, SCORED_INPUT).withColumn("_log", log_target(F.col(target)))
    scored = models.mean_out_of_fold(flows, "_log").withColumns({
        "y_true": F.col(target), "y_pred": F.exp("y_pred")})
    return rounded(evaluation.metric_slices(scored, target, *evaluation.resolve_unit([target])))


@query("metric_slices_tail_delay", _target_sql("delay_p90", "tail_delay", 1000.0, "ms"))
def metric_slices_tail_delay(spark, sf):
    return _metric_query(spark, sf, "delay_p90")


@query("metric_slices_jitter", _target_sql("jitter", "jitter", 1000.0, "ms"))
def metric_slices_jitter(spark, sf):
    return _metric_query(spark, sf, "jitter")


@query("metric_slices_loss", _target_sql("packet_loss_rate", "loss", 100.0, "%"))
def metric_slices_loss(spark, sf):
    return _metric_query(spark, sf, "packet_loss_rate")


CONFUSION = """count(*) AS rows, count(*) FILTER (WHERE true_ms > lim) AS actual_violations,
 count(*) FILTER (WHERE pred_ms > lim) AS predicted_violations,
 round(count(*) FILTER (WHERE true_ms > lim) / count(*), 6) AS actual_violation_rate, {extra}
 round(coalesce(count(*) FILTER (WHERE true_ms > lim AND pred_ms > lim) / nullif(count(*) FILTER (WHERE pred_ms > lim), 0), 0), 6) AS precision,
 round(coalesce(count(*) FILTER (WHERE true_ms > lim AND pred_ms > lim) / nullif(count(*) FILTER (WHERE true_ms > lim), 0), 0), 6) AS recall,
 round(coalesce(2 * count(*) FILTER (WHERE true_ms > lim AND pred_ms > lim) / nullif(count(*) FILTER (WHERE true_ms > lim)
  + count(*) FILTER (WHERE pred_ms > lim), 0), 0), 6) AS f1_score"""
PREDICTED = "round(count(*) FILTER (WHERE pred_ms > lim) / count(*), 6) AS predicted_violation_rate,"


@query("sla_confusion", f"""
WITH {LINE_SQL}, s AS (SELECT *, CASE qos_class WHEN 'Gold' THEN 30e0 WHEN 'Silver' THEN 50e0 ELSE 60e0 END AS lim FROM scored)
SELECT qos_class, lim AS sla_threshold_ms, {CONFUSION.format(extra=PREDICTED)} FROM s GROUP BY 1, 2""")
def sla_confusion(spark, sf):
    return rounded(evaluation.sla_confusion(line_scored(spark, sf), rules.EVALUATION_SLA_MS))


def _sweep_sql(qos_class: str, limits: list[float]) -> str:
    rows = ", ".join(f"({x}e0)" for x in limits)
    return f"""WITH {LINE_SQL}, s AS (SELECT * FROM scored, (VALUES {rows}) t(lim) WHERE qos_class = '{qos_class}')
SELECT qos_class, lim AS sla_threshold_ms, {CONFUSION.format(extra='')} FROM s GROUP BY 1, 2"""


@query("threshold_sweep_bronze", _sweep_sql("Bronze", rules.BRONZE_SWEEP_MS))
def threshold_sweep_bronze(spark, sf):
    return rounded(evaluation.threshold_sweep(line_scored(spark, sf), "Bronze", rules.BRONZE_SWEEP_MS))


@query("threshold_sweep_silver", _sweep_sql("Silver", [50.0, 45.0, 40.0, 35.0, 32.0, 30.0]))
def threshold_sweep_silver(spark, sf):
    return rounded(evaluation.threshold_sweep(line_scored(spark, sf), "Silver", [50.0, 45.0, 40.0, 35.0, 32.0, 30.0]))


LOSS = "packet_loss_rate > 0"
LOSS_SQL = f"""WITH fl AS ({DELAY_SQL}), b AS (SELECT row_id, scheduling_policy,
 cast(CASE WHEN packet_loss_rate > 0 THEN 1 ELSE 0 END AS int) AS label,
 (offered_bandwidth + routing_hops * 100) / 11000e0 AS score FROM fl WHERE qos_class = 'Bronze')"""


def loss_scores(spark, sf):
    names = ["row_id", "qos_class", "scheduling_policy", "packet_loss_rate", "offered_bandwidth", "routing_hops"]
    labelled = models.loss_label(delay_flows(spark, sf, names))
    score = (F.col("offered_bandwidth") + F.col("routing_hops") * 100) / 11000
    return labelled.select("row_id", "scheduling_policy", "label", score.alias("score"))


@query("loss_label", f"{LOSS_SQL} SELECT row_id, label FROM b")
def loss_label(spark, sf):
    return loss_scores(spark, sf).select("row_id", "label")


@query("binary_metrics", f"""{LOSS_SQL} SELECT scheduling_policy, count(*) AS rows, count(*) FILTER (WHERE label = 1) AS positives,
 count(*) FILTER (WHERE score >= 0.5e0) AS predicted,
 round(count(*) FILTER (WHERE label = 1 AND score >= 0.5e0) / count(*) FILTER (WHERE score >= 0.5e0), 6) AS precision,
 round(count(*) FILTER (WHERE label = 1 AND score >= 0.5e0) / count(*) FILTER (WHERE label = 1), 6) AS recall,
 round(2 * count(*) FILTER (WHERE label = 1 AND score >= 0.5e0) / (count(*) FILTER (WHERE label = 1)
  + count(*) FILTER (WHERE score >= 0.5e0)), 6) AS f1_score FROM b GROUP BY 1""")
def binary_metrics(spark, sf):
    return rounded(evaluation.binary_metrics(loss_scores(spark, sf), ["scheduling_policy"]))


AUC = """SELECT {keys} cast(sum(pos) AS bigint) AS positives, cast(sum(neg) AS bigint) AS negatives,
 round(sum(pos * (below + neg / 2e0)) / (sum(pos) * sum(neg)), 6) AS auc_roc FROM (
 SELECT *, sum(neg) OVER ({part} ORDER BY score) - neg AS below FROM (
  SELECT {keys} score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg FROM {source} GROUP BY ALL)) {group}"""


@query("auc_roc", f"{LOSS_SQL} " + AUC.format(keys="", part="", source="b", group=""))
def auc_roc(spark, sf):
    return rounded(evaluation.auc_roc(loss_scores(spark, sf)))


@query("auc_roc_by_policy", f"{LOSS_SQL} " + AUC.format(
    keys="scheduling_policy,", part="PARTITION BY scheduling_policy", source="b", group="GROUP BY 1"))
def auc_roc_by_policy(spark, sf):
    return rounded(evaluation.auc_roc(loss_scores(spark, sf), ["scheduling_policy"]))


@query("auc_roc_labels", "WITH b AS (SELECT toxic AS label, (doc_id * 7919 % 1009) / 1009e0 AS score FROM labels) "
       + AUC.format(keys="", part="", source="b", group=""))
def auc_roc_labels(spark, sf):
    scored = table(spark, sf, "labels").select(
        F.col("toxic").alias("label"), (F.col("doc_id") * 7919 % 1009 / 1009).alias("score"))
    return rounded(evaluation.auc_roc(scored))


@query("class_weights", f"""{LOSS_SQL} SELECT count(*) FILTER (WHERE label = 1) AS positives,
 count(*) FILTER (WHERE label = 0) AS negatives,
 round(count(*) FILTER (WHERE label = 0) / count(*) FILTER (WHERE label = 1), 6) AS scale_pos_weight,
 round(count(*) / (2 * count(*) FILTER (WHERE label = 1)), 6) AS positive_weight,
 round(count(*) / (2 * count(*) FILTER (WHERE label = 0)), 6) AS negative_weight FROM b""")
def class_weights(spark, sf):
    return rounded(evaluation.class_weights(loss_scores(spark, sf)))


FOLD_SQL = f"{LINE_SQL}, fm AS (SELECT fold, {_metrics('y_true', 'y_pred', {'mae': 'mae', 'rmse': 'rmse', 'r2': 'r2'}, 12)} FROM scored GROUP BY 1)"


def fold_metrics(scored: DataFrame) -> DataFrame:
    return evaluation.grouped_metrics(scored, ["fold"], {"e": ("y_true", "y_pred")},
                                      {"e": {"mae": "mae", "rmse": "rmse", "r2": "r2"}})


@query("cv_summary", f"WITH {FOLD_SQL} SELECT count(*) AS cv_folds, " + ", ".join(
    f"round(avg({m}), 6) AS cv_{m}_mean, round(stddev_pop({m}), 6) AS cv_{m}_std" for m in ("mae", "rmse", "r2")) + " FROM fm")
def cv_summary(spark, sf):
    return rounded(evaluation.cv_summary(fold_metrics(line_scored(spark, sf)), []))


@query("holdout_in_ms", f"""WITH {LINE_SQL}, h AS (SELECT *, exp(y_true) * 1000 AS t2 FROM scored WHERE fold = 0)
SELECT 'line' AS model, count(*) AS rows, {_metrics('y_true', 'y_pred', evaluation.LOG_NAMES)},
 {_metrics('t2', 'pred_ms', evaluation.MS_NAMES)} FROM h""")
def holdout_in_ms_query(spark, sf):
    held = line_scored(spark, sf).filter(F.col("fold") == 0).withColumn("model", F.lit("line"))
    return rounded(holdout_in_ms(held, ["model"]))


PAIR_SQL = f"""WITH {LINE_SQL}, fm AS (SELECT fold, avg(abs(y_pred - y_true)) AS a,
 avg(abs(y_true - (SELECT avg(y_true) FROM lg))) AS b FROM scored GROUP BY 1), dd AS (SELECT *, a - b AS d FROM fm)"""


@query("paired_statistics", PAIR_SQL + """, rk AS (SELECT *, rank() OVER (ORDER BY abs(d)) AS k FROM dd)
SELECT count(*) AS folds, round(avg(a), 6) AS first_mean, round(stddev_samp(a), 6) AS first_std, round(avg(b), 6) AS second_mean,
 round(stddev_samp(b), 6) AS second_std, round(avg(d), 6) AS mean_diff, round(stddev_samp(d), 6) AS diff_std,
 count(*) FILTER (WHERE d = 0) AS zero_diffs, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 4) AS t, count(*) AS pairs,
 coalesce(cast(sum(k) FILTER (WHERE d > 0) AS double), 0e0) AS w_plus, coalesce(cast(sum(k) FILTER (WHERE d < 0) AS double), 0e0) AS w_minus,
 0e0 AS tie_term FROM rk""")
def paired_statistics(spark, sf):
    return rounded(comparison.paired_statistics(_fold_pairs(spark, sf)).withColumn("t", F.round("t", 4)))


def _fold_scores(spark, sf) -> DataFrame:
    scored = line_scored(spark, sf)
    middle = flows_with_log(spark, sf).agg(F.avg("y_true")).scalar()
    errors = scored.groupBy("fold").agg(
        F.avg(F.abs(F.col("y_pred") - F.col("y_true"))).alias("a"), F.avg(F.abs(F.col("y_true") - middle)).alias("b"))
    return errors.select("fold", F.inline(F.array(
        F.struct(F.lit("line").alias("model"), F.col("a").alias("score")),
        F.struct(F.lit("mean").alias("model"), F.col("b").alias("score")))))


def _fold_pairs(spark, sf) -> DataFrame:
    return comparison.pair_folds(_fold_scores(spark, sf), "line", "mean")


@query("paired_compare")
def paired_compare(spark, sf):
    return rounded(comparison.paired_compare(_fold_scores(spark, sf), "line", "mean"))


@query("latest_run", """
SELECT o_custkey AS model, o_orderpriority AS slice_value, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS order_id,
 max(o_orderdate) AS run_timestamp FROM orders GROUP BY 1, 2""")
def latest_run(spark, sf):
    report = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("model"), F.col("o_orderpriority").alias("slice_value"),
        F.col("o_orderdate").alias("run_timestamp"), F.col("o_orderkey").alias("order_id"))
    return evaluation.latest_run(report, ["model", "slice_value"])


@query("class_table", f"""WITH {LINE_SQL}, m AS (SELECT scenario, qos_class, avg(abs(pred_ms - true_ms)) AS mae FROM scored GROUP BY 1, 2)
SELECT scenario, round(max(mae) FILTER (WHERE qos_class = 'Gold'), 6) AS "Gold",
 round(max(mae) FILTER (WHERE qos_class = 'Silver'), 6) AS "Silver", round(max(mae) FILTER (WHERE qos_class = 'Bronze'), 6) AS "Bronze"
FROM m GROUP BY 1""")
def class_table(spark, sf):
    report = evaluation.grouped_metrics(line_scored(spark, sf), ["scenario", "qos_class"],
                                        {"ms": ("true_ms", "pred_ms")}, {"ms": {"mae": "mae"}})
    return rounded(evaluation.class_table(report, "scenario", "qos_class", rules.CLASSES, "mae"))


@query("rank_importance", """
WITH i AS (SELECT p_type AS model, p_brand AS feature, sum(p_retailprice) AS importance FROM part GROUP BY 1, 2)
SELECT model, feature, round(importance, 6) AS importance,
 round(importance / sum(importance) OVER (PARTITION BY model), 6) AS importance_normalized,
 cast(row_number() OVER (PARTITION BY model ORDER BY round(importance, 4) DESC, feature) AS int) AS rank FROM i""")
def rank_importance(spark, sf):
    importance = table(spark, sf, "part").groupBy(
        F.col("p_type").alias("model"), F.col("p_brand").alias("feature")).agg(
        F.round(F.sum("p_retailprice"), 4).alias("importance"))
    return rounded(evaluation.rank_importance(importance, ["model"]))


@query("exact_percentiles", """
SELECT l_returnflag, quantile_cont(l_extendedprice, 0.1) AS p10, quantile_cont(l_extendedprice, 0.5) AS p50,
 quantile_cont(l_extendedprice, 0.9) AS p90, quantile_cont(l_extendedprice, 1.0) AS top FROM lineitem GROUP BY 1""")
def exact_percentiles(spark, sf):
    lines = table(spark, sf, "lineitem")
    wanted = {"p10": 0.1, "p50": 0.5, "p90": 0.9, "top": 1.0}
    return rounded(ordering.exact_percentiles(lines, ["l_returnflag"], "l_extendedprice", wanted))


@query("union_models", f"""WITH {MEAN_SQL}, l AS (SELECT 'mean' AS model, qos_class, true_ms, pred_ms FROM scored UNION ALL
 SELECT 'half', qos_class, true_ms, true_ms / 2 FROM scored)
SELECT model, count(*) AS rows, {_metrics('true_ms', 'pred_ms', {'mae': 'mae', 'rmse': 'rmse'})} FROM l GROUP BY 1""")
def union_models(spark, sf):
    scored = mean_scored(spark, sf).select("qos_class", "true_ms", "pred_ms")
    both = reduce(DataFrame.unionByName, [
        scored.withColumn("model", F.lit("mean")),
        scored.withColumns({"model": F.lit("half"), "pred_ms": F.col("true_ms") / 2})])
    return rounded(evaluation.grouped_metrics(both, ["model"], {"e": ("true_ms", "pred_ms")},
                                              {"e": {"mae": "mae", "rmse": "rmse"}}))
