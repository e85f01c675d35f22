"""Queries for candidate profiles, their scores and the recommendation."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.adapters import DELAY_SQL, delay_flows, table
from catalog.registry import query, r, rounded
from linkgauge.functions import rules
from linkgauge.functions.numeric import delay_ms
from linkgauge.operators import allocation, models
from linkgauge.plans.training import recommend_allocation

PROFILE_ROWS = ", ".join(
    f"({i}, '{rules.profile_name(p)}', {p['Gold']}e0, {p['Silver']}e0, {p['Bronze']}e0)"
    for i, p in enumerate(rules.parse_profiles(rules.PROFILES)))
PROFILES_SQL = f"pf(profile_no, profile, gw, sw, bw) AS (VALUES {PROFILE_ROWS})"
COLUMNS = ["row_id", "tos", "qos_class", "scheduling_policy", "tos_queue_weight", "min_tos_weight", "offered_bandwidth",
           "routing_hops", "avg_delay"]


def formula(candidates):
    """A stand-in delay model: more weight, less delay; more load and hops, more delay."""
    value = (F.lit(-5.5) + F.col("routing_hops") * 0.12 + F.col("offered_bandwidth") / 1e4 * 0.5
             + F.col("tos") * 0.4 - F.col("tos_queue_weight") / 100 * 1.5)
    return candidates.withColumn("y_pred", value)


CANDIDATES = f"""fl AS ({DELAY_SQL}), {PROFILES_SQL},
cd AS (SELECT fl.*, pf.profile_no, pf.profile, gw, sw, bw, CASE qos_class WHEN 'Gold' THEN gw WHEN 'Silver' THEN sw ELSE bw END AS w
 FROM fl, pf),
sd AS (SELECT *, exp(-5.5e0 + routing_hops * 0.12e0 + offered_bandwidth / 1e4 * 0.5e0 + tos * 0.4e0 - w / 100 * 1.5e0) * 1000 AS ms FROM cd)"""


@query("apply_profiles", f"""WITH {CANDIDATES} SELECT profile, qos_class, 'WFQ' AS scheduling_policy, w AS tos_queue_weight,
 w AS min_tos_weight, count(*) AS n FROM cd GROUP BY ALL""")
def apply_profiles(spark, sf):
    candidates = allocation.apply_profiles(
        allocation.traffic_pattern(delay_flows(spark, sf, COLUMNS)), rules.parse_profiles(rules.PROFILES))
    return candidates.groupBy("profile", "qos_class", "scheduling_policy", "tos_queue_weight", "min_tos_weight").agg(
        F.count("*").alias("n"))


SUMMARY = """cs AS (SELECT profile_no, profile, qos_class, count(*) AS n, avg(ms) AS mean_ms, quantile_cont(ms, 0.9) AS p90, max(ms) AS top,
 count(*) FILTER (WHERE ms > CASE qos_class WHEN 'Gold' THEN 20e0 WHEN 'Silver' THEN 50e0 ELSE 100e0 END) / count(*) AS bad
 FROM sd GROUP BY 1, 2, 3)"""


@query("class_delay_summary", f"""WITH {CANDIDATES}, {SUMMARY} SELECT profile_no, qos_class, n AS rows, round(mean_ms, 6) AS mean_delay_ms,
 round(top, 6) AS max_delay_ms, round(bad, 6) AS violation_rate, round(p90, 6) AS p90_delay_ms FROM cs""")
def class_delay_summary(spark, sf):
    candidates = allocation.apply_profiles(
        allocation.traffic_pattern(delay_flows(spark, sf, COLUMNS)), rules.parse_profiles(rules.PROFILES))
    scored = formula(candidates).select("profile_no", "qos_class", delay_ms(F.col("y_pred")).alias("pred_ms"))
    return rounded(allocation.class_delay_summary(scored, rules.ALLOCATION_SLA_MS))


def _wide(values: str) -> str:
    names = [("mean_delay_ms", "mean_ms"), ("p90_delay_ms", "p90"), ("max_delay_ms", "top"), ("violation_rate", "bad")]
    out = []
    for c in rules.CLASSES:
        for name, source in names:
            out.append(f"round(max({source}) FILTER (WHERE qos_class = '{c}'), 6) AS {c.lower()}_{name}")
        out.append(f"coalesce(max(n) FILTER (WHERE qos_class = '{c}'), 0) AS {c.lower()}_rows")
        out.append(f"{rules.ALLOCATION_SLA_MS[c]}e0 AS {c.lower()}_sla_ms")
    return ", ".join(out)


def _scores() -> str:
    mean = lambda c: f"max(mean_ms) FILTER (WHERE qos_class = '{c}')"
    sla, weight = rules.ALLOCATION_SLA_MS, rules.CLASS_PENALTY
    feasible = " AND ".join(f"coalesce({mean(c)} <= {sla[c]}e0, false)" for c in rules.CLASSES)
    violation = " + ".join(f"coalesce({weight[c]}e0 * greatest(0e0, {mean(c)} / {sla[c]}e0 - 1), 0)" for c in rules.CLASSES)
    delay = " + ".join(f"coalesce({weight[c]}e0 * {mean(c)} / {sla[c]}e0, 0)" for c in rules.CLASSES)
    return (f"{feasible} AS sla_feasible, {violation} AS violation, {delay} AS delay")


RANKED = f"""{CANDIDATES}, {SUMMARY}, wd AS (SELECT profile_no, profile, {_wide('')}, {_scores()}, cast(sum(n) AS bigint) AS traffic_rows
 FROM cs GROUP BY 1, 2)
SELECT wd.* EXCLUDE (profile_no, violation, delay), gw AS gold_weight, sw AS silver_weight, bw AS bronze_weight,
 round(violation, 6) AS weighted_violation_score, round(delay, 6) AS weighted_delay_score,
 cast(row_number() OVER (ORDER BY sla_feasible DESC, violation, delay, profile_no) AS int) AS rank,
 row_number() OVER (ORDER BY sla_feasible DESC, violation, delay, profile_no) = 1 AS recommended
FROM wd JOIN pf USING (profile_no, profile)"""


@query("rank_profiles", f"WITH {RANKED}")
def rank_profiles(spark, sf):
    return rounded(allocation.evaluate_profiles(delay_flows(spark, sf, COLUMNS), formula))


@query("rank_profiles_few_classes", f"""WITH {CANDIDATES.replace(f'({DELAY_SQL})', f"(SELECT * FROM ({DELAY_SQL}) WHERE qos_class <> 'Silver')")},
{RANKED[len(CANDIDATES) + 2:]}""")
def rank_profiles_few_classes(spark, sf):
    pattern = delay_flows(spark, sf, COLUMNS).filter(F.col("qos_class") != "Silver")
    return rounded(allocation.evaluate_profiles(pattern, formula))


@query("traffic_pattern", """
SELECT cast(l_suppkey % 5 AS bigint) AS tos, CASE l_suppkey % 5 WHEN 0 THEN 'Gold' WHEN 1 THEN 'Silver' WHEN 2 THEN 'Bronze'
 ELSE 'own' END AS qos_class, count(*) AS n FROM lineitem GROUP BY 1, 2""")
def traffic_pattern(spark, sf):
    given = table(spark, sf, "lineitem").select(
        (F.col("l_suppkey") % 5).cast("string").alias("tos"), F.lit("own").alias("qos_class"))
    return allocation.traffic_pattern(given).groupBy("tos", "qos_class").agg(F.count("*").alias("n"))


UNIT_SQL = "cast(('0x' || substr(md5(concat_ws('|', '42', row_id)), 1, 8)) AS bigint) / 4294967296e0"


@query("recommend_allocation_line", f"""
WITH {PROFILES_SQL}, fl AS (SELECT *, ln(greatest(avg_delay, 1e-9)) AS y, {UNIT_SQL} < 0.2e0 AS is_test FROM ({DELAY_SQL})),
ft AS (SELECT regr_slope(y, offered_bandwidth) AS b, regr_intercept(y, offered_bandwidth) AS a FROM fl WHERE NOT is_test),
ho AS (SELECT sqrt(avg(power(y - (a + b * offered_bandwidth), 2))) AS rmse,
 1 - sum(power(y - (a + b * offered_bandwidth), 2)) / (var_pop(y) * count(*)) AS r2 FROM fl, ft WHERE is_test),
sd AS (SELECT profile_no, profile, qos_class, exp(a + b * offered_bandwidth) * 1000 AS ms FROM fl, ft, pf), {SUMMARY},
wd AS (SELECT profile_no, profile, {_scores()} FROM cs GROUP BY 1, 2)
SELECT profile, sla_feasible, round(violation, 6) AS weighted_violation_score, round(delay, 6) AS weighted_delay_score,
 cast(row_number() OVER (ORDER BY sla_feasible DESC, round(violation, 9), round(delay, 9), profile_no) AS int) AS rank,
 round(rmse, 6) AS holdout_rmse_log_delay, round(r2, 6) AS holdout_r2_log_delay FROM wd, ho""")
def recommend_allocation_line(spark, sf):
    from linkgauge.functions.numeric import log_target

    flows = delay_flows(spark, sf).withColumn("log_avg_delay", log_target(F.col("avg_delay")))
    ranked = recommend_allocation(flows.drop("fold"), ["row_id"], models.line_model("offered_bandwidth"))
    return rounded(ranked.select(
        "profile", "sla_feasible", "weighted_violation_score", "weighted_delay_score", "rank",
        "holdout_rmse_log_delay", "holdout_r2_log_delay"))


@query("profile_texts", f"""
WITH t AS (SELECT CASE o_orderkey % 5 {' '.join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(rules.PROFILES))} END AS text FROM orders)
SELECT text, replace(text, ',', '/') AS profile, cast(string_split(text, ',')[1] AS double) AS gold,
 cast(string_split(text, ',')[2] AS double) AS silver, cast(string_split(text, ',')[3] AS double) AS bronze, count(*) AS n
FROM t GROUP BY ALL""")
def profile_texts(spark, sf):
    text = F.get(F.array(*[F.lit(p) for p in rules.PROFILES]), (F.col("o_orderkey") % 5).cast("int"))
    known = {p: rules.parse_profile(p) for p in rules.PROFILES}
    tagged = table(spark, sf, "orders").select(text.alias("text"))
    return tagged.groupBy(
        "text", rules.lookup(F.col("text"), {p: rules.profile_name(v) for p, v in known.items()}).alias("profile"),
        *[rules.lookup(F.col("text"), {p: v[c] for p, v in known.items()}).alias(c.lower()) for c in rules.CLASSES],
    ).agg(F.count("*").alias("n"))
