"""Queries for scanning, profiling, cleaning and feature building."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.adapters import (
    DELAY_SQL, FLOW_SQL, PACKET_SQL, RAW_SQL, THROUGHPUT_SQL, delay_flows, flow_records, packets, raw_table, table,
    throughput_wide,
)
from catalog.registry import query, r, rounded
from linkgauge.functions import numeric, rules
from linkgauge.functions.numeric import MISSING_TOKENS
from linkgauge.operators import flows, links, profiling, splitting
from linkgauge.operators.ordering import hash_key
from linkgauge.sources import files

TOKENS = ", ".join("'" + t + "'" for t in MISSING_TOKENS)
PACKET_KEYS = ["testbed", *links.CONFIG_KEYS]
PK = ", ".join(PACKET_KEYS)


@query("scan_parquet", "SELECT l_returnflag, count(*) AS n, " + "round(sum(l_quantity), 6) AS quantity FROM lineitem GROUP BY 1")
def scan_parquet(spark, sf):
    scan = files.scan_parquet(spark, f"{sf}/lineitem.parquet")
    return rounded(scan.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity")))


@query("normalise_nulls", f"""
WITH raw AS ({RAW_SQL})
SELECT row_id, num, CASE WHEN abs(rate) = cast('Infinity' as double) THEN NULL ELSE rate END AS rate, zero,
  zero_text, CASE WHEN Label IN ({TOKENS}) THEN NULL ELSE Label END AS label,
  CASE WHEN number_text IN ({TOKENS}) THEN NULL ELSE number_text END AS number_text FROM raw""")
def normalise_nulls(spark, sf):
    clean = files.normalise_nulls(raw_table(spark, sf))
    return clean.select("row_id", "num", "rate", "zero", "zero_text", F.col("Label").alias("label"), "number_text")


@query("strip_and_prune_columns", f"""
WITH raw AS ({FLOW_SQL}) SELECT destination_port AS "port", label FROM raw""")
def strip_and_prune(spark, sf):
    messy = flow_records(spark, sf).withColumnsRenamed({"destination_port": " port ", "label": " label"})
    return files.prune_columns(files.strip_columns(messy), ["port", "label"])


@query("tag_provenance", "SELECT o_orderstatus, 'ntnu' AS testbed, 'orders.parquet' AS source_file, count(*) AS n "
                         "FROM orders GROUP BY 1, 2, 3")
def tag_provenance(spark, sf):
    tagged = files.tag_provenance(table(spark, sf, "orders"), "ntnu")
    return tagged.groupBy("o_orderstatus", "testbed", "source_file").agg(F.count("*").alias("n"))


@query("preview_summary", """
SELECT (SELECT count(*) FROM events) AS rows, cast(p AS int) AS position, c AS "column", t AS dtype
FROM (VALUES (0, 'event_id', 'bigint'), (1, 'ts', 'timestamp_ntz'), (2, 'user_id', 'bigint'),
  (3, 'event_type', 'string'), (4, 'value', 'double'), (5, 'props', 'string')) v(p, c, t)""")
def preview_summary(spark, sf):
    return profiling.preview_summary(table(spark, sf, "events"))


@query("preview_rows", "SELECT * FROM (SELECT event_id, user_id, event_type FROM events ORDER BY event_id LIMIT 5)")
def preview_rows(spark, sf):
    ordered = table(spark, sf, "events").select("event_id", "user_id", "event_type").orderBy("event_id")
    return profiling.preview(ordered, 5)


def _profile_sql(source: str, columns: dict[str, tuple[str, bool]]) -> str:
    parts = []
    for position, (name, (dtype, numeric_like)) in enumerate(columns.items()):
        v = f"try_cast({name} AS double)" if numeric_like else "cast(NULL AS double)"
        fin = f"CASE WHEN NOT isinf({v}) AND NOT isnan({v}) THEN {v} END"
        parts.append(
            f"SELECT cast({position} AS int) AS position, '{name}' AS \"column\", '{dtype}' AS dtype, count(*) AS total_rows, "
            f"count({name}) AS non_null_count, count(*) - count({name}) AS missing_count, "
            f"count(*) FILTER (WHERE isinf({v})) AS infinite_count, count({fin}) AS numeric_count, "
            f"round(min({fin}), 6) AS min, round(max({fin}), 6) AS max, round(avg({fin}), 6) AS mean FROM {source}"
        )
    return " UNION ALL ".join(parts)


@query("profile_columns", f"""
WITH raw AS ({RAW_SQL}) """ + _profile_sql("raw", {
    "row_id": ("string", True), "num": ("double", True), "rate": ("double", True), "zero": ("int", True),
    "zero_text": ("string", True), "number_text": ("double", True), "const_five": ("int", True),
    "Label": ("string", True)}))
def profile_columns(spark, sf):
    return rounded(profiling.profile_columns(raw_table(spark, sf)))


@query("profile_lineitem", _profile_sql("lineitem", {
    "l_orderkey": ("bigint", True), "l_partkey": ("bigint", True), "l_suppkey": ("bigint", True),
    "l_linenumber": ("int", True), "l_quantity": ("double", True), "l_extendedprice": ("double", True),
    "l_discount": ("double", True), "l_tax": ("double", True), "l_returnflag": ("string", True),
    "l_linestatus": ("string", True), "l_shipdate": ("timestamp_ntz", False)}))
def profile_lineitem(spark, sf):
    return rounded(profiling.profile_columns(table(spark, sf, "lineitem")))


CLEAN_LABEL = "nullif(replace(trim(Label), '�', '-'), '')"


@query("label_counts", f"""
WITH raw AS ({RAW_SQL}) SELECT {CLEAN_LABEL} AS label, count(*) AS count FROM raw
WHERE {CLEAN_LABEL} IS NOT NULL GROUP BY 1""")
def label_counts(spark, sf):
    return profiling.label_counts(raw_table(spark, sf), "Label")


@query("top_labels", "SELECT c AS label, n AS count FROM (SELECT concat(p_brand, ' ', p_type) AS c, count(*) AS n "
                     "FROM part GROUP BY 1) ORDER BY n DESC, c LIMIT 10")
def top_labels(spark, sf):
    tagged = table(spark, sf, "part").select(F.concat_ws(" ", "p_brand", "p_type").alias("tag"))
    return profiling.top_labels(tagged, "tag", 10)


@query("label_keep_missing", f"""
WITH raw AS ({FLOW_SQL}) SELECT replace(trim(coalesce(label, 'nan')), '�', '-') AS label, count(*) AS count
FROM raw GROUP BY 1""")
def label_keep(spark, sf):
    kept = flow_records(spark, sf).select(rules.clean_label_keep(F.col("label")).alias("label"))
    return kept.groupBy("label").agg(F.count("*").alias("count"))


@query("label_imbalance", f"""
WITH raw AS ({RAW_SQL}), c AS (SELECT {CLEAN_LABEL} AS label, count(*) AS n FROM raw
  WHERE {CLEAN_LABEL} IS NOT NULL GROUP BY 1), t AS (SELECT cast(sum(n) AS bigint) AS total FROM c),
a AS (SELECT label, n FROM c ORDER BY n DESC, label LIMIT 1), b AS (SELECT label, n FROM c ORDER BY n, label DESC LIMIT 1)
SELECT a.n / total >= 0.6e0 AS is_imbalanced, a.label AS majority_label, a.n AS majority_count,
  round(a.n / total, 6) AS majority_percent, b.label AS minority_label, b.n AS minority_count,
  round(b.n / total, 6) AS minority_percent, 0.6e0 AS imbalance_threshold FROM a, b, t""")
def label_imbalance(spark, sf):
    return rounded(profiling.imbalance(profiling.label_counts(raw_table(spark, sf), "Label")))


@query("value_counts", "SELECT event_type AS value, count(*) AS count FROM events GROUP BY 1")
def value_counts(spark, sf):
    return profiling.value_counts(table(spark, sf, "events"), "event_type")


@query("drop_constant_zero", f"""
WITH raw AS ({RAW_SQL}) SELECT row_id, num, CASE WHEN isinf(rate) THEN NULL ELSE rate END AS rate, number_text,
  const_five, Label FROM raw""")
def drop_constant_zero(spark, sf):
    dropped = profiling.drop_constant_zero(raw_table(spark, sf), "Label")
    return dropped.withColumn("rate", numeric.finite(F.col("rate")))


def _missing_sql(condition: str) -> str:
    return (f"WITH raw AS ({RAW_SQL}), c AS (SELECT row_id, num, CASE WHEN isinf(rate) THEN NULL ELSE rate END AS rate, "
            f"cast(number_text AS double) AS number_text, const_five, CASE WHEN Label IN ({TOKENS}) THEN NULL ELSE Label END AS Label FROM raw) "
            f"SELECT * FROM c WHERE {condition}")


@query("clean_policy_all", _missing_sql("num IS NOT NULL AND rate IS NOT NULL AND number_text IS NOT NULL AND Label IS NOT NULL"))
def clean_all(spark, sf):
    return profiling.clean_dataset(raw_table(spark, sf), "all")[0]


@query("clean_policy_label", _missing_sql("Label IS NOT NULL"))
def clean_label_policy(spark, sf):
    return profiling.clean_dataset(raw_table(spark, sf), "label")[0]


@query("clean_policy_required", _missing_sql("num IS NOT NULL"))
def clean_required(spark, sf):
    return profiling.clean_dataset(raw_table(spark, sf), "required", ["num", "absent"])[0]


@query("clean_policy_none", _missing_sql("true"))
def clean_none(spark, sf):
    return profiling.clean_dataset(raw_table(spark, sf), "none")[0]


@query("cleaning_summary", f"""
WITH raw AS ({RAW_SQL}), c AS (SELECT * FROM ({_missing_sql("num IS NOT NULL AND rate IS NOT NULL AND number_text IS NOT NULL AND Label IS NOT NULL")})),
rl AS (SELECT {CLEAN_LABEL} AS label, count(*) AS n FROM raw WHERE {CLEAN_LABEL} IS NOT NULL GROUP BY 1),
cl AS (SELECT {CLEAN_LABEL} AS label, count(*) AS n FROM c WHERE {CLEAN_LABEL} IS NOT NULL GROUP BY 1),
a AS (SELECT label, n FROM cl ORDER BY n DESC, label LIMIT 1), b AS (SELECT label, n FROM cl ORDER BY n, label DESC LIMIT 1),
t AS (SELECT cast(sum(n) AS bigint) AS total FROM cl)
SELECT 'flows' AS dataset, (SELECT count(*) FROM raw) AS raw_rows, (SELECT count(*) FROM c) AS cleaned_rows,
 (SELECT count(*) FROM raw) - (SELECT count(*) FROM c) AS rows_dropped, 'all' AS missing_policy,
 '' AS missing_required_columns, cast(8 AS int) AS raw_feature_count, cast(6 AS int) AS cleaned_feature_count,
 'zero, zero_text' AS removed_features, cast(2 AS int) AS constant_zero_features_removed, 'Label' AS label_column,
 (SELECT count(*) FROM rl) AS raw_label_class_count, (SELECT count(*) FROM cl) AS cleaned_label_class_count,
 a.n / total >= 0.6e0 AS is_imbalanced, a.label AS majority_label, a.n AS majority_count,
 round(a.n / total, 6) AS majority_percent, b.label AS minority_label, b.n AS minority_count,
 round(b.n / total, 6) AS minority_percent, 0.6e0 AS imbalance_threshold FROM a, b, t""")
def cleaning_summary(spark, sf):
    raw = raw_table(spark, sf)
    cleaned, facts = profiling.clean_dataset(raw, "all")
    return rounded(profiling.cleaning_summary("flows", raw, cleaned, facts, "all"))


@query("dataset_summary", f"""
WITH raw AS ({RAW_SQL}), p AS ({_profile_sql("raw", {
    "row_id": ("string", True), "num": ("double", True), "rate": ("double", True), "zero": ("int", True),
    "zero_text": ("string", True), "number_text": ("double", True), "const_five": ("int", True),
    "Label": ("string", True)})}),
l AS (SELECT {CLEAN_LABEL} AS label, count(*) AS n FROM raw WHERE {CLEAN_LABEL} IS NOT NULL GROUP BY 1),
t AS (SELECT count(*) AS n FROM raw)
SELECT 'dataset' AS section, name, cnt AS count, t.n AS total_rows, cast(NULL AS bigint) AS non_null_count,
  cast(NULL AS bigint) AS missing_count, cast(NULL AS bigint) AS infinite_count, cast(NULL AS varchar) AS dtype,
  cast(NULL AS double) AS min, cast(NULL AS double) AS max, cast(NULL AS double) AS mean, 'Label' AS label_column
FROM t, (SELECT 'total_rows' AS name, (SELECT n FROM t) AS cnt UNION ALL SELECT 'files', 3 UNION ALL
  SELECT 'failed_files', 1 UNION ALL SELECT 'feature_count', 8 UNION ALL
  SELECT 'label_class_count', (SELECT count(*) FROM l))
UNION ALL SELECT 'feature', "column", non_null_count, total_rows, non_null_count, missing_count, infinite_count, dtype,
  min, max, mean, 'Label' FROM p
UNION ALL SELECT 'label', label, l.n, t.n, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'Label' FROM l, t""")
def dataset_summary(spark, sf):
    return rounded(profiling.dataset_summary(raw_table(spark, sf), 3, 1, "Label"))


@query("align_columns", """
SELECT cast(c_custkey AS bigint) AS key, c_name AS name, c_acctbal AS balance, cast(NULL AS int) AS size FROM customer
UNION ALL SELECT p_partkey, p_name, NULL, p_size FROM part""")
def align_columns(spark, sf):
    left = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    right = table(spark, sf, "part").select(
        F.col("p_size").alias("size"), F.col("p_partkey").alias("key"), F.col("p_name").alias("name"))
    return files.align_columns([left, right])


@query("split_target", f"""
WITH raw AS ({RAW_SQL}) SELECT row_id, num, cast(number_text AS double) AS number_text FROM raw
WHERE number_text IS NOT NULL""")
def split_target(spark, sf):
    wanted = profiling.split_target(raw_table(spark, sf), "number_text", ["zero", "zero_text", "rate", "not_there"])
    return wanted.select("row_id", "num", "number_text")


PORT_NUMBER = "coalesce(cast(destination_port AS int), -1)"
PROTOCOL_SQL = (f"CASE WHEN {PORT_NUMBER} IN (" + ", ".join(map(str, rules.UDP_PORTS)) + ") THEN 'UDP' ELSE 'TCP' END")
APPLICATION_SQL = "CASE " + " ".join(
    f"WHEN {PORT_NUMBER} IN ({', '.join(map(str, ports))}) THEN '{name}'" for name, ports in rules.APPLICATION_PORTS.items()
) + " ELSE 'other' END"


@query("port_rules", f"""
WITH raw AS ({FLOW_SQL}) SELECT destination_port, {PROTOCOL_SQL} AS protocol, {APPLICATION_SQL} AS application_type,
 count(*) AS n FROM raw GROUP BY 1, 2, 3""")
def port_rules(spark, sf):
    port = F.col("destination_port")
    tagged = flow_records(spark, sf).select(
        port, rules.infer_protocol(port).alias("protocol"), rules.infer_application(port).alias("application_type"))
    return tagged.groupBy("destination_port", "protocol", "application_type").agg(F.count("*").alias("n"))


POLICY_ROWS = ", ".join(
    f"('{c}', {{'Gold': 1, 'Silver': 2, 'Bronze': 3}}['{c}'], '{p}', {low}, {high})".replace(
        "{'Gold': 1, 'Silver': 2, 'Bronze': 3}['%s']" % c, str({"Gold": 1, "Silver": 2, "Bronze": 3}[c]))
    for c, protocols, ranges in rules.PORT_POLICY for p in protocols for low, high in ranges
)


@query("classify_qos", f"""
WITH raw AS ({FLOW_SQL}), p AS (SELECT row_id, destination_port, {PROTOCOL_SQL} AS protocol FROM raw),
rules(qos, ord, proto, lo, hi) AS (VALUES {POLICY_ROWS})
SELECT destination_port, protocol, qos_class, count(*) AS n FROM (
  SELECT p.row_id, p.destination_port, p.protocol, coalesce(arg_min(r.qos, r.ord), 'Bronze') AS qos_class FROM p
  LEFT JOIN rules r ON p.protocol = r.proto AND coalesce(p.destination_port, -1) BETWEEN r.lo AND r.hi GROUP BY 1, 2, 3)
GROUP BY 1, 2, 3""")
def classify_qos(spark, sf):
    port = F.col("destination_port")
    tagged = flow_records(spark, sf).select(port, rules.infer_protocol(port).alias("protocol"))
    return tagged.withColumn("qos_class", rules.classify_qos(None, F.col("protocol"), port)).groupBy(
        "destination_port", "protocol", "qos_class").agg(F.count("*").alias("n"))


ALL_APPLICATIONS = f"""
WITH raw AS ({FLOW_SQL}), p AS (SELECT row_id, destination_port, {PROTOCOL_SQL} AS protocol, {APPLICATION_SQL} AS application FROM raw),
rules(qos, ord, proto, lo, hi) AS (VALUES {POLICY_ROWS}),
q AS (SELECT p.row_id, p.application, coalesce(arg_min(r.qos, r.ord), 'Bronze') AS by_port FROM p
  LEFT JOIN rules r ON p.protocol = r.proto AND coalesce(p.destination_port, -1) BETWEEN r.lo AND r.hi GROUP BY 1, 2)
SELECT application, CASE WHEN application IN ('voice', 'video', 'dns') THEN 'Gold'
 WHEN application IN ('web', 'ssh', 'database', 'mail') THEN 'Silver' WHEN application = 'other' THEN by_port ELSE 'Bronze' END AS qos_class,
 count(*) AS n FROM q GROUP BY 1, 2"""


@query("classify_qos_by_application", ALL_APPLICATIONS)
@query("classify_qos_all_applications", ALL_APPLICATIONS)
def classify_all_applications(spark, sf):
    """Every row; applications without a class of their own take that of protocol and port."""
    port = F.col("destination_port")
    tagged = flow_records(spark, sf).select(rules.infer_application(port).alias("application"), rules.infer_protocol(port).alias("protocol"), port)
    qos = rules.classify_qos(F.col("application"), F.col("protocol"), port)
    return tagged.select("application", qos.alias("qos_class")).groupBy("application", "qos_class").agg(F.count("*").alias("n"))


FLOW_FEATURE_SQL = f"""
WITH raw AS ({FLOW_SQL}), b AS (SELECT *, CASE WHEN isinf(bytes_per_sec) THEN NULL ELSE bytes_per_sec END * 8 / 1e6 AS mbps,
  replace(trim(coalesce(label, 'nan')), '�', '-') AS attack_label FROM raw),
f AS (SELECT iat_mean / 1e3 AS latency_ms, iat_std / 1e3 AS jitter_ms,
  CASE WHEN rst_count > 0 THEN 1e0 ELSE 0e0 END AS packet_loss_percent,
  CASE WHEN mbps IS NULL THEN NULL ELSE least(100e0, greatest(0e0, mbps / 1e3 * 100)) END AS bandwidth_utilization_percent,
  mbps AS actual_throughput_mbps, flow_duration / 1e6 AS flow_duration_sec, fwd_packets + bwd_packets AS packet_count,
  {PROTOCOL_SQL} AS protocol, {APPLICATION_SQL} AS application_type, 'unknown' AS link_type,
  cast(-1 AS int) AS time_of_day, attack_label,
  cast(CASE WHEN upper(attack_label) <> 'BENIGN' THEN 1 ELSE 0 END AS int) AS is_attack, source_file,
  cast(destination_port AS bigint) AS destination_port, fwd_bytes + bwd_bytes AS byte_count FROM b),
g AS (SELECT *, cast(greatest(0, least(100, 30
  + CASE application_type WHEN 'voice' THEN 30 WHEN 'video' THEN 25 WHEN 'database' THEN 15 WHEN 'web' THEN 10
    WHEN 'file_transfer' THEN 5 ELSE 8 END
  + CASE WHEN latency_ms > 100 THEN 10 ELSE 0 END + CASE WHEN jitter_ms > 30 THEN 10 ELSE 0 END
  + CASE WHEN packet_loss_percent > 2 THEN 10 ELSE 0 END
  + CASE WHEN bandwidth_utilization_percent > 80 THEN 5 ELSE 0 END - 10 * is_attack)) AS int)
  AS recommended_bandwidth_percent FROM f)
SELECT {r('latency_ms', 'jitter_ms', 'packet_loss_percent', 'bandwidth_utilization_percent', 'actual_throughput_mbps',
          'flow_duration_sec')}, packet_count, protocol, application_type, link_type, time_of_day,
  recommended_bandwidth_percent, attack_label, is_attack, source_file, destination_port, {r('byte_count')}
FROM g WHERE latency_ms IS NOT NULL AND actual_throughput_mbps IS NOT NULL AND destination_port IS NOT NULL"""


def raw_flow_columns(spark, sf):
    names = dict(zip(
        ["destination_port", "flow_duration", "fwd_packets", "bwd_packets", "fwd_bytes", "bwd_bytes", "bytes_per_sec",
         "iat_mean", "iat_std", "rst_count", "label"], flows.RAW_COLUMNS))
    return flow_records(spark, sf).withColumnsRenamed(names)


@query("flow_features", FLOW_FEATURE_SQL)
def flow_features(spark, sf):
    return rounded(flows.flow_features(raw_flow_columns(spark, sf)))


@query("flow_quota_sample", f"""
WITH raw AS ({FLOW_SQL}), k AS (SELECT row_id, source_file, md5(concat_ws('|', '42', row_id)) AS h FROM raw),
q AS (SELECT greatest(1, cast(floor(1000 / count(DISTINCT source_file)) AS bigint)) AS quota FROM raw)
SELECT row_id, source_file FROM (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY h) AS rn FROM k), q
WHERE rn <= quota""")
def flow_quota_sample(spark, sf):
    records = flow_records(spark, sf).select("row_id", "source_file")
    return splitting.quota_sample(records, "source_file", ["row_id"], 1000)


@query("sample_rows", """
SELECT o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', '42',
 cast(o_orderkey AS varchar)))) AS rn FROM orders) WHERE rn <= 500""")
def sample_rows(spark, sf):
    return splitting.sample_rows(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), ["o_orderkey"], 500)


UNIT = "cast(('0x' || substr(md5(concat_ws('|', '{seed}', cast(o_orderkey AS varchar))), 1, 8)) AS bigint) / 4294967296e0"


@query("train_test_split", f"""
SELECT o_orderkey, {UNIT.format(seed=42)} < 0.2e0 AS is_test FROM orders""")
def train_test_split(spark, sf):
    return splitting.train_test_split(table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"])


@query("train_test_split_exact", """
SELECT o_orderkey, row_number() OVER (ORDER BY md5(concat_ws('|', '42', cast(o_orderkey AS varchar))))
 <= ceil((SELECT count(*) FROM orders) * 0.2e0) AS is_test FROM orders""")
def train_test_split_exact(spark, sf):
    return splitting.train_test_split(table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], exact=True)


@query("validation_split", f"""
SELECT o_orderkey, CASE WHEN {UNIT.format(seed=42)} < 0.2e0 THEN 'test' WHEN {UNIT.format(seed=43)} < 0.1e0
 THEN 'validation' ELSE 'train' END AS part FROM orders""")
def validation_split(spark, sf):
    return splitting.validation_split(table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"])


@query("kfold", f"SELECT o_orderkey, cast(floor({UNIT.format(seed=42)} * 5) AS int) AS fold FROM orders")
def kfold(spark, sf):
    return splitting.kfold(table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], 5)


@query("kfold_exact", """
SELECT o_orderkey, cast((row_number() OVER (ORDER BY md5(concat_ws('|', '42', cast(o_orderkey AS varchar)))) - 1) % 5
 AS int) AS fold FROM orders""")
def kfold_exact(spark, sf):
    return splitting.kfold(table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], 5, exact=True)


@query("stratified_kfold", """
SELECT o_orderkey, o_orderpriority AS label, cast((row_number() OVER (PARTITION BY o_orderpriority
 ORDER BY md5(concat_ws('|', '42', cast(o_orderkey AS varchar)))) - 1) % 5 AS int) AS fold FROM orders""")
def stratified_kfold(spark, sf):
    labelled = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("label"))
    return splitting.stratified_kfold(labelled, "label", ["o_orderkey"], 5)


@query("unpivot_directions", f"""
WITH w AS ({THROUGHPUT_SQL}), s AS (
 SELECT order_id, 'uplink' AS direction, bw AS bw_mhz, mbpsactual_uplink AS mbpsactual, meanjitterms_uplink AS meanjitterms,
  meanloss_uplink AS meanloss, mbpsoffered_uplink AS mbpsoffered FROM w UNION ALL
 SELECT order_id, 'downlink', bw, mbpsactual_downlink, meanjitterms_downlink, meanloss_downlink, mbpsoffered_downlink FROM w)
SELECT direction, bw_mhz, count(*) AS n, {r('sum(mbpsactual)')[:-len(' AS sum(mbpsactual)')]} AS actual,
 round(sum(meanjitterms), 6) AS jitter, round(sum(meanloss), 6) AS loss, round(sum(mbpsoffered), 6) AS offered
FROM s GROUP BY 1, 2""")
def unpivot_directions(spark, sf):
    long = links.unpivot_directions(throughput_wide(spark, sf))
    return rounded(long.groupBy("direction", "bw_mhz").agg(
        F.count("*").alias("n"), F.sum("mbpsactual").alias("actual"), F.sum("meanjitterms").alias("jitter"),
        F.sum("meanloss").alias("loss"), F.sum("mbpsoffered").alias("offered")))


GAPS_SQL = f"""p AS ({PACKET_SQL}), g AS (SELECT *, coalesce(epoch - lag(epoch) OVER (PARTITION BY {PK} ORDER BY epoch), 0e0)
 AS iat FROM p)"""


@query("inter_arrival", f"WITH {GAPS_SQL} SELECT event_id, round(iat, 5) AS iat FROM g")
def inter_arrival(spark, sf):
    gaps = links.inter_arrival(packets(spark, sf), PACKET_KEYS)
    return rounded(gaps.select("event_id", "iat"), 5)


@query("iat_filter", f"WITH {GAPS_SQL} SELECT event_id FROM g WHERE iat > 0")
def iat_filter(spark, sf):
    return links.iat_filter(links.inter_arrival(packets(spark, sf), PACKET_KEYS)).select("event_id")


CONFIG_SQL = f"""{GAPS_SQL}, d AS (SELECT {PK}, sum(iat) / count(*) * 1e3 AS latency_ms, count(*) AS packet_count,
 sum(iat) AS flow_duration_sec, sqrt(var_pop(iat)) AS iat_std_sec,
 cast(cast(floor(min(epoch) / 3600) AS bigint) % 24 AS int) AS time_of_day FROM g WHERE iat > 0 GROUP BY {PK})"""


@query("delay_by_config", f"""WITH {CONFIG_SQL} SELECT {PK}, {r('latency_ms', digits=4)}, packet_count,
 {r('flow_duration_sec', 'iat_std_sec', digits=4)}, time_of_day FROM d""")
def delay_by_config(spark, sf):
    gaps = links.inter_arrival(packets(spark, sf), PACKET_KEYS)
    return rounded(links.delay_by_config(gaps, PACKET_KEYS), 4)


@query("first_packet", f"""WITH p AS ({PACKET_SQL}) SELECT {PK}, min(event_id) AS events_from, round(min(epoch), 4) AS first_epoch
 FROM p GROUP BY {PK}""")
def first_packet(spark, sf):
    return rounded(packets(spark, sf).groupBy(*PACKET_KEYS).agg(
        F.min("event_id").alias("events_from"), F.min("epoch").alias("first_epoch")), 4)


@query("link_features", f"""
WITH {CONFIG_SQL}, w AS ({THROUGHPUT_SQL}), s AS (
 SELECT w.*, 'uplink' AS direction, mbpsactual_uplink AS a, meanjitterms_uplink AS j, meanloss_uplink AS l,
  mbpsoffered_uplink AS o FROM w UNION ALL
 SELECT w.*, 'downlink', mbpsactual_downlink, meanjitterms_downlink, meanloss_downlink, mbpsoffered_downlink FROM w)
SELECT round(coalesce(latency_ms, -1e0), 4) AS latency_ms, round(j, 9) AS jitter_ms,
 round(least(100e0, greatest(0e0, l * 100)), 9) AS packet_loss_percent,
 round(least(100e0, greatest(0e0, o / 150e0 * 100)), 9) AS bandwidth_utilization_percent,
 round(a, 9) AS actual_throughput_mbps, round(coalesce(flow_duration_sec, -1e0), 4) AS flow_duration_sec,
 coalesce(packet_count, -1) AS packet_count, 'UDP' AS protocol, 'throughput_test' AS application_type,
 '5G' AS link_type, coalesce(time_of_day, -1) AS time_of_day,
 round(CASE WHEN o = 0 AND a > 0 THEN 100e0 WHEN o = 0 THEN NULL ELSE least(100e0, greatest(0e0, a / o * 100)) END, 9)
  AS recommended_bandwidth_percent,
 s.testbed, s.gnb, s.sdr, s.bw AS bw_mhz, s.slots, s.ratio, s.rep, s.direction, round(o, 9) AS offered_throughput_mbps,
 s.source_file
FROM s LEFT JOIN d ON s.testbed = d.testbed AND s.gnb = d.gnb AND s.sdr = d.sdr AND s.bw = d.bw_mhz
 AND s.slots = d.slots AND s.ratio = d.ratio AND s.direction = d.direction""")
def link_features(spark, sf):
    gaps = links.inter_arrival(packets(spark, sf), PACKET_KEYS)
    delays = links.delay_by_config(gaps, PACKET_KEYS)
    features = links.link_features(links.unpivot_directions(throughput_wide(spark, sf)), delays)
    return rounded(features.withColumns({c: F.round(c, 4) for c in ("latency_ms", "flow_duration_sec")}), 9)


BOTH_DIRECTIONS = f"""
WITH w AS ({THROUGHPUT_SQL}), s AS (
 SELECT source_file, 'uplink' AS direction, mbpsactual_uplink AS a, meanjitterms_uplink AS j, meanloss_uplink AS l, mbpsoffered_uplink AS o FROM w UNION ALL
 SELECT source_file, 'downlink', mbpsactual_downlink, meanjitterms_downlink, meanloss_downlink, mbpsoffered_downlink FROM w)
SELECT source_file, direction, -1e0 AS latency_ms, round(j, 9) AS jitter_ms, round(least(100e0, greatest(0e0, l * 100)), 9) AS packet_loss_percent,
 round(least(100e0, greatest(0e0, o / 150e0 * 100)), 9) AS bandwidth_utilization_percent, round(a, 9) AS actual_throughput_mbps FROM s"""


@query("link_features_without_packets", BOTH_DIRECTIONS)
@query("link_features_without_packets_rows", BOTH_DIRECTIONS)
def link_features_rows(spark, sf):
    """Every row of both directions."""
    table_ = links.link_features(links.unpivot_directions(throughput_wide(spark, sf)), None)
    return rounded(table_.select("source_file", "direction", "latency_ms", "jitter_ms", "packet_loss_percent",
                                 "bandwidth_utilization_percent", "actual_throughput_mbps"), 9)


@query("clip_and_ratio", f"""
WITH w AS ({THROUGHPUT_SQL}) SELECT order_id,
 CASE WHEN meanjitterms_uplink IS NULL THEN NULL ELSE round(least(3e0, greatest(1e0, meanjitterms_uplink)), 6) END AS clipped,
 round(CASE WHEN mbpsoffered_uplink = 0 AND mbpsactual_uplink > 0 THEN 100e0 WHEN mbpsoffered_uplink = 0 THEN NULL
  ELSE least(100e0, greatest(0e0, mbpsactual_uplink / mbpsoffered_uplink * 100)) END, 6) AS delivered FROM w""")
def clip_and_ratio(spark, sf):
    wide = throughput_wide(spark, sf)
    return rounded(wide.select(
        "order_id", numeric.clip(F.col("meanjitterms_uplink"), 1, 3).alias("clipped"),
        numeric.percent_of(F.col("mbpsactual_uplink"), F.col("mbpsoffered_uplink")).alias("delivered")))


@query("log_and_back", """
SELECT l_returnflag, round(sum(ln(greatest(l_discount, 1e-9))), 4) AS log_sum,
 round(sum(exp(ln(greatest(l_tax, 1e-9))) * 1000), 6) AS back_ms, round(avg(CASE WHEN l_quantity + l_linenumber - 1 > 0
 THEN (l_linenumber - 1) / (l_quantity + l_linenumber - 1) ELSE 0e0 END), 6) AS loss FROM lineitem GROUP BY 1""")
def log_and_back(spark, sf):
    lines = table(spark, sf, "lineitem")
    return lines.groupBy("l_returnflag").agg(
        F.round(F.sum(numeric.log_target(F.col("l_discount"))), 4).alias("log_sum"),
        F.round(F.sum(numeric.delay_ms(numeric.log_target(F.col("l_tax")))), 6).alias("back_ms"),
        F.round(F.avg(numeric.loss_rate(F.col("l_quantity"), F.col("l_linenumber") - 1)), 6).alias("loss"))


@query("class_codes", """
SELECT cast(l_suppkey % 5 AS int) AS tos, CASE l_suppkey % 5 WHEN 0 THEN 'Gold' WHEN 1 THEN 'Silver' WHEN 2 THEN 'Bronze'
 ELSE concat('tos_', cast(l_suppkey % 5 AS varchar)) END AS qos_class,
 CASE l_suppkey % 5 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 1 END AS priority,
 CASE l_suppkey % 5 WHEN 0 THEN 3e0 WHEN 1 THEN 2e0 WHEN 2 THEN 1e0 END AS penalty, count(*) AS n
FROM lineitem GROUP BY 1, 2, 3, 4""")
def class_codes(spark, sf):
    tos = (F.col("l_suppkey") % 5).cast("int").alias("tos")
    tagged = table(spark, sf, "lineitem").select(tos).withColumn("qos_class", rules.tos_to_class(F.col("tos")))
    return tagged.withColumns({
        "priority": rules.qos_priority(F.col("qos_class")), "penalty": rules.sla_penalty(F.col("qos_class")),
    }).groupBy("tos", "qos_class", "priority", "penalty").agg(F.count("*").alias("n"))


@query("scenario_of", """
WITH n AS (SELECT concat(CASE WHEN o_orderkey % 7 = 0 THEN 'x' ELSE '' END, 'graph_', CASE WHEN o_orderkey % 3 = 0 THEN
 'A_wfq_fixed' ELSE 'mixed' END, '_', cast(o_orderkey % 9 AS varchar), '.txt') AS f FROM orders)
SELECT CASE WHEN regexp_extract(f, '^graph_([^_]+_[^_]+_[^_]+)_\\d+\\.txt', 1) = '' THEN 'unknown'
 ELSE regexp_extract(f, '^graph_([^_]+_[^_]+_[^_]+)_\\d+\\.txt', 1) END AS scenario, count(*) AS n FROM n GROUP BY 1""")
def scenario_of(spark, sf):
    name = F.expr("concat(CASE WHEN o_orderkey % 7 = 0 THEN 'x' ELSE '' END, 'graph_', CASE WHEN o_orderkey % 3 = 0 "
                  "THEN 'A_wfq_fixed' ELSE 'mixed' END, '_', cast(o_orderkey % 9 AS string), '.txt')")
    return table(spark, sf, "orders").select(rules.scenario_of(name).alias("scenario")).groupBy("scenario").agg(
        F.count("*").alias("n"))


@query("target_family", """
WITH t AS (SELECT CASE o_orderkey % 5 WHEN 0 THEN 'jitter' WHEN 1 THEN 'delay_p90' WHEN 2 THEN 'packet_loss_rate'
 WHEN 3 THEN 'actual_bandwidth' ELSE 'log_avg_delay' END AS target FROM orders)
SELECT target, CASE WHEN target = 'jitter' THEN 'jitter' WHEN starts_with(target, 'delay_') THEN 'tail_delay'
 WHEN target = 'packet_loss_rate' THEN 'loss' WHEN target = 'actual_bandwidth' THEN 'throughput' ELSE 'qos_metric' END
 AS family, count(*) AS n FROM t GROUP BY 1, 2""")
def target_family(spark, sf):
    name = F.expr("CASE o_orderkey % 5 WHEN 0 THEN 'jitter' WHEN 1 THEN 'delay_p90' WHEN 2 THEN 'packet_loss_rate' "
                  "WHEN 3 THEN 'actual_bandwidth' ELSE 'log_avg_delay' END")
    return table(spark, sf, "orders").select(name.alias("target")).withColumn(
        "family", rules.target_family(F.col("target"))).groupBy("target", "family").agg(F.count("*").alias("n"))


@query("synthetic_bandwidth", """
WITH f AS (SELECT CASE l_suppkey % 6 WHEN 0 THEN 'voice' WHEN 1 THEN 'video' WHEN 2 THEN 'web' WHEN 3 THEN 'file_transfer'
 WHEN 4 THEN 'database' ELSE 'other' END AS app, l_extendedprice / 5e2 AS latency, l_quantity * 2 AS jitter,
 l_discount * 40 AS loss, l_tax * 1200 AS util FROM lineitem)
SELECT app, cast(least(100, 30 + CASE app WHEN 'voice' THEN 30 WHEN 'video' THEN 25 WHEN 'database' THEN 15
 WHEN 'web' THEN 10 ELSE 5 END + CASE WHEN latency > 100 THEN 10 ELSE 0 END + CASE WHEN jitter > 30 THEN 10 ELSE 0 END
 + CASE WHEN loss > 2 THEN 10 ELSE 0 END + CASE WHEN util > 80 THEN 5 ELSE 0 END) AS int) AS points, count(*) AS n
FROM f GROUP BY 1, 2""")
def synthetic_bandwidth(spark, sf):
    f = table(spark, sf, "lineitem").select(
        F.expr("CASE l_suppkey % 6 WHEN 0 THEN 'voice' WHEN 1 THEN 'video' WHEN 2 THEN 'web' WHEN 3 THEN 'file_transfer' "
               "WHEN 4 THEN 'database' ELSE 'other' END").alias("app"),
        (F.col("l_extendedprice") / 500).alias("latency"), (F.col("l_quantity") * 2).alias("jitter"),
        (F.col("l_discount") * 40).alias("loss"), (F.col("l_tax") * 1200).alias("util"))
    points = rules.recommend_bandwidth_synthetic(
        F.col("app"), F.col("latency"), F.col("jitter"), F.col("loss"), F.col("util"))
    return f.withColumn("points", points).groupBy("app", "points").agg(F.count("*").alias("n"))


@query("describe_by_class", f"""
WITH f AS ({DELAY_SQL}) SELECT qos_class, count(avg_delay) AS count, round(avg(avg_delay), 6) AS mean,
 round(stddev_samp(avg_delay), 6) AS std, round(min(avg_delay), 6) AS min, round(quantile_cont(avg_delay, 0.25), 6) AS p25,
 round(quantile_cont(avg_delay, 0.5), 6) AS p50, round(quantile_cont(avg_delay, 0.75), 6) AS p75,
 round(max(avg_delay), 6) AS max FROM f GROUP BY 1""")
def describe_by_class(spark, sf):
    return profiling.describe_by(delay_flows(spark, sf, ["qos_class", "avg_delay"]), ["qos_class"], "avg_delay")


@query("hash_key_is_portable", "SELECT event_id, md5(concat_ws('|', '7', cast(event_id AS varchar))) AS key FROM events")
def hash_key_is_portable(spark, sf):
    return table(spark, sf, "events").select("event_id", hash_key(7, "event_id").alias("key"))
