"""The given tables seen as the tables of this library.

Each adapter is a list of expressions in SQL that both engines read alike; the Spark side selects
them, the SQL side puts them into a common table expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkgauge.sources.archives import MEMBERS, join_members

LINE_ID = (
    "md5(concat_ws('|', cast(l_orderkey as string), cast(l_linenumber as string), cast(l_partkey as string), "
    "cast(l_suppkey as string), cast(cast(round(l_extendedprice * 100) as bigint) as string), "
    "cast(cast(l_shipdate as date) as string)))"
)
TOS = "CASE WHEN o_orderpriority = '1-URGENT' THEN 0 WHEN o_orderpriority IN ('2-HIGH', '3-MEDIUM') THEN 1 ELSE 2 END"
POLICY = "CASE l_returnflag WHEN 'A' THEN 'WFQ' WHEN 'N' THEN 'SP' ELSE 'DRR' END"

DELAY_FLOWS = {
    "row_id": LINE_ID,
    "simulation_id": "cast(l_orderkey as string)",
    "scenario": "p_type",
    "tos": TOS,
    "qos_class": f"CASE {TOS} WHEN 0 THEN 'Gold' WHEN 1 THEN 'Silver' ELSE 'Bronze' END",
    "offered_bandwidth": "l_quantity * 200e0",
    "time_distribution": "cast(l_suppkey % 3 as int)",
    "routing_hops": "l_linenumber",
    "n_nodes": "p_size",
    "max_avg_lambda": "o_totalprice / 50e0",
    "link_bandwidth": "100000",
    "scheduling_policy": POLICY,
    "tos_queue_weight": f"CASE {TOS} WHEN 0 THEN 60e0 WHEN 1 THEN 30e0 ELSE 10e0 END",
    "min_tos_weight": f"CASE {TOS} WHEN 0 THEN 50e0 WHEN 1 THEN 25e0 ELSE 5e0 END",
    "avg_delay": f"(2e-3 + l_extendedprice / 5e6) * l_linenumber * (1 + {TOS})",
    "jitter": "l_quantity / 1e4",
    "packet_loss_rate": "CASE WHEN l_tax < 2e-2 THEN 0e0 ELSE l_tax END",
    "delay_p10": f"(1e-3 + l_extendedprice / 1e7) * l_linenumber * (1 + {TOS})",
    "delay_p50": f"(2e-3 + l_extendedprice / 6e6) * l_linenumber * (1 + {TOS})",
    "delay_p90": f"(4e-3 + l_extendedprice / 2e6) * l_linenumber * (1 + {TOS})",
    "actual_bandwidth": "l_quantity * 190e0",
    "fold": "cast((l_orderkey * 31 + l_linenumber * 7 + l_partkey) % 5 as int)",
}

RAW_TABLE = {
    "row_id": LINE_ID,
    "num": "nullif(l_quantity, 13e0)",
    "rate": "CASE WHEN l_discount > 9e-2 THEN cast('Infinity' as double) WHEN l_discount < 1e-2 THEN NULL "
            "ELSE l_discount END",
    "zero": "0",
    "zero_text": "CASE WHEN l_linenumber = 1 THEN '0' ELSE 'abc' END",
    "number_text": "CASE WHEN l_linenumber = 2 THEN NULL ELSE cast(l_partkey as string) END",
    "const_five": "5",
    "Label": "CASE WHEN l_returnflag = 'A' THEN '  BENIGN ' WHEN l_returnflag = 'N' AND l_linenumber = 1 THEN NULL "
             "WHEN l_returnflag = 'N' THEN 'Web Attack � XSS' WHEN l_linenumber = 3 THEN '  ' ELSE 'DoS' END",
}

PORTS = [80, 443, 53, 22, 5060, 554, 21, 25, 3306, 8080, 123, 500, 20000, 50000, 31337, 445, 3389, 8081, 27017, 4500]
PORT = "CASE l_partkey % 21 " + " ".join(f"WHEN {i} THEN {p}" for i, p in enumerate(PORTS)) + " ELSE NULL END"
FLOW_RECORDS = {
    "row_id": LINE_ID,
    "destination_port": PORT,
    "flow_duration": "cast(round(l_extendedprice * 100) as bigint)",
    "fwd_packets": "cast(l_quantity as bigint)",
    "bwd_packets": "cast(l_linenumber as bigint)",
    "fwd_bytes": "l_quantity * 60e0",
    "bwd_bytes": "l_extendedprice",
    "bytes_per_sec": "CASE WHEN l_quantity = 7 THEN cast('Infinity' as double) WHEN l_quantity = 9 THEN NULL "
                     "ELSE l_extendedprice * 2e3 END",
    "iat_mean": "l_extendedprice * 2e0",
    "iat_std": "l_quantity * 1e3",
    "rst_count": "CASE WHEN l_discount > 8e-2 THEN 1 WHEN l_discount < 1e-2 THEN NULL ELSE 0 END",
    "label": "CASE WHEN l_returnflag = 'A' THEN ' BENIGN ' WHEN l_returnflag = 'N' AND l_linenumber = 1 THEN NULL "
             "WHEN l_returnflag = 'N' THEN 'Web Attack � XSS' ELSE 'Benign' END",
    "source_file": "concat('day_', cast(l_suppkey % 8 as string), '.csv')",
}

SEGMENT = ("CASE event_type WHEN 'click' THEN 'BUILDING' WHEN 'view' THEN 'MACHINERY' WHEN 'signup' THEN 'HOUSEHOLD' "
           "WHEN 'purchase' THEN 'FURNITURE' ELSE 'AUTOMOBILE' END")
PACKETS = {
    "event_id": "event_id",
    "ts": "ts",
    "testbed": "CASE WHEN user_id % 2 = 0 THEN 'ntnu' ELSE 'wue' END",
    "gnb": "CASE WHEN user_id % 3 = 0 THEN 'oai' ELSE 'srs' END",
    "sdr": "'b200'",
    "bw_mhz": "cast((user_id % 2 + 1) * 20 as int)",
    "slots": "cast(user_id % 3 + 1 as int)",
    "ratio": SEGMENT,
    "direction": "CASE WHEN event_type IN ('click', 'view') THEN 'uplink' ELSE 'downlink' END",
}
THROUGHPUT = {
    "testbed": "CASE WHEN c_custkey % 2 = 0 THEN 'ntnu' ELSE 'wue' END",
    "source_file": "CASE WHEN c_custkey % 2 = 0 THEN 'ntnu_tput.csv' ELSE 'wue_tput.csv' END",
    "gnb": "CASE WHEN o_orderkey % 3 = 0 THEN 'oai' ELSE 'srs' END",
    "sdr": "'b200'",
    "bw": "cast((c_custkey % 4 + 1) * 20 as int)",
    "slots": "cast(o_orderkey % 3 + 1 as int)",
    "ratio": "c_mktsegment",
    "rep": "cast(o_orderkey % 5 as int)",
    "scenario": "o_orderpriority",
    "order_id": "o_orderkey",
    "mbpsactual_uplink": "CASE WHEN o_orderkey % 34 = 0 THEN 0e0 ELSE o_totalprice / 5e3 END",
    "mbpsactual_downlink": "CASE WHEN o_orderkey % 38 = 0 THEN 0e0 ELSE o_totalprice / 25e2 END",
    "meanjitterms_uplink": "CASE WHEN o_orderkey % 41 = 0 THEN NULL ELSE (o_orderkey % 50) / 10e0 END",
    "meanjitterms_downlink": "(o_orderkey % 70) / 10e0",
    "meanloss_uplink": "(o_orderkey % 120) / 100e0",
    "meanloss_downlink": "(o_orderkey % 7) / 100e0",
    "mbpsoffered_uplink": "CASE WHEN o_orderkey % 17 = 0 THEN 0e0 ELSE o_totalprice / 4e3 + (o_orderkey % 50) END",
    "mbpsoffered_downlink": "CASE WHEN o_orderkey % 19 = 0 THEN 0e0 ELSE o_totalprice / 2e3 END",
}


def _three(i: str) -> str:
    return f"lpad(cast({i} as string), 3, '0')"


# one simulator line per order: n records, a self path, an unmeasured and a short record
K = "o_orderkey"
RESULT_RECORD = (
    "concat(cast({k} % 1000 + {i} * 10 as string), ',', cast(({k} * 7 + {i} * 13) % 500 as string), ',', "
    "cast(CASE WHEN ({k} + {i}) % 3 = 0 THEN ({k} + {i} * 5) % 20 ELSE 0 END as string), ',', "
    "CASE WHEN ({k} + {i}) % 9 = 0 THEN '-1' ELSE concat('0.', lpad(cast(({k} * 11 + {i} * 17) % 900 as string), 3, '0')) END, "
    "',-2.5,0.1,0.2,0.3,0.4,0.', lpad(cast(({k} + {i} * 3) % 1000 as string), 3, '0'), "
    "CASE WHEN ({k} + {i}) % 11 = 0 THEN '' ELSE concat(',0.00', cast({i} as string)) END)"
)
TRAFFIC_RECORD = (
    "CASE WHEN {i} = {k} % (3 + {k} % 4) THEN '-1' ELSE concat(cast({i} % 3 as string), ',', "
    "cast(2000 + ({k} * 37 + {i} * 101) % 8000 as string), ',0.5,', cast(({k} + {i}) % 4 as string)) END"
)
GRAPH_NAME = (
    "concat('graph_', CASE WHEN {k} % 10 = 9 THEN 'odd' WHEN {k} % 3 = 0 THEN 'A_wfq_fixed' WHEN {k} % 3 = 1 "
    "THEN 'C_mixed_policy' ELSE 'D_mixed_equal' END, '_', cast({k} % 7 as string), '.txt')"
)
NODE_GRAPH = (
    "concat('graph_', CASE WHEN s_nationkey % 3 = 0 THEN 'A_wfq_fixed' WHEN s_nationkey % 3 = 1 "
    "THEN 'C_mixed_policy' ELSE 'D_mixed_equal' END, '_', cast(s_nationkey % 7 as string), '.txt')"
)
NODES = {
    "graph": NODE_GRAPH,
    "node": "cast(s_suppkey as int)",
    "policy": "CASE s_suppkey % 3 WHEN 0 THEN 'WFQ' WHEN 1 THEN 'SP' ELSE 'DRR' END",
    "weights": "CASE s_suppkey % 5 WHEN 0 THEN '60,30,10' WHEN 1 THEN '50, 40, 10' WHEN 2 THEN '70,30' "
               "ELSE '33,33,34' END",
}
ROUTES = {
    "routing": "concat('routing_', cast(c_custkey % 5 as string))",
    "route_no": "cast(floor(c_custkey / 5e0) as int)",
    "route": "concat(cast(c_nationkey as string), ',', cast(c_custkey % 8 as string), ',', cast(c_custkey % 11 as string)"
             ", CASE WHEN c_custkey % 3 = 0 THEN concat(',', cast(c_custkey % 17 as string)) ELSE '' END)",
}
EDGES = {"graph": "o_custkey", "src": "cast(o_orderkey % 5 as int)", "dst": "cast((o_orderkey * 3 + 1) % 7 as int)"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _select(df: DataFrame, columns: dict[str, str], names: list[str] | None = None) -> DataFrame:
    return df.select(*[F.expr(columns[n]).alias(n) for n in (names or columns)])


def _sql(columns: dict[str, str], source: str) -> str:
    return "SELECT " + ", ".join(f"{e} AS {n}" for n, e in columns.items()) + f" FROM {source}"


FLOW_SOURCE = "lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey"

DELAY_SQL = _sql(DELAY_FLOWS, FLOW_SOURCE)
RAW_SQL = _sql(RAW_TABLE, "lineitem")
FLOW_SQL = _sql(FLOW_RECORDS, "lineitem")
PACKET_SQL = _sql({**PACKETS, "epoch": "epoch_us(ts) / 1e6"}, "events")
THROUGHPUT_SQL = _sql(THROUGHPUT, "orders JOIN customer ON o_custkey = c_custkey")
NODES_SQL = _sql(NODES, "supplier")
ROUTES_SQL = _sql({**ROUTES, "nodes": f"list_transform(string_split({ROUTES['route']}, ','), lambda x: cast(x as int))"}, "customer")
EDGES_SQL = _sql(EDGES, "orders")


def _duck_records(record: str) -> str:
    text = record.format(k=K, i="i")
    return f"array_to_string(list_transform(range(0, 3 + {K} % 4), lambda i: {text}), ';')"


SIM_SQL = (
    f"SELECT {K} AS line_no, concat('sim', cast({K} % 16 as string)) AS archive, "
    f"concat('100,', cast({K} % 9 as string), ',0.5|', {_duck_records(RESULT_RECORD)}, ';') AS sim_line, "
    f"concat(cast({K} % 5000 as string), '|', {_duck_records(TRAFFIC_RECORD)}) AS traffic_line, "
    f"concat(cast({K} as string), ';', {GRAPH_NAME.format(k=K)}, ';routing_', cast({K} % 5 as string), "
    f"CASE WHEN {K} % 2 = 0 THEN '.txt' ELSE '' END) AS manifest_line FROM orders"
)


def delay_flows(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> DataFrame:
    lines, orders, parts = (table(spark, sf_dir, n) for n in ("lineitem", "orders", "part"))
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(
        parts, F.col("l_partkey") == F.col("p_partkey"))
    return _select(joined, DELAY_FLOWS, names)


def raw_table(spark, sf_dir) -> DataFrame:
    return _select(table(spark, sf_dir, "lineitem"), RAW_TABLE)


def flow_records(spark, sf_dir) -> DataFrame:
    return _select(table(spark, sf_dir, "lineitem"), FLOW_RECORDS)


def packets(spark, sf_dir) -> DataFrame:
    return packet_columns(table(spark, sf_dir, "events"))


def packet_columns(events: DataFrame) -> DataFrame:
    return _select(events, {**PACKETS, "epoch": "unix_micros(cast(ts as timestamp)) / 1e6"})


def throughput_wide(spark, sf_dir) -> DataFrame:
    joined = table(spark, sf_dir, "orders").join(
        table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return _select(joined, THROUGHPUT)


def nodes(spark, sf_dir) -> DataFrame:
    return _select(table(spark, sf_dir, "supplier"), NODES)


def routes(spark, sf_dir) -> DataFrame:
    from linkgauge.functions.parsing import path_nodes

    return _select(table(spark, sf_dir, "customer"), ROUTES).withColumn("nodes", path_nodes(F.col("route")))


def edges(spark, sf_dir) -> DataFrame:
    return _select(table(spark, sf_dir, "orders"), EDGES)


def sim_lines(spark, sf_dir) -> DataFrame:
    def records(record: str) -> str:
        text = record.format(k=K, i="i")
        return f"array_join(transform(sequence(cast(0 as bigint), 2 + {K} % 4), i -> {text}), ';')"

    wide = table(spark, sf_dir, "orders").select(
        F.expr(K).alias("line_no"), F.expr(f"concat('sim', cast({K} % 16 as string))").alias("archive"),
        F.expr(f"concat('100,', cast({K} % 9 as string), ',0.5|', {records(RESULT_RECORD)}, ';')").alias("sim_line"),
        F.expr(f"concat(cast({K} % 5000 as string), '|', {records(TRAFFIC_RECORD)})").alias("traffic_line"),
        F.expr(
            f"concat(cast({K} as string), ';', {GRAPH_NAME.format(k=K)}, ';routing_', cast({K} % 5 as string), "
            f"CASE WHEN {K} % 2 = 0 THEN '.txt' ELSE '' END)").alias("manifest_line"),
    )
    members = [F.struct(F.lit(m).alias("member"), F.col(c).alias("line")) for m, c in MEMBERS.items()]
    return join_members(wide.select("archive", "line_no", F.inline(F.array(*members))))[0]


PACKET_KEYS_SQL = "testbed, gnb, sdr, bw_mhz, slots, ratio, direction"
