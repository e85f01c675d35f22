"""Steps whose work must grow no faster than their rows."""

import tarfile
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from catalog import raw_files
from linkgauge.operators import attribution, delays, encoding, models
from linkgauge.plans import training


def test_neighbours_of_a_large_graph(spark, tmp_path):
    """Numbers of a graph were sorted again for each of its edges: a minute and more for these nodes."""
    spark.range(12000).select(F.col("id").alias("s_suppkey"), F.lit(1).alias("s_nationkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    started = time.perf_counter()
    folder = raw_files.graph_files(spark, str(tmp_path), f"{tmp_path}/graphs")
    assert time.perf_counter() - started < 40
    (file,) = [f for f in (tmp_path / "graphs").iterdir() if not f.name.startswith(".")]
    text = file.read_text()
    assert folder and text.count("edge [") == 11999 and "source 0\n    target 1\n    bandwidth 1000\n" in text


def test_archives_are_written_as_streams(spark, tmp_path):
    """Lines of a member over several batches, blank lines, ties and a member without text."""
    rows = [("a.tar.gz", 0, i % 7, f"é{i}" if i % 5 else "") for i in range(50)] + [("a.tar.gz", 2, 1, "only"), ("b.tar.gz", 1, 3, "x"), ("b.tar.gz", 0, 0, "")]
    lines = spark.createDataFrame(rows, "name string, member int, place long, line string").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        raw_files.write_archives(lines, str(tmp_path / "archives"))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    found = {}
    for name in ("a", "b"):
        with tarfile.open(tmp_path / "archives" / f"{name}.tar.gz") as tar:
            found[name] = {m.name: tar.extractfile(m).read().decode() for m in tar}
    ordered = "\n".join(r[3] for r in sorted((r for r in rows if r[:2] == ("a.tar.gz", 0)), key=lambda r: (r[2], r[3].encode())))
    assert found == {"a": {"results/simulationResults.txt": ordered, "results/input_files.txt": "only"}, "b": {"results/traffic.txt": "x"}}


def test_route_facts_only_of_routes_that_flows_can_use(spark):
    pairs = spark.createDataFrame([("g", "r", 2), ("h", "r", 1), ("g", "none", 3)], "graph string, routing string, flows int")
    routes = spark.createDataFrame([("r", i, [1, 2]) for i in range(5)], "routing string, route_no int, nodes array<int>")
    nodes = spark.createDataFrame([("g", 1, "WFQ", "60,30"), ("g", 2, "SP", "1,1")], "graph string, node int, policy string, weights string")
    facts = delays.route_facts(pairs, routes, nodes).select("graph", "routing", "route_no").distinct()
    assert sorted(map(tuple, facts.collect())) == [("g", "r", 0), ("g", "r", 1), ("h", "r", 0)]


def test_unknown_nodes_of_many_routes(spark):
    """Routes are reduced to their nodes before they meet the graphs."""
    lines = spark.createDataFrame([(f"{i};g{i};r.txt",) for i in range(3)], "manifest_line string")
    routes = spark.createDataFrame([("r", i, [1, 9]) for i in range(4)], "routing string, route_no int, nodes array<int>")
    nodes = spark.createDataFrame([("g0", 1), ("g1", 1), ("g1", 9)], "graph string, node int")
    unknown = delays.unknown_nodes(lines, routes, nodes)
    assert [tuple(r) for r in unknown.collect()] == [("g0", "r", 9)]
    plan = unknown._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = [i for i, line in enumerate(plan) if "Generate explode" in line][0]
    assert "Aggregate [routing" in plan[depth - 1] + plan[depth - 2]


@pytest.fixture()
def counted(monkeypatch):
    """How often fills are searched and tables are written, by name."""
    calls = Counter()
    fills, written = encoding.fill_values, training.materialize

    def count_fills(*args):
        calls["fills"] += 1
        return fills(*args)

    def count_written(df, name="table"):
        calls[name] += 1
        return written(df, name)

    monkeypatch.setattr(encoding, "fill_values", count_fills)
    for module in (training, attribution):
        monkeypatch.setattr(module, "materialize", count_written, raising=False)
    return calls


@pytest.fixture(scope="module")
def flows(spark):
    return spark.range(400).select(
        F.col("id").alias("row_id"), (F.col("id") % 3).alias("scenario"), F.element_at(F.array(F.lit("Gold"), F.lit("Bronze")), (F.col("id") % 2 + 1).cast("int")).alias("qos_class"),
        F.when(F.col("id") % 5 == 0, "SP").otherwise("WFQ").alias("scheduling_policy"), F.when(F.col("id") % 11 > 0, F.col("id") % 7).alias("routing_hops"),
        (F.col("id") % 13 / 100 + 0.01).alias("avg_delay"), F.when(F.col("id") % 3 == 0, 0.1).otherwise(0.0).alias("packet_loss_rate"),
    ).withColumn("log_avg_delay", F.ln("avg_delay")).localCheckpoint()


def test_folds_are_written_once_for_all_models(flows, counted):
    specs = [models.mean_model(), models.line_model("routing_hops")]
    training.evaluate_delay_models(flows, specs, ["row_id"], k=2)
    assert counted["folds"] == 1
    training.metric_target_eval(flows, "avg_delay", specs[1], ["row_id"], k=2)
    assert counted["folds"] == 2


def test_permutations_read_a_written_table(flows, counted):
    fitted = models.line_model("routing_hops").fit(flows, "log_avg_delay", [])
    attribution.permutation_importance(flows, fitted.predict, "log_avg_delay", ["routing_hops", "scenario"], ["row_id"]).collect()
    assert counted["permuted"] == 1


def test_benchmark_fits_each_encoder_once(flows, counted):
    """Two folds and all rows, whatever the models; shared or not, a model is the same."""
    specs = [models.linear_model(), models.forest_model(2, 2)]
    together, _ = training.benchmark_models(flows, "log_avg_delay", "delay", ["row_id"], "d", specs, k=2)
    assert counted["fills"] == 3
    names = ["model", "status", "mae", "cv_mae_mean"]
    alone = [training.benchmark_models(flows, "log_avg_delay", "delay", ["row_id"], "d", [s], k=2)[0].select(names).first() for s in specs]
    assert together.select(names).collect() == alone and {r["status"] for r in alone} == {"ok"}


def test_loss_classifiers_share_encoders(flows, counted):
    training.evaluate_loss_classifiers(flows, ["row_id"], k=2, specs=models.loss_specs(trees=2, depth=2, rounds=1)).collect()
    assert counted["fills"] == 2
