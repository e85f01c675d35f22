"""Model jobs, allocation edges and streams in several micro-batches."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from linkgauge.operators import allocation, attribution, encoding, evaluation, loads, models, routing
from linkgauge.plans import targets, training
from linkgauge.streaming import runner, telemetry


@pytest.fixture(scope="module")
def flows(spark):
    """Delays that depend on hops, class and weight, with every model input of the delay table."""
    rng = random.Random(1)
    rows = []
    for i in range(1200):
        tos = rng.choice([0, 1, 2, 2, 2])
        hops, weight = rng.randint(1, 6), [60.0, 30.0, 10.0][tos]
        delay = math.exp(-5 + 0.3 * hops + 0.5 * tos + rng.gauss(0, 0.1))
        rows.append((i, f"s{i % 3}", "ABCD"[i % 4], tos, ["Gold", "Silver", "Bronze"][tos], rng.uniform(100, 900), hops,
                     "WFQ" if i % 2 else "SP", weight, weight, delay, 0.1 if rng.random() < 0.15 + 0.1 * hops else 0.0))
    df = spark.createDataFrame(
        rows, "row_id int, simulation_id string, scenario string, tos int, qos_class string, offered_bandwidth double, "
              "routing_hops int, scheduling_policy string, tos_queue_weight double, min_tos_weight double, "
              "avg_delay double, packet_loss_rate double")
    return df.withColumns({"log_avg_delay": F.ln("avg_delay"), "jitter": F.col("avg_delay") / 10}).repartition(3)


def test_no_outcome_is_an_input(flows):
    inputs = targets.feature_columns(flows.columns, "delay", "log_avg_delay")
    assert set(inputs) == {"tos", "qos_class", "offered_bandwidth", "routing_hops", "scheduling_policy",
                           "tos_queue_weight", "min_tos_weight"}
    assert "qos_class" not in targets.feature_columns(flows.columns, "loss", "label")
    assert "jitter_ms" not in targets.drop_list("link", "jitter_ms")
    with pytest.raises(ValueError):
        targets.drop_list("nope", "x")


def test_encoder_unknown_and_missing(spark):
    train = spark.createDataFrame([(1.0, "a"), (3.0, "b"), (None, "b"), (100.0, None)], "x double, c string")
    encoder = encoding.fit_encoder(train, ["x", "c"])
    other = spark.createDataFrame([(None, "zzz"), (5.0, None)], "x double, c string")
    got = [r["features"].toArray().tolist() for r in encoder.transform(other).collect()]
    assert got == [[3.0, 0.0, 0.0], [5.0, 0.0, 1.0]]
    assert encoding.feature_names(encoder, ["x"], ["c"]) == ["numeric__x", "categorical__c_a", "categorical__c_b"]


def test_benchmark_statuses(flows):
    def broken(train, target, features):
        raise RuntimeError("no luck")

    specs = [models.mean_model(), models.linear_model(), models.forest_model(4, 5), models.boosted_model(4, 3),
             models.kernel_model(components=30), models.ModelSpec("absent", None, "not installed"),
             models.ModelSpec("broken", broken),
             models.external_model("infinite", lambda df: df.withColumn("y_pred", F.lit(float("inf"))))]
    results, importances = training.benchmark_models(flows, "log_avg_delay", "delay", ["row_id"], "t", specs, k=1)
    got = {r["model"]: r for r in results.collect()}
    assert got["absent"]["status"] == "skipped" and got["broken"]["status"] == "failed"
    assert got["infinite"]["status"] == "failed" and "non-finite" in got["infinite"]["error_message"]
    for name in ("linear", "forest", "boosted", "kernel"):
        assert got[name]["status"] == "ok", got[name]["error_message"]
        assert got[name]["mae"] < got["mean"]["mae"] and got[name]["r2_score"] > 0
    assert got["linear"]["r2_score"] > 0.9 and got["linear"]["feature_count"] == 7
    ranks = [r["rank"] for r in importances.filter("model = 'forest'").orderBy("rank").collect()]
    assert ranks == list(range(1, len(ranks) + 1))


def test_benchmark_query_fits_the_documented_sizes(flows, monkeypatch):
    """Trees, rounds, depths and folds of the query are the operators' defaults; fits are only looked at here."""
    from catalog import modelling

    seen = set()

    def fit(self, data):
        trees = self.getNumTrees() if hasattr(self, "getNumTrees") else self.getMaxIter()
        seen.add((type(self).__name__, trees, self.getMaxDepth()))
        raise RuntimeError("seen")

    for kind in (models.RandomForestRegressor, models.GBTRegressor):
        monkeypatch.setattr(kind, "fit", fit)
    monkeypatch.setattr(models, "linear_model", models.mean_model)
    monkeypatch.setattr(modelling, "flows", lambda spark, sf: flows.withColumn("fold", F.lit(0)))
    got = modelling.benchmark_models(None, None).collect()
    assert seen == {("RandomForestRegressor", 200, 30), ("GBTRegressor", 200, 4)}
    assert len(got) == 4 and {r["cv_folds"] for r in got} == {5}


def test_benchmark_writes_ids_only_where_they_are_read(flows, monkeypatch):
    written = []
    monkeypatch.setattr(training, "materialize", lambda df, name: written.append(set(df.columns)) or df)
    unread = models.ModelSpec("unread", lambda *given: None, fit_encoded=lambda *given: None)
    plain = models.external_model("plain", lambda df: df.withColumn("y_pred", F.col("row_id") * 0.0))
    for specs, k in (([unread], 1), ([unread, plain], 1), ([unread], 2)):
        results, _ = training.benchmark_models(flows, "log_avg_delay", "delay", ["row_id"], "t", specs, k=k)
    assert ["row_id" in columns for columns in written] == [False, True, True]
    inputs = targets.feature_columns(flows.columns, "delay", "log_avg_delay")
    assert all(columns >= {*inputs, "log_avg_delay", "is_test"} for columns in written)


def test_out_of_fold_never_sees_its_row(flows):
    """With one row per fold value the closed forms equal leave-one-out sums."""
    small = flows.filter("row_id < 5").withColumn("fold", F.col("row_id"))
    rows = models.mean_out_of_fold(small, "avg_delay").collect()
    total = sum(r["avg_delay"] for r in rows)
    assert all(r["y_pred"] == pytest.approx((total - r["avg_delay"]) / 4) for r in rows)


def test_closed_form_equals_fitted_line(flows):
    data = flows.withColumn("fold", F.col("row_id") % 3)
    fast = {r["row_id"]: r["y_pred"] for r in models.line_out_of_fold(data, "routing_hops", "log_avg_delay").collect()}
    slow = models.out_of_fold(data, models.line_model("routing_hops"), "log_avg_delay", [], 3).collect()
    assert len(slow) == len(fast) == 1200
    assert all(fast[r["row_id"]] == pytest.approx(r["y_pred"], abs=1e-9) for r in slow)


def test_loss_classifiers(flows):
    got = training.evaluate_loss_classifiers(flows, ["row_id"], k=2, specs=models.loss_specs(4, 4, 3)).collect()
    assert len(got) == 3
    for r in got:
        assert 0 <= r["precision"] <= 1 and 0 <= r["recall"] <= 1 and r["auc_roc"] > 0.5
    with pytest.raises(ValueError, match="positive"):
        training.evaluate_loss_classifiers(flows.withColumn("packet_loss_rate", F.lit(0.0)), ["row_id"], k=2)


def test_loss_query_fits_the_documented_sizes(flows, monkeypatch):
    from catalog import modelling

    seen = {}
    monkeypatch.setattr(training, "evaluate_loss_classifiers", lambda df, ids, k=5, specs=None: seen.update(k=k, specs=specs or models.loss_specs()))
    monkeypatch.setattr(modelling, "flows", lambda spark, sf: flows.withColumn("fold", F.lit(0)))
    modelling.loss_classifiers(None, None)
    made = {name: make() for name, (make, _) in seen["specs"].items()}
    forest, boosted = made.pop("forest_balanced"), list(made.values())
    assert seen["k"] == 5 and (forest.getNumTrees(), forest.getMaxDepth()) == (200, 30)
    assert [(x.getMaxIter(), x.getMaxDepth()) for x in boosted] == [(200, 4)] * 2


def test_units():
    assert evaluation.resolve_unit(["packet_loss_rate"]) == (100.0, "%")
    assert evaluation.resolve_unit(["packet_loss_rate", "jitter"]) == (1000.0, "ms")
    assert evaluation.resolve_unit(["packet_loss_rate"], 5.0, "x") == (5.0, "x")


def test_allocation_edges(spark):
    pattern = spark.createDataFrame([(0, "x"), (1, "x"), (7, "Bronze"), (None, "other")], "tos int, qos_class string")
    classes = sorted(r["qos_class"] for r in allocation.traffic_pattern(pattern).collect())
    assert classes == ["Bronze", "Gold", "Silver", "other"]
    sla = {"Gold": 20.0, "Silver": 50.0, "Bronze": 100.0}
    even = allocation.evaluate_profiles(pattern, lambda d: d.withColumn("y_pred", F.ln(F.lit(0.02))), ["50,40,10", "60,30,10"], sla)
    rows = even.orderBy("rank").collect()
    assert [r["profile"] for r in rows] == ["50/40/10", "60/30/10"]  # tie: order given
    no_silver = pattern.filter("tos is distinct from 1")
    row = allocation.evaluate_profiles(no_silver, lambda d: d.withColumn("y_pred", F.lit(-9.0)), ["1,1,1"], sla).head()
    assert not row["sla_feasible"] and row["silver_rows"] == 0 and row["silver_mean_delay_ms"] is None
    with pytest.raises(ValueError):
        allocation.traffic_pattern(spark.range(1))


def test_mean_exactly_at_agreement_is_feasible(spark):
    rows = [(0, c, 1, ms, ms, ms, 0.0) for c, ms in (("Gold", 20.0), ("Silver", 50.0), ("Bronze", 100.0))]
    summary = spark.createDataFrame(
        rows, "profile_no int, qos_class string, rows bigint, mean_delay_ms double, p90_delay_ms double, "
              "max_delay_ms double, violation_rate double")
    got = allocation.profile_scores(summary, [{"Gold": 1.0, "Silver": 1.0, "Bronze": 1.0}],
                                    {"Gold": 20.0, "Silver": 50.0, "Bronze": 100.0}).head()
    assert got["sla_feasible"] and got["weighted_violation_score"] == 0 and got["weighted_delay_score"] == 6.0


def test_recommend_allocation_with_trees(flows):
    got = training.recommend_allocation(flows, ["row_id"], models.boosted_model(3, 3)).orderBy("rank").collect()
    assert [r["rank"] for r in got] == [1, 2, 3, 4, 5] and got[0]["recommended"] and not got[1]["recommended"]
    assert all(math.isfinite(r["holdout_rmse_log_delay"]) and r["traffic_rows"] == 1200 for r in got)
    with pytest.raises(ValueError, match="missing required"):
        training.recommend_allocation(flows, ["row_id"], models.line_model("routing_hops"), pattern=flows.select("tos"))


def test_permutation_importance(flows):
    data = flows.select("row_id", "routing_hops", "offered_bandwidth", "log_avg_delay")
    fitted = models.line_model("routing_hops").fit(data, "log_avg_delay", [])
    got = {r["feature"]: r["importance"] for r in attribution.permutation_importance(
        data, fitted.predict, "log_avg_delay", ["routing_hops", "offered_bandwidth"], ["row_id"]).collect()}
    assert got["routing_hops"] > 0.05 and got["offered_bandwidth"] == pytest.approx(0, abs=1e-9)


def test_shortest_paths(spark):
    edges = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (1, 0, 3), (1, 3, 2), (1, 2, 4), (2, 5, 6)], "graph int, src int, dst int")
    got = {(r["graph"], r["src"], r["dst"]): r["path"] for r in routing.all_pairs_paths(edges).collect()}
    assert len(got) == 20 + 2
    assert got[(1, 0, 4)] == [0, 1, 2, 4] and got[(1, 4, 0)] == [4, 2, 1, 0] and got[(2, 6, 5)] == [6, 5]


def test_loads_of_routes(spark):
    """Ties of ToS go to the smaller one; a route of one node loads no link; flows without a route are left out."""
    flows = spark.createDataFrame([("g", "r", 0, 5.0, 2), ("g", "r", 0, 7.0, 1), ("g", "r", 1, 4.0, 0), ("g", "r", 2, 9.0, 1), ("g", "r", 9, 1.0, 1)],
                                  "graph string, routing string, route_no int, offered_bandwidth double, tos int")
    routes = spark.createDataFrame([("r", 0, [1, 2, 3]), ("r", 1, [1, 4, 2, 3]), ("r", 2, [6])], "routing string, route_no int, nodes array<int>")
    routed = loads.routed_flows(flows, routes)
    assert {tuple(r) for r in loads.traffic_matrix(routed).collect()} == {("g", 1, 3, 3, 16 / 3, 0), ("g", 6, 6, 1, 9.0, 1)}
    assert {tuple(r) for r in loads.link_loads(routed).collect()} == {
        ("g", 1, 2, 2, 12.0), ("g", 2, 3, 3, 16.0), ("g", 1, 4, 1, 4.0), ("g", 4, 2, 1, 4.0)}


def test_linear_folds_from_gram_matrices(spark):
    """As least squares fitted fold by fold: large means, dependent and constant inputs, NULLs, a fold that is alone."""
    import numpy as np

    draw = np.random.default_rng(3)
    n = 300
    x = draw.normal(size=(n, 3)) * [1, 1e-3, 50] + [1e6, 0, -7]
    y = x @ [2.0, 500.0, -0.1] + draw.normal(size=n)
    fold = draw.integers(0, 4, n)
    rows = [(i, int(fold[i]), *map(float, x[i]), float(y[i])) for i in range(n)]
    rows += [(n, 1, None, 0.0, 0.0, 1.0), (n + 1, 2, 1e6, 0.0, -7.0, None), (n + 2, None, 1e6, 0.0, -7.0, 1.0)]
    df = spark.createDataFrame(rows, "id int, fold int, a double, b double, c double, y double")
    inputs = {"a": F.col("a"), "b": F.col("b"), "c": F.col("c"), "twice": F.col("a") * 2, "one": F.lit(1.0)}
    got = {r["id"]: r["y_pred"] for r in models.linear_out_of_fold(df, inputs, "y").collect()}
    for f in range(4):
        train = fold != f
        mean = x[train].mean(axis=0)
        b, *_ = np.linalg.lstsq(np.c_[np.ones(train.sum()), x[train] - mean], y[train], rcond=None)
        for i in np.flatnonzero(~train):
            assert got[i] == pytest.approx(b[0] + (x[i] - mean) @ b[1:], rel=1e-9, abs=1e-6)
    assert got[n] is None and got[n + 1] is not None and got[n + 2] is None
    alone = models.linear_out_of_fold(df.filter("fold = 1"), inputs, "y")
    assert alone.columns == [*df.columns, "y_pred"] and alone.filter("y_pred IS NOT NULL").count() == 0


def _write_batches(spark, path, frames):
    for frame in frames:
        frame.coalesce(1).write.mode("append").parquet(path)


def test_inter_arrival_across_micro_batches(spark, tmp_path):
    times = [[1.0, 2.0, 10.0], [11.5, 12.0], [30.0]]
    path = str(tmp_path / "in")
    for i, batch in enumerate(times):
        _write_batches(spark, path, [spark.createDataFrame([("k", t) for t in batch], "k string, epoch double")])
    stream = runner.file_stream(spark, path, spark.read.parquet(path).schema, "*.parquet", files_per_batch=1)
    base = str(tmp_path / "out")
    gaps = sorted((r["epoch"], r["iat"]) for r in runner.run_append(runner.inter_arrival_stream(stream, ["k"]), path=base).collect())
    assert gaps == [(1.0, 0.0), (2.0, 1.0), (10.0, 8.0), (11.5, 1.5), (12.0, 0.5), (30.0, 18.0)]


def test_inter_arrival_goes_on_after_a_restart(spark, tmp_path):
    """A late packet has no gap and doesn't move the latest time; rows without time or key stay; other keys keep their state."""
    path, base = str(tmp_path / "in"), str(tmp_path / "out")
    batches = [[("a", 1.0), ("b", 5.0), (None, 2.0)], [("a", 4.0), ("a", None), (None, 2.5)], [("a", 3.0), ("a", 6.0), ("b", 5.5)]]
    for batch in batches:
        _write_batches(spark, path, [spark.createDataFrame(batch, "k string, epoch double")])
        stream = runner.file_stream(spark, path, spark.read.parquet(path).schema, "*.parquet")
        out = runner.run_append(runner.inter_arrival_stream(stream, ["k"]), path=base)
    assert sorted(((r["k"], r["epoch"], r["iat"]) for r in out.collect()), key=repr) == sorted([
        ("a", 1.0, 0.0), ("b", 5.0, 0.0), (None, 2.0, 0.0), ("a", 4.0, 3.0), ("a", None, None), (None, 2.5, 0.5), ("a", 3.0, 0.0), ("a", 6.0, 2.0), ("b", 5.5, 0.5)], key=repr)


def test_open_bursts_come_from_the_state(spark, tmp_path):
    """Closed and open bursts together are all bursts; a run a day later loses no packet."""
    path, base = str(tmp_path / "in"), str(tmp_path / "out")
    seen = []
    for day, seconds in ((1, [0, 60, 4000]), (1, [120, 90_000]), (2, [7000, 86_000])):
        seen += [1_700_000_000 + day * 86_400 + s for s in seconds]
        frame = spark.createDataFrame([("k", 1_700_000_000 + day * 86_400 + s) for s in seconds], "k string, s long").select(
            "k", F.timestamp_seconds("s").alias("ts"))
        _write_batches(spark, path, [frame])
        before = spark.read.parquet(path).count()
        stream = telemetry.event_time(runner.file_stream(spark, path, frame.schema), late="3 days")
        closed = runner.run_append(telemetry.bursts(stream, ["k"], "10 minutes"), path=base)
        both = closed.unionByName(telemetry.open_bursts(runner.open_state(spark, base), ["k"]))
        runs = sorted(seen)
        starts = 1 + sum(b - a >= 600 for a, b in zip(runs, runs[1:], strict=False))
        assert both.count() == starts and both.agg(F.sum("packets")).first()[0] == len(seen)
        assert spark.read.parquet(path).count() == before == len(seen)


def test_monitor_over_micro_batches_equals_batch(spark, tmp_path):
    rows = [(f"2024-01-01 00:{i % 60:02d}:00", ["Gold", "Bronze"][i % 2], float(i % 90)) for i in range(240)]
    frame = spark.createDataFrame(rows, "t string, qos_class string, delay_ms double").select(
        F.col("t").cast("timestamp").alias("ts"), "qos_class", "delay_ms")
    path = str(tmp_path / "in")
    _write_batches(spark, path, [frame.filter("delay_ms < 40"), frame.filter("delay_ms >= 40")])
    sla = {"Gold": 30.0, "Silver": 50.0, "Bronze": 60.0}
    stream = runner.file_stream(spark, path, frame.schema, "*.parquet", files_per_batch=1).withWatermark("ts", "1 day")
    live = telemetry.sla_monitor(stream, sla, 0.3, "10 minutes")
    got = runner.run_updates(live, ["window_start", "qos_class"])
    expected = telemetry.sla_monitor(frame, sla, 0.3, "10 minutes")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))


def test_stream_recommendation_infeasible(spark, tmp_path):
    path = str(tmp_path / "in")
    _write_batches(spark, path, [spark.createDataFrame([(0, "Gold"), (1, "Silver"), (2, "Bronze")], "tos int, qos_class string"),
                                 spark.createDataFrame([(0, "Gold")], "tos int, qos_class string")])
    stream = runner.file_stream(spark, path, spark.read.parquet(path).schema, "*.parquet", files_per_batch=1)
    predict = lambda df: df.withColumn("y_pred", F.lit(-6.0))
    schema = ("decision string, profile string, sla_feasible boolean, traffic_rows bigint, "
              "weighted_violation_score double, weighted_delay_score double")
    got = runner.run_each_batch(stream, lambda b: telemetry.recommend_batch(b, predict), schema)
    assert sorted(r["decision"] for r in got.collect()) == ["60/30/10", "infeasible"]


def test_kernel_model_encodes_its_rows_once(flows, monkeypatch):
    """The facts, the fit and its summary encoded every training row again; a batch is one block of numbers."""
    given, mapped = [], models.fourier_features

    def spy(encoded, *more):
        given.append(encoded)
        return mapped(encoded, *more)

    monkeypatch.setattr(models, "fourier_features", spy)
    rows = flows.withColumn("y", F.col("avg_delay"))
    models.kernel_model(components=7).fit(rows, "y", ["offered_bandwidth", "qos_class"])
    assert given[0].columns == ["features", "y"]
    plan = given[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Relation") and "Project" not in plan


def test_fourier_features_by_hand(flows):
    rows = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(
        flows.sparkSession.range(25).select("id", F.col("id").cast("double").alias("a"), (F.col("id") % 3).cast("double").alias("b")))
    got = {r["id"]: r["features"].toArray() for r in models.fourier_features(rows.repartition(30), 6, 0.1, 2, 3).collect()}
    rng = np.random.default_rng(3)
    weights, offsets = rng.normal(scale=np.sqrt(0.2), size=(2, 6)), rng.uniform(0, 2 * np.pi, size=6)
    assert len(got) == 25
    for i, found in got.items():
        assert np.allclose(found, np.sqrt(2 / 6) * np.cos(np.array([i, i % 3]) @ weights + offsets))
