import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from linkgauge.llm import line_frequency, line_windows, queries

COLUMNS = "doc_id long, text string, source string, line string, quality string, key string"
LONG = " ".join(f"word{i}" for i in range(60))


def rows_of(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def sql(name, docs):
    con = duckdb.connect()
    con.register("documents", pd.DataFrame([r.asDict() for r in docs.collect()], columns=docs.columns).astype({"doc_id": "Int64", "text": "string", "source": "string"}))
    return con.sql(queries.SQL[name]).df()


@pytest.fixture
def docs(spark):
    rows = [(i, f"shared footer line\n{LONG} number{i}", "a", "x", "y", "z") for i in range(25)]
    rows += [(100 + i, f"Shared  footer line\n{LONG} number{i}", None, "x", "y", "z") for i in range(5)]
    rows += [(200, "shared footer line\n" * 30, "a", None, None, None), (201, None, "a", None, None, None), (202, "", None, None, None, None),
             (None, LONG, "a", None, None, None), (None, LONG, "a", None, None, None), (203, " \t\n\x0b ", "a", None, None, None),
             (204, "a b c " * 40, "b", None, None, None), (205, ("#*$ %&|<> é\n" * 9) + LONG, "b", None, None, None), (206, "x " * 30_000, "b", None, None, None)]
    return spark.createDataFrame(rows, COLUMNS)


def test_quality_rules(docs):
    judged = line_frequency.judge(docs)
    assert judged.columns == [*docs.columns, "_quality"] and judged.count() == docs.count()
    out = {r.doc_id: r["_quality"] for r in judged.collect()}
    assert out[0].kept and out[0].n_removed_words == 3 and out[0].clean_text == f"{LONG} number0"
    assert out[100].kept and out[100].n_removed_words == 0  # five texts of the null host are within the limit
    assert out[200].n_dup_lines == 29 and not out[200].kept
    assert (out[201].n_words, out[201].base_failed, out[201].clean_text) == (0, True, None)
    assert out[204].n_repeat_words == 120 and out[204].base_failed
    assert out[205].n_symbols == 72 and out[None].kept


def test_depleted_documents_go(spark):
    lines = [f"menu{i} entry{i} number{i}" for i in range(20)]
    rows = [(i, "\n".join(lines) + f"\nonly{i}", "h") for i in range(30)]
    out = line_frequency.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).select("quality.*").collect()
    assert not any(r.base_failed or r.kept for r in out) and {r.clean_text for r in out} == {f"only{i}" for i in range(30)}


def test_copies_of_a_text_count_once(spark):
    text = "\n".join(f"first{i} second{i} third{i}" for i in range(20))
    out = line_frequency.judge(spark.createDataFrame([(i, text, "h") for i in range(50)], "doc_id long, text string, source string"))
    assert {r.kept for r in out.select("quality.kept").collect()} == {True}


def test_lines_are_judged_by_their_share_of_the_host(spark):
    prose = lambda i: "\n".join(f"a{i}x{k} b{i}x{k} c{i}x{k}" for k in range(20))
    rows = [(i, prose(i) + ("\nand so it was" if i < 30 else "") + ("\nall rights reserved" if i % 10 == 0 else ""), h) for h in ("big", None) for i in range(1000)]
    rows += [(i, prose(i) + ("\nand so it was" if i < 30 else ""), "small") for i in range(100)]
    out = line_frequency.judge(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    lost = {(r.source, r.doc_id): r.n for r in out.select("source", "doc_id", F.col("quality.n_removed_words").alias("n")).collect()}
    for host in ("big", None):
        assert all(lost[host, i] == (3 if i % 10 == 0 else 0) for i in range(1000))
    assert all(lost["small", i] == (4 if i < 30 else 0) for i in range(100))


def test_long_lines_stay_once(spark):
    notes = [" ".join(f"{x}{i}" for i in range(40)) for x in "pq"]
    rows = [(i, "\n".join([notes[0], f"{LONG} {i}", notes[1]]), "h") for i in range(30)]
    out = line_frequency.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).select("doc_id", "text", "quality.*").collect()
    whole = [r for r in out if r.clean_text == r.text]
    assert len(whole) == 1 and whole[0].n_removed_words == 0 and all(r.kept for r in out)
    assert all(r.clean_text == f"{LONG} {r.doc_id}" and r.n_removed_words == 80 for r in out if r is not whole[0])


def test_quality_rules_match_sql(spark, docs):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words"]
    ours = line_frequency.judge(docs).selectExpr("doc_id", *[f"_quality.{n}" for n in names])
    theirs = sql("op4_line_frequency", docs)[["doc_id", *names]]
    as_rows = [tuple(None if pd.isna(x) else getattr(x, "item", lambda x=x: x)() for x in r) for r in theirs.itertuples(index=False)]
    assert sorted(map(str, as_rows)) == sorted(map(str, rows_of(ours)))


def test_no_rows(spark, docs):
    none = docs.limit(0)
    assert line_frequency.judge(none).count() == 0 and line_windows.remove_repeats(none).count() == 0


def brute_windows(rows, width=3):
    """Lines left of each (key, text), by one pass in order."""
    white, seen, left = " \t\n\x0b\f\r", set(), {}
    for key, text in sorted({r for r in rows if r[1] is not None}, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        lines = text.split("\n")
        full = [(i, x.strip(white)) for i, x in enumerate(lines) if x.strip(white)]
        gone = set()
        for k in range(len(full) - width + 1):
            window = tuple(x for _, x in full[k : k + width])
            if window in seen:
                gone.update(i for i, _ in full[k : k + width])
            seen.add(window)
        left[key, text] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return left


def test_line_windows(spark):
    base = "one\ntwo\n\nthree\nfour"
    rows = [(1, base), (2, f"zero\n{base}\nfive"), (3, "one\ntwo"), (4, None), (5, ""), (6, "a\na\na\na\na"), (7, " one \ntwo\t\nthree"), (8, "y\n" * 9000 + "z")]
    docs = spark.createDataFrame([(k, t, "extra", 1) for k, t in rows], "doc_id long, text string, places string, n_removed_lines int")
    out = line_windows.remove_repeats(docs)
    assert out.columns == [*docs.columns, "_n_removed_lines"]
    expected = brute_windows(rows)
    got = {r.doc_id: r for r in out.collect()}
    for key, text in rows:
        assert got[key].text == expected.get((key, text)), key
    assert got[2].text == "zero\n\nfive" and got[2]["_n_removed_lines"] == 4 and got[6].text == "a"


def test_equal_rows_and_null_keys(spark):
    text = "one\ntwo\nthree"
    docs = spark.createDataFrame([(1, text), (1, text), (None, text), (None, text)], "doc_id long, text string")
    assert sorted(r.text for r in line_windows.remove_repeats(docs).collect()) == ["", "", text, text]


def test_verdicts_agree_with_judge_and_keep_long_lines_once(spark):
    """Without texts: the same counts and verdicts; a long line stays in the text of the least key; odd rows and names stay."""
    short, long = "read our license terms", " ".join(f"l{i}" for i in range(25))
    body = lambda i: " ".join(f"w{i}x{j}" for j in range(70))
    rows = [(i, f"{body(i)}\n{short}\n{short.upper()}", "a", 1, "q") for i in range(30)]
    rows += [(100 + i, f"{body(100 + i)}\n{long}", "b", 1, "q") for i in (3, 1, 2, *range(4, 30))]
    rows += [(102, f"{body(102)}\n{long}", "b", 1, "q"), (None, None, None, None, None), (7, "", "a", 1, "q"), (None, f"{body(500)}\n{long}", "b", 1, None), (8, short, None, 1, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, host long, quality string")
    got = line_frequency.verdicts(df, max_percent=50)
    assert got.columns == ["doc_id", "source", "host", "quality", "_quality"] and got.count() == len(rows)
    lost = {r.doc_id: r._quality.n_removed_words for r in got.where("source = 'b'").collect()}
    assert lost == {k: 0 if k == 101 else 25 for k in lost} and None in lost
    assert {r._quality.n_removed_words for r in got.where("source = 'a' AND doc_id < 30 AND doc_id != 7").collect()} == {8}
    odd = {(r.doc_id, r.source): r._quality for r in got.where("source IS NULL OR doc_id = 7").collect()}
    assert odd[None, None].n_words == 0 and odd[None, None].base_failed and odd[8, None].n_removed_words == 0
    plain = df.where("source = 'a'")
    counts = lambda table, name: sorted((r.doc_id, *[x for k, x in r[name].asDict().items() if k != "clean_text"]) for r in table.collect())
    assert counts(line_frequency.verdicts(plain, max_percent=50), "_quality") == counts(line_frequency.judge(plain, max_percent=50), "_quality")
    assert line_frequency.verdicts(df.limit(0)).count() == 0
