"""The registered queries agree with their SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from catalog import load
from catalog.check import TABLES, compare

SMALL = "/root/testdata/sf0.001"
QUERIES, ORACLES = load()


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def test_other_queries_have_tests_of_their_own():
    """Without SQL there is a named test or a green relative: no query goes unheld."""
    assert set(QUERIES) - set(ORACLES) == {
        "paired_compare", "linear_model", "benchmark_models", "kernel_model", "forest_importances", "loss_classifiers",
        "discover_files"}


@pytest.fixture(scope="module")
def connection():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SMALL):
        pytest.skip("no tables")
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, connection, name):
    text, good = compare(spark, connection, name, QUERIES[name], ORACLES[name], SMALL)
    assert good, text


def test_entry_has_rows(spark):
    if os.path.isdir(SMALL):
        df = entry.entry(spark)
        assert df.count() == 13 and df.columns[:3] == ["slice_type", "slice_value", "rows"]
