"""The registered queries on the smallest tables: contracts, SQL, and the pipeline stage by stage."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from catalog.check import TABLES, compare
from linkgauge.llm import latent_leaks, prefix_join, queries

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    text, good = compare(spark, con, name, queries.QUERIES[name], queries.SQL[name], SMALL)
    assert good, text


@pytest.mark.parametrize("name,columns", [
    ("op3_grouped_prefix_join", "doc_id bigint, n_shingles bigint, component_id bigint"),
    ("op5_text_blocks", "page_id bigint, url string, text string, n_chars bigint"),
    ("op7_best_fit_packing", "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"),
    ("op9_communication_matrix", "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int"),
    ("op10_url_trees", "page_id bigint, host string, path string, rule string, verdict string"),
])
def test_columns(spark, name, columns):
    out = queries.QUERIES[name](spark, SMALL)
    assert set(columns.split(", ")) <= {f"{n} {t}" for n, t in out.dtypes}
    table = "pages" if name in ("op5_text_blocks", "op10_url_trees") else "documents"
    given = spark.read.parquet(f"{SMALL}/{table}.parquet").count()
    assert out.count() == given or name == "op7_best_fit_packing" and out.where("piece = 0").count() == given


def test_pipeline(spark):
    """Each stage keeps the columns of documents and does what its operator says, and nothing else."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near copies", "decontamination", "best-fit packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SMALL).cache()
        assert kept.columns == docs.columns and kept.join(docs, "doc_id", "left_anti").count() == 0
        assert kept.where(F.col("n_chars") != F.length("text")).count() == 0
        docs = kept
    assert docs.select("doc_id").distinct().count() == docs.count() > 100
    linked = prefix_join.near_duplicates(docs)
    assert linked.where("n_shingles > 0").groupBy("component_id").count().where("count > 1").count() == 0
    assert latent_leaks.leaks(docs, spark.read.parquet(f"{SMALL}/benchmark.parquet")).count() == 0
    placed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert placed.select("doc_id").distinct().count() == docs.count()


def test_stages_take_odd_rows_and_empty_tables(spark):
    rows = [(1, None, None, None, None, "x"), (1, None, None, None, None, "x"), (None, "word " * 80, "en", "a", 400, None), (2, "", "en", "a", 0, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, quality string")
    for given in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, given, SMALL).collect()
