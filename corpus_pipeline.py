"""From raw documents to packed training sequences: five stages, each written and read again.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkgauge.llm import latent_leaks, line_frequency, line_windows, packing, prefix_join
from linkgauge.llm.text import spare_name
from linkgauge.llm.tokens import default_tokenizer
from linkgauge.session import materialize


def _with_text(docs: DataFrame, columns: list[str], text, *more) -> DataFrame:
    """``columns`` with a new text and, where the table has it, the length that belongs to it; and ``more``."""
    changed = {"text": text} | ({"n_chars": F.length(text).cast("long")} if "n_chars" in columns else {})
    return docs.select([changed.get(c, F.col(c)).alias(c) for c in columns] + list(more))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without their boilerplate lines."""
    judged = line_frequency.judge(docs)
    verdict, kept = F.col(judged.columns[-1]), spare_name(docs, "kept")
    clean = _with_text(judged, docs.columns, verdict["clean_text"], verdict["kept"].alias(kept))
    # written before it is filtered: Catalyst would count every text again for each term of the condition
    return materialize(clean, "judged").where(kept).select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later occurrences of three-line windows; those that lose every word go."""
    left = line_windows.remove_repeats(docs)
    gone = (F.col(left.columns[-1]) > 0) & (F.length(F.translate("text", line_frequency.WHITE, "")) == 0)
    return _with_text(left.where(~gone), docs.columns, F.col("text"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates: five-word shingles, similarity of 0.8 or more."""
    return prefix_join.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item was found."""
    return latent_leaks.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of 2048 tokens."""
    return packing.pack(docs, default_tokenizer()).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("quality rules", quality), ("line dedup", line_dedup), ("near copies", near_copies), ("decontamination", decontaminate), ("best-fit packing", pack)]

# Tokens, near duplicates and latent semantics are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
