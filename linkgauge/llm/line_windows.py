"""Line dedup by overlapping windows of lines.

Every run of three consecutive lines is hashed. The first occurrence of a window in the corpus (by
document, then position) stays; all lines that a later occurrence covers go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkgauge.llm.text import WHITE, spare_name
from linkgauge.session import materialize

WIDTH = 3


def content_lines(text: Column) -> Column:
    """Lines with a word, as structs of place among all lines (from 0) and trimmed text."""
    at = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line, i: F.struct(i.alias("at"), F.btrim(line, F.lit(WHITE)).alias("line")))
    return F.filter(at, lambda x: F.length(F.translate(x["line"], WHITE, "")) > 0)


def windows(docs: DataFrame, row: list[str], text: str, width: int) -> DataFrame:
    """row columns, first (place of the window's first line), places, h1, h2: a row for each window."""

    def each(lines: Column) -> Column:
        starts = F.when(F.size(lines) >= width, F.sequence(F.lit(0), F.size(lines) - width))
        def one(i: Column) -> Column:
            parts = [F.get(lines, i + k)["line"] for k in range(width)]
            return F.struct(F.get(lines, i)["at"].alias("first"), F.transform(F.slice(lines, i + 1, F.lit(width)), lambda x: x["at"]).alias("places"),
                            F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit(7), *parts).alias("h2"))
        return F.transform(starts, one)

    found = F.transform(F.array(content_lines(F.col(text))), each)[0]
    return docs.select(*row, F.explode(found).alias("w")).select(*row, "w.*")


def covered_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """key, text hash and the places of lines to remove, for each row that loses lines.

    Rows are ordered by key (nulls last), then by text hash. Fully equal rows (same key and text)
    share one identity: the windows of the first of them count once, so they all keep the same lines.
    """
    th = [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(7), F.col(text)).alias("t2")]
    rows = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), *th, F.col(text).alias("text"))
    place = ["k", "t1", "t2"]
    # equal windows of one document collapse to their first place, so what is shuffled is small
    found = windows(rows, place, "text", width)
    order = F.struct(F.col("k").isNull().alias("n"), "k", "t1", "t2", "first")
    firsts = (
        found.groupBy("h1", "h2").agg(F.min(order).alias("head"), F.max(order).alias("tail"))
        .where(F.col("head") != F.col("tail"))
        .select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), "head")
    )
    later = found.join(firsts, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2"))).where(order != F.col("head"))
    # a document has a bounded number of lines; the places of one document meet in one row
    return later.groupBy(*place).agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """Every row of ``docs`` with ``text`` without the repeated lines, and n_removed_lines (long).

    Lines are compared without white space at their ends; lines without a word take no part and stay.
    Null and empty texts, and texts with fewer than ``width`` lines, stay as they are. Rows with equal
    key and text are one document. Extra columns stay, whatever their names.
    """
    name = spare_name(docs, "n_removed_lines")
    gone = materialize(covered_lines(docs, key, text, width), "lines").select(
        F.col("k").alias("__k"), F.col("t1").alias("__1"), F.col("t2").alias("__2"), F.col("places").alias("__p"))
    same = (F.col(key).eqNullSafe(F.col("__k")) & (F.xxhash64(text) == F.col("__1")) & (F.xxhash64(F.lit(7), F.col(text)) == F.col("__2")))
    # a join by shuffle at every size: what is sent of the texts grows with them alone
    joined = docs.join(gone.hint("merge"), same, "left")
    # hash-based difference of places: long texts cost their length
    lines = F.split(F.col(text), "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__p"))
    kept = F.transform(F.array(lines), lambda all_lines: F.transform(left, lambda i: F.get(all_lines, i)))[0]
    columns = [F.when(F.col("__p").isNull(), F.col(c)).otherwise(F.array_join(kept, "\n")).alias(c) if c == text else F.col(c) for c in docs.columns]
    return joined.select(*columns, F.coalesce(F.size("__p"), F.lit(0)).cast("long").alias(name))
