"""Mixing sources to target weights by systematic sampling.

Every source gets a target share of all words. A document's expected copies are its source's target over
the source's size; they are summed up within the source, one random offset is added, and a document is taken
once for each whole number that the sum crosses at it. Everything is DataFrame functions; no Python runs on
executors.

Documents stand in the order of their size, so a source misses its target by the size of one document at most:
equally spaced points of a monotone function differ from its mean by no more than its largest value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkgauge.llm.text import spare_name
from linkgauge.operators.joining import null_safe_join
from linkgauge.operators.ordering import part_offsets, range_positions
from linkgauge.session import materialize

# Production weights by the sources' order, and how often a document may be taken
WEIGHTS = (5, 2, 1)
MOST = 3
SEED = 1


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+``; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def source_targets(docs: DataFrame, source: str, size: str, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target (double): one row for each source, null being one.

    Sources in code-point order, null last, take the weights in turn and share the sum of all sizes by them. A
    target stops at ``most`` times its source's size; what is above is shared again by the weights of the others,
    until none is above. Each round is one aggregate of the source table; sums of whole numbers are exact.
    """
    sizes = materialize(docs.groupBy(F.col(source).alias("source")).agg(F.coalesce(F.sum(size), F.lit(0)).alias("source_size")), "sources")
    placed = range_positions(sizes, F.col("source").asc_nulls_last())
    rank = F.col("_before") + F.col("_place") - F.col("_first")
    weight = F.get(F.array([F.lit(w) for w in weights]), F.pmod(rank, F.lit(len(weights))).cast("int"))
    wide = lambda c: c.cast("decimal(38,0)")
    cap = most * F.col("source_size")
    table = materialize(placed.join(part_offsets(placed, []), "_part").select("source", "source_size", weight.alias("weight"), cap.alias("cap")), "sources")
    total = table.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    left, shares, capped = total, None, F.lit(False)
    while True:
        full, found = table.agg(F.coalesce(F.sum(F.when(capped, F.col("cap"))), F.lit(0)), F.sum(F.when(~capped, F.col("weight")))).first()
        if shares == found:
            break
        left, shares = total - full, found
        capped = F.lit(False) if not found else wide(F.col("cap")) * found < wide(F.lit(left)) * F.col("weight")
    # wide: a literal of under 2^31 words is an int, and its product with the weight need not be one
    share = (wide(F.lit(left)) * F.col("weight")).cast("double") / F.lit(float(shares or 1))
    return table.select("source", "source_size", F.when(capped, F.col("cap").cast("double")).otherwise(share).alias("target"))


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", size: str = "size", weights: tuple[int, ...] = WEIGHTS,
        most: int = MOST, seed: int = SEED) -> DataFrame:
    """Every row of ``docs`` with a struct column ``mix``: source_size, target, copies, taken (copies times size).

    ``size`` is a column of whole numbers, null being 0. Copies never exceed ``most``. The offset comes from seed
    and source, and rows have one order (size, key, then a hash of the other columns), so reruns agree; rows equal
    in all of them are interchangeable. Repeated rows each count. A null source is a source of its own, rows with
    null key take part, an empty table gives an empty result; a source without words has target 0. Other columns,
    whatever their names, stay. A hot source is cut by size and key, so no task holds it.
    """
    name = spare_name(docs, "mix")
    plain = [c for c, t in docs.dtypes if "map<" not in t and "variant" not in t]
    rows = materialize(docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(source).alias("source"),
        F.coalesce(F.col(size), F.lit(0)).cast("long").alias("size"), F.col(key).alias("key"),
        F.xxhash64(*[F.col(f"`{c}`") for c in plain]).alias("rest")), "sized")
    placed = range_positions(rows, F.col("source").asc_nulls_last(), F.col("size"), F.col("key"), F.col("rest"))
    targets = source_targets(rows, "source", "size", weights, most)
    # at most one row for each source and range: rows meet it by both, so a hot source is no hot key
    cells = materialize(null_safe_join(part_offsets(placed, ["source"]), targets, ["source"]), "cells")
    joined = null_safe_join(placed, cells, ["source", "_part"])
    # whole numbers of 2^-32 copies; the product of rank and step is split so that no long overflows before 2^44 rows
    step = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size")) * 2.0**32), F.lit(0)).cast("long")
    text = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("source").cast("string"), F.lit("")))
    offset = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
    at = F.col("_before") + F.col("_place") - F.col("_first")

    def crossed(rank: Column) -> Column:
        low = F.shiftright(rank * F.col("step").bitwiseAND(F.lit(0xFFFF)) + F.col("offset"), 16)
        return F.shiftright(rank * F.shiftright("step", 16) + low, 16)

    told = joined.select("row", "size", "source_size", "target", step.alias("step"), offset.alias("offset"), at.alias("at"))
    copies = crossed(F.col("at") + 1) - crossed(F.col("at"))
    return told.select("row", F.struct("source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")).alias("m")).select(
        "row.*", F.col("m").alias(name))


def emit(mixed: DataFrame, column: str = "mix") -> DataFrame:
    """The mix itself: each row of ``mix`` once for each of its copies, numbered from 1 in ``copy``."""
    number = F.explode(F.sequence(F.lit(1), F.col(column)["copies"].cast("int")))
    return mixed.where(F.col(column)["copies"] > 0).select("*", number.alias(spare_name(mixed, "copy")))
