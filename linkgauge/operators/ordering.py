"""Exact global ranks, samples, folds and percentiles without one task seeing a whole group.

A group (a file, a class, a label) may hold a third of all rows, so nothing here sorts a group in
one window partition. Rows are first put into many ordered buckets, the buckets are counted, and
only the inside of a bucket is sorted; the bucket's offset makes the local rank global.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkgauge.operators.joining import null_safe_join
from linkgauge.session import materialize

HASH_SPACE = 2.0**32
# aimed rows of a bucket, which one task sorts
BUCKET_ROWS = 20_000
# cells of one power of two in a first histogram, and of a cell that is cut again
OCTAVE_CELLS = 64
CELLS = 1024


def hash_key(seed: int, *columns: str) -> Column:
    """A reproducible pseudo-random text key of a row's identity."""
    parts = [F.col(c).cast("string") for c in columns]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))


def hash_unit(key: Column) -> Column:
    """The first 32 bits of a hash key as a number in [0, 1)."""
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / HASH_SPACE


def _running(window_columns: list[str], order: str):
    return Window.partitionBy(*(window_columns or [F.lit(0)])).orderBy(order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )


def hash_digits(df: DataFrame) -> int:
    """Leading hex digits of a hash that cut ``df`` into buckets of about ``BUCKET_ROWS`` rows; one count job."""
    return max(1, math.ceil(math.log(max(2, df.count() / BUCKET_ROWS), 16)))


def hash_buckets(df: DataFrame, key: str, by: list[str], prefix: int) -> DataFrame:
    """Rows per (group, leading hash digits) with the number of rows of the group before it.

    At most 16**prefix rows per group come out, however many rows go in.
    """
    counts = df.groupBy(*by, F.substring(key, 1, prefix).alias("_bucket")).agg(F.count("*").alias("_rows"))
    before = F.sum("_rows").over(_running(by, "_bucket")) - F.col("_rows")
    return counts.withColumn("_before", before)


def hash_rank(df: DataFrame, key: str, by: list[str] | None = None, prefix: int | None = None, name: str = "rank") -> DataFrame:
    """Exact 1-based rank of each row in hash order, per group; NULL is a group.

    Without ``prefix`` the number of buckets follows the number of rows. The bucket table is written first: joined
    by broadcast when it is small, the rows are shuffled once, for the ranks.
    """
    by, prefix = by or [], prefix or hash_digits(df)
    buckets = materialize(hash_buckets(df, key, by, prefix).drop("_rows"), "buckets")
    inside = Window.partitionBy(*by, "_bucket").orderBy(key)
    return (
        null_safe_join(df.withColumn("_bucket", F.substring(key, 1, prefix)), buckets, [*by, "_bucket"])
        .withColumn(name, F.col("_before") + F.row_number().over(inside))
        .drop("_bucket", "_before")
    )


def hash_take(df: DataFrame, key: str, quota: Column, by: list[str] | None = None, prefix: int | None = None) -> DataFrame:
    """The first ``quota`` rows of each group in hash order; NULL is a group.

    Buckets after the quota are dropped by the join, before any row is sorted. The bucket table is
    written first: Spark then knows its true size and filters by broadcast when it is small, so
    rows that are not wanted are not even shuffled.
    """
    by, prefix = by or [], prefix or hash_digits(df)
    counted = materialize(hash_buckets(df, key, by, prefix), "buckets")
    wanted = counted.filter(F.col("_before") < quota).drop("_rows")
    inside = Window.partitionBy(*by, "_bucket").orderBy(key)
    return (
        null_safe_join(df.withColumn("_bucket", F.substring(key, 1, prefix)), wanted, [*by, "_bucket"])
        .withColumn("_rank", F.col("_before") + F.row_number().over(inside))
        .filter(F.col("_rank") <= quota)
        .drop("_bucket", "_before", "_rank")
    )


def range_positions(df: DataFrame, *order: Column, part: str = "_part", place: str = "_place") -> DataFrame:
    """``df`` written in order: ``part`` numbers ascending ranges, ``place`` counts rows (from 0) inside one.

    Spark samples the order and cuts ranges of about equal size, so a hot value is split wherever the columns
    after it differ. ``df`` is read twice; give it written.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = ranged.select(
        "*", F.spark_partition_id().alias(part), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias(place))
    return materialize(numbered, "ranges")


def part_offsets(placed: DataFrame, by: list[str], part: str = "_part", place: str = "_place") -> DataFrame:
    """``by``, part, _first (place of the group's first row in that part), _before (its rows in earlier parts).

    One row for each group and part it has rows in: at most groups plus parts. A row's rank in its group, from 0,
    is ``_before + place - _first``.
    """
    cells = placed.groupBy(*by, part).agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = F.sum("_rows").over(_running(by, part)) - F.col("_rows")
    return cells.withColumn("_before", before).drop("_rows")


def order_code(value: Column) -> Column:
    """A number that never decreases with a double and spreads all magnitudes evenly: sign and binary logarithm.

    Like the leading bits of a double it tells sign, exponent and the first digits apart; unlike them it is a built-in
    function. Infinities get the ends.
    """
    size = F.least(F.greatest(F.log2(F.abs(value)) + 1100, F.lit(1.0)), F.lit(2300.0))
    return F.when(value == 0, F.lit(0.0)).otherwise(F.signum(value) * size)


def exact_percentiles(
    df: DataFrame, keys: list[str], value: str, wanted: dict[str, float], cell_rows: int = BUCKET_ROWS
) -> DataFrame:
    """Exact percentiles with linear interpolation, one row per group.

    A radix histogram: rows are counted by (group, leading digits of the value's order code), running counts tell
    in which cell a wanted rank falls, and only rows of those cells are read on. A cell of more than ``cell_rows``
    rows and several values is cut into ``CELLS`` equal ranges, until none is left; a few rounds do, because each
    narrows a cell a thousandfold. Cuts are per group, and no cut point or count passes through the driver.
    """
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    rows = rows.withColumn("_cell", F.floor(order_code(F.col("_v")) * OCTAVE_CELLS))
    totals = ["_c", "_lo", "_hi"]
    facts = [F.count("*").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")]

    def position(p: float) -> Column:
        return (F.col("_n") - 1) * F.lit(float(p))

    def holds(rank: Column) -> Column:
        return (rank >= F.col("_before")) & (rank < F.col("_before") + F.col("_c"))

    needed = F.lit(False)
    for p in wanted.values():
        needed = needed | holds(F.floor(position(p))) | holds(F.ceil(position(p)))

    def found_in(rows: DataFrame, cells: DataFrame, by: list[str], name: str) -> DataFrame:
        """The rows of the needed cells, each with its cell's id."""
        return materialize(null_safe_join(rows, cells.select(*by, "_id"), by).select("_id", "_v"), name)

    counts = rows.groupBy(*keys, "_cell").agg(*facts).select(
        *keys, "_cell", *totals, F.sum("_c").over(Window.partitionBy(*(keys or [F.lit(0)]))).alias("_n"),
        (F.sum("_c").over(_running(keys, "_cell")) - F.col("_c")).alias("_before"))
    # written first, so that Spark knows its true size and can filter without a shuffle when it is small
    cells = materialize(counts.filter(needed).withColumn("_id", F.monotonically_increasing_id().cast("string")), "cells")
    values = found_in(rows, cells, [*keys, "_cell"], "found")
    cells = cells.drop("_cell")
    wide = (F.col("_c") > cell_rows) & (F.col("_lo") < F.col("_hi"))
    while not cells.filter(wide).isEmpty():
        ranges = cells.filter(wide).select("_id", "_lo", F.greatest(F.col("_hi") - F.col("_lo"), F.lit(5e-324)).alias("_width"))
        place = F.least(F.floor((F.col("_v") - F.col("_lo")) / F.col("_width") * CELLS), F.lit(CELLS - 1))
        inside = values.join(ranges, "_id").select("_id", "_v", place.alias("_cell"))
        parents = cells.filter(wide).select(*keys, "_id", "_n", F.col("_before").alias("_start"))
        finer = inside.groupBy("_id", "_cell").agg(*facts).withColumn("_before", F.sum("_c").over(_running(["_id"], "_cell")) - F.col("_c"))
        finer = finer.join(parents, "_id").withColumn("_before", F.col("_before") + F.col("_start")).filter(needed).select(
            *keys, *totals, "_n", "_before", F.col("_id").alias("_parent"), "_cell")
        finer = materialize(finer.withColumn("_id", F.concat_ws(".", "_parent", F.col("_cell").cast("string"))), "cells")
        narrowed = found_in(inside.withColumnRenamed("_id", "_parent"), finer, ["_parent", "_cell"], "found")
        values = values.join(cells.filter(~wide).select("_id"), "_id", "left_semi").unionByName(narrowed)
        cells = materialize(cells.filter(~wide).unionByName(finer.drop("_parent", "_cell")), "cells")
    upto = Window.partitionBy("_id").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = values.groupBy("_id", "_v").agg(F.count("*").alias("_k")).withColumn("_last", F.sum("_k").over(upto))
    ranked = ranked.join(cells.select(*keys, "_id", "_n", "_before"), "_id").withColumns({
        "_first": F.col("_before") + F.col("_last") - F.col("_k"), "_last": F.col("_before") + F.col("_last")})

    def at(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("_first")) & (rank < F.col("_last")), F.col("_v")))

    result = []
    for name, p in wanted.items():
        low, high = at(F.floor(position(p))), at(F.ceil(position(p)))
        part = F.max(position(p) - F.floor(position(p)))
        result.append(F.when(low == high, low).otherwise(low + (high - low) * part).alias(name))
    return ranked.groupBy(*keys).agg(*result)
