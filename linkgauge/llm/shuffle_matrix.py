"""A uniform shuffle into shards of exact size by a hypergeometric communication matrix.

How many rows each source block sends to each shard is drawn first, exactly as a uniform permutation
would deal them (multivariate hypergeometric, so blocks and shards add up). Each block permutes its
rows and sends the drawn numbers, each shard permutes what it got.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkgauge.session import materialize

SEED = 20240229
GROUP = 512  # blocks of a group: the driver draws groups, tasks draw the blocks of a group
CELL_ROWS = 20_000  # aimed rows of a cell in which a shard is permuted


def shard_sizes(rows: int, shards: int) -> list[int]:
    """Counts at most one apart."""
    return [rows // shards + (i < rows % shards) for i in range(shards)]


def draw(counts: list[int], sizes: list[int], seed: list[int]) -> np.ndarray:
    """counts x sizes integers with these row and column sums, as a uniform permutation deals them."""
    random, left = np.random.Generator(np.random.Philox(np.random.SeedSequence(seed))), np.array(sizes, dtype=np.int64)
    matrix = np.zeros((len(counts), len(sizes)), dtype=np.int64)
    for i, n in enumerate(counts):
        # the numbers a permutation gives block i, from what the blocks before it left over
        rest, need = int(left.sum()), int(n)
        for j, room in enumerate(left):
            matrix[i, j] = _hypergeometric(random, int(room), rest - int(room), need)
            rest, need = rest - int(room), need - int(matrix[i, j])
        left -= matrix[i]
    return matrix


def _hypergeometric(random: np.random.Generator, good: int, bad: int, n: int) -> int:
    """numpy draws up to 1e9 rows a side, larger ones are drawn by inversion: both follow the law exactly."""
    if n == 0 or good == 0:
        return 0
    if bad == 0:
        return n
    if good + bad < 1_000_000_000:
        return int(random.hypergeometric(good, bad, n))
    return _by_inversion(random, good, bad, n)


def _by_inversion(random: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Chances relative to the likeliest number, by the ratio of neighbours, over all that a 53-bit uniform can meet."""
    total = good + bad
    mode = (n + 1) * (good + 1) // (total + 2)
    width = 50 + int(12 * (n * (good / total) * (bad / total) * ((total - n) / max(1, total - 1))) ** 0.5)
    low, high = max(0, n - bad, mode - width), min(good, n, mode + width)
    k = np.arange(low, high, dtype=np.float64)
    steps = np.log((good - k) * (n - k) / ((k + 1) * (bad - n + k + 1)))
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    chances = np.cumsum(np.exp(logs - logs.max()))
    return low + min(int(np.searchsorted(chances, random.random() * chances[-1], side="right")), high - low)


def plan_exchange(blocks: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """From (block int, n long): block and ends, the running sum of rows it sends to each shard.

    The driver holds one row for each group of ``GROUP`` blocks and its share for each shard; the
    blocks of a group are drawn in one task. Both are numbers of blocks, not of rows.
    """
    spark = blocks.sparkSession
    grouped = blocks.withColumn("grp", F.floor(F.col("block") / GROUP).cast("long"))
    totals = grouped.groupBy("grp").agg(F.sum("n").alias("n")).orderBy("grp").collect()
    matrix = draw([r.n for r in totals], shard_sizes(sum(r.n for r in totals), shards), [seed])
    rows = [(int(r.grp), [int(x) for x in matrix[i]]) for i, r in enumerate(totals)]
    share = spark.createDataFrame(rows, "grp long, share array<long>")

    def blocks_of(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("block")
        drawn = draw(part["n"].tolist(), list(part["share"].iloc[0]), [seed, int(part["grp"].iloc[0])])
        return pd.DataFrame({"block": part["block"], "ends": list(drawn.cumsum(axis=1))})

    return grouped.join(share, "grp").groupBy("grp").applyInPandas(blocks_of, "block int, ends array<long>")


def shuffle_rows(df: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """Every row of ``df`` with shard (int) and slot (long, gapless from 0 within the shard).

    The rows are written once with their block and place, so a lost executor reads the same blocks
    again. The law holds whatever the rows are: nulls, repeated rows and hot keys are dealt like others,
    because only block and place count. An empty table gives no rows. Columns of ``df`` called shard or
    slot are replaced.
    """
    # block: the input partition; place: the number of the row in it
    number = F.monotonically_increasing_id()
    columns = [F.col(c) for c in df.columns if c.lower() not in ("shard", "slot")]
    dealt = materialize(df.select(*columns, F.shiftright(number, 33).cast("int").alias("__block"),
                                  number.bitwiseAND(F.lit((1 << 33) - 1)).alias("__place")), "blocks")
    key = [F.col("__block"), F.col("__place")]
    blocks = materialize(dealt.groupBy(F.col("__block").alias("block")).agg(F.count(F.lit(1)).alias("n")), "block_sizes")
    ends = materialize(plan_exchange(blocks, shards, seed), "matrix")
    total = blocks.agg(F.sum("n")).first()[0] or 0
    # permute within the block, and give the first rows to shard 0, the next to shard 1, ...
    local = dealt.withColumn("__rank", F.row_number().over(_by("__block", F.xxhash64(F.lit(seed), *key), *key)) - 1)
    placed = (
        local.join(ends.withColumnRenamed("block", "__b"), F.col("__block") == F.col("__b"))
        .withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("__rank"))).cast("int"))
        .drop("ends", "__b", "__rank")
    )
    # permute within the shard: order by a second keyed hash, in cells that bounded tasks can sort
    cells = max(1, round(total / shards / CELL_ROWS))
    again = F.xxhash64(F.lit(seed + 1), *key)
    placed = placed.withColumn("__again", again).withColumn("__cell", F.floor((F.shiftright("__again", 33) + (1 << 30)) * cells / (1 << 31)).cast("int"))
    sizes = placed.groupBy("shard", "__cell").agg(F.count(F.lit(1)).alias("n"))
    # one row for each cell; cells of a shard meet in one window
    before = sizes.select(F.col("shard").alias("__s"), F.col("__cell").alias("__c"), (F.sum("n").over(_by("shard", "__cell")) - F.col("n")).alias("__before"))
    inside = placed.withColumn("__rank", F.row_number().over(_by(["shard", "__cell"], F.col("__again"), *key)) - 1)
    return (
        inside.join(before, (F.col("shard") == F.col("__s")) & (F.col("__cell") == F.col("__c")))
        .withColumn("slot", (F.col("__before") + F.col("__rank")).cast("long"))
        .select(*columns, "shard", "slot")
    )


def _by(keys, *order):
    from pyspark.sql import Window

    return Window.partitionBy(*([keys] if isinstance(keys, str) else keys)).orderBy(*order)


def write_shards(shuffled: DataFrame, path: str) -> None:
    """One folder for each shard, rows in slot order within files."""
    shuffled.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def read_in_order(spark, path: str, shard: int) -> Iterator:
    """Rows of a shard by slot, without holding the shard."""
    return spark.read.parquet(path).where(F.col("shard") == shard).orderBy("slot").toLocalIterator()
