"""Best-fit packing planned on a histogram of lengths.

Documents are tokenised and cut into pieces of at most ``capacity`` tokens. Best-fit decreasing runs on
the counts of each length, not on pieces: its state is at most ``capacity`` lengths and runs of equally
filled sequences. Pieces then take the planned slots by their rank within their length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkgauge.llm.tokens import worker_tokens
from linkgauge.session import materialize

CAPACITY = 2048
RANK_ROWS = 20_000  # aimed rows of a cell in which pieces of one length are ranked


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, row (a number of the input row), piece, start, length, ids_crc32; with_ids adds ids (bytes).

    A document is the ids of its whole text and id 0 behind them; null or empty text is id 0 alone.
    Only documents longer than ``capacity`` are cut.
    """
    fields = [pa.field("key", pa.int64()), pa.field("row", pa.int64()), pa.field("piece", pa.int32()), pa.field("start", pa.int64()), pa.field("length", pa.int64()),
              pa.field("ids_crc32", pa.int64())] + [pa.field("ids", pa.binary())] * with_ids
    schema = pa.schema(fields)
    step = 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = worker_tokens(tokenizer)
        for batch in batches:
            out: list[list] = [[] for _ in fields]
            for doc, row, value in zip(batch["key"].to_pylist(), batch["row"].to_pylist(), batch["text"], strict=True):
                ids = encode(value.as_py()) + b"\0\0\0\0"
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    for column, x in zip(out, (doc, row, k, at // 4, len(part) // 4, zlib.crc32(part), part), strict=False):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, fields, strict=True)], schema=schema)

    rows = docs.select(F.col(key).cast("long").alias("key"), F.monotonically_increasing_id().alias("row"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "key long, row long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids).withColumnRenamed("key", "doc_id")


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: (length, first rank, count, first sequence, offset) runs.

    Pieces of a length with ranks first .. first + count - 1 go to consecutive sequences at one offset.
    Runs of sequences with equal room are kept by room; a length takes the least room that holds it.
    Each length splits one run and opens two at most, so the plan's size depends on ``capacity`` alone.
    """
    runs: list[tuple[int, int]] = []
    room: dict[int, list[tuple[int, int]]] = {}
    steps, sequences = [], 0

    def put(free: int, first: int, count: int) -> None:
        if free and count:
            if free not in room:
                room[free] = []
                insort(runs, free)
            room[free].append((first, count))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            i = bisect_left(runs, length)
            if i == len(runs):
                break
            free = runs[i]
            first, count = room[free].pop()
            if not room[free]:
                del room[free], runs[i]
            take = min(left, count)
            steps.append((length, rank, take, first, capacity - free))
            put(free, first + take, count - take)
            put(free - length, first, take)
            left, rank = left - take, rank + take
        if left:
            each = capacity // length
            whole, rest = divmod(left, each)
            for k in range(each if whole else 0):
                steps.append((length, rank, whole, sequences, k * length))
                rank += whole
            put(capacity - each * length, sequences, whole)
            for k in range(rest):
                steps.append((length, rank + k, 1, sequences + whole, k * length))
            put(capacity - rest * length, sequences + whole, 1 if rest else 0)
            sequences += whole + (rest > 0)
    return steps


def pack_pieces(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces (written: their rows are read several times) with sequence_id and offset.

    Ranks within a length are counted in cells of hashed rows, so a length that a third of all pieces
    share is ranked by many tasks.
    """
    spark = found.sparkSession
    lengths = found.groupBy("length").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r.length: r.n for r in lengths.collect()}  # at most ``capacity`` rows
    schema = "length long, first long, count long, sequence long, at long"
    steps = spark.createDataFrame(plan(histogram, capacity), schema).select([F.col(c).alias(f"p_{c}") for c in ("length", "first", "count", "sequence", "at")])
    cells = max(1, round(max(histogram.values(), default=0) / RANK_ROWS))
    celled = found.withColumn("cell", F.pmod(F.xxhash64("row", "piece"), F.lit(cells)).cast("int"))
    sizes = celled.groupBy("length", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("length", "cell", (F.sum("n").over(Window.partitionBy("length").orderBy("cell")) - F.col("n")).alias("before"))
    ranked = celled.withColumn("inside", F.row_number().over(Window.partitionBy("length", "cell").orderBy("row", "piece")) - 1)
    ranked = ranked.join(before, ["length", "cell"]).withColumn("rank", F.col("before") + F.col("inside"))
    # the plan's size is bounded by the capacity, see plan()
    fits = (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("p_first")) & (F.col("rank") < F.col("p_first") + F.col("p_count"))
    return ranked.join(F.broadcast(steps), fits).withColumns({
        "sequence_id": F.col("p_sequence") + F.col("rank") - F.col("p_first"), "offset": F.col("p_at")
    }).drop("cell", "inside", "before", "rank", *steps.columns)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, row, piece, start, length, ids_crc32 (and ids), sequence_id, offset: a row for each piece.

    Repeated rows and null keys are documents of their own, told apart by ``row``. An empty table packs
    into nothing. Other columns of ``docs`` are not read.
    """
    return pack_pieces(materialize(pieces(docs, tokenizer, capacity, key, text, with_ids), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids: the bytes of each packed sequence, from ``pack(..., with_ids=True)``."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))  # at most ``capacity`` pieces
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.aggregate("parts", F.lit(b""), lambda total, x: F.concat(total, x["ids"])).alias("ids"))
