"""Training order: token sequences at permuted slots in binary shards of fixed stride.

Documents are tokenised and strung together in fixed-length sequences. A keyed Feistel network permutes
the sequence numbers 0 .. N-1 (values outside are walked on until they fall inside), which gives each
sequence a global slot without sorting by random numbers. Ranges of slots are written as shards.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkgauge.llm.text import mix
from linkgauge.llm.tokens import worker_tokens
from linkgauge.session import materialize

LENGTH = 2048
END_ID = 49407  # between documents, and to fill the last sequence of a block
SHARD_ROWS = 1024
KEY = 0x5EED
ROUNDS = 6


def feistel(numbers: np.ndarray, size: int, key: int = KEY) -> np.ndarray:
    """A permutation of 0 .. size-1 applied to ``numbers``: balanced Feistel with cycle-walking."""
    half = max(1, (max(1, size - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)

    def once(values: np.ndarray) -> np.ndarray:
        left, right = values >> np.uint64(half), values & mask
        for turn in range(ROUNDS):
            salt = np.uint64((key * 0x9E3779B97F4A7C15 + turn * 0xC2B2AE3D27D4EB4F) % 2**64)
            left, right = right, left ^ (mix(right ^ salt) & mask)
        return left << np.uint64(half) | right

    out = once(numbers.astype(np.uint64))
    outside = np.flatnonzero(out >= size)
    while len(outside):
        out[outside] = once(out[outside])
        outside = outside[out[outside] >= size]
    return out.astype(np.int64)


def sequences(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID, key: str = "doc_id", text: str = "text") -> DataFrame:
    """block, number (in the block), tokens, doc_ids, ids (compressed unsigned 16-bit): a row a sequence.

    A block is an input partition; a task holds one batch and one open sequence. Every document ends with
    ``end_id``; a null or empty text is that id alone. doc_ids lists the documents with ids in the
    sequence, in order.
    """
    names = ["block", "number", "tokens", "doc_ids", "ids"]
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, block, number = worker_tokens(tokenizer), TaskContext.get().partitionId(), 0
        shrink, full = zstandard.ZstdCompressor(level=3), 4 * length
        end = int(end_id).to_bytes(4, "little")
        rows: list[tuple] = []
        open_ids, open_docs = bytearray(), []

        def close() -> None:
            nonlocal number, open_ids, open_docs
            tokens = len(open_ids) // 4
            ids = np.frombuffer(bytes(open_ids) + end * (length - tokens), "<u4")
            if ids.max() > 0xFFFF:
                raise ValueError("ids of this vocabulary don't fit 16 bits")
            rows.append((block, number, tokens, open_docs, shrink.compress(ids.astype("<u2").tobytes())))
            number, open_ids, open_docs = number + 1, bytearray(), []

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
            rows.clear()
            return out

        for batch in batches:
            for doc, value in zip(batch["key"].to_pylist(), batch["text"], strict=True):
                ids, at = encode(value.as_py()) + end, 0
                while at < len(ids):
                    part = ids[at : at + full - len(open_ids)]
                    open_ids += part
                    open_docs.append(doc)
                    at += len(part)
                    if len(open_ids) == full:
                        close()
                if len(rows) >= 500:
                    yield flush()
        if open_ids:
            close()
        if rows:
            yield flush()

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "block int, number long, tokens int, doc_ids array<long>, ids binary")


def with_slots(rows: DataFrame, key: int = KEY) -> tuple[DataFrame, int]:
    """``rows`` (stored: they are read twice) with slot long, and their number N."""
    counts = sorted((r.block, r.n) for r in rows.groupBy("block").agg(F.count(F.lit(1)).alias("n")).collect())  # one row for each block
    firsts = np.cumsum([0, *(n for _, n in counts)])
    total = int(firsts[-1])
    # two numbers for each block, that is, for each input partition
    starts = rows.sparkSession.sparkContext.broadcast((np.array([b for b, _ in counts]), firsts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, first = starts.value
        for batch in batches:
            numbers = first[np.searchsorted(blocks, batch["block"].to_numpy())] + batch["number"].to_numpy()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(feistel(numbers, total, key))], names=[*batch.schema.names, "slot"])

    return rows.select("block", "number", "tokens", "doc_ids", "ids").mapInArrow(run, "block int, number long, tokens int, doc_ids array<long>, ids binary, slot long"), total


def write_shards(slotted: DataFrame, total: int, path: str, length: int = LENGTH, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Writes ``path``/shard-*.bin when run; gives slot, shard, byte_offset, tokens, ids_crc32, doc_ids, block, number.

    A partition holds a range of whole shards in slot order and streams them. A shard is written under a
    task's own name and renamed, so a repeated task replaces it by the same bytes. ``path`` must be seen by
    all executors.
    """
    stride, shards = 2 * length, -(-total // shard_rows)
    names = ["slot", "shard", "byte_offset", "tokens", "ids_crc32", "doc_ids", "block", "number"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        task, expand = TaskContext.get().taskAttemptId(), zstandard.ZstdDecompressor()
        shard, out, name = -1, None, ""

        def finish() -> None:
            if out is not None:
                out.close()
                store.move(name, f"{root}/shard-{shard:08d}.bin")

        for batch in batches:
            slots, checks = batch["slot"].to_numpy(), []
            for slot, payload in zip(slots.tolist(), batch["ids"], strict=True):
                if slot // shard_rows != shard:
                    finish()
                    shard = slot // shard_rows
                    name = f"{root}/_part-{shard:08d}-{task}"
                    out = store.open_output_stream(name)
                ids = expand.decompress(payload.as_py())
                out.write(ids)
                checks.append(zlib.crc32(ids))
            yield pa.RecordBatch.from_arrays(
                [batch["slot"], pa.array((slots // shard_rows).astype(np.int64)), pa.array(slots % shard_rows * stride), batch["tokens"],
                 pa.array(checks, pa.int64()), batch["doc_ids"], batch["block"], batch["number"]], names=names)
        finish()

    ranged = slotted.withColumn("shard", F.floor(F.col("slot") / shard_rows)).repartitionByRange(max(1, -(-shards // 2)), "shard").sortWithinPartitions("slot")
    return ranged.drop("shard").mapInArrow(
        run, "slot long, shard long, byte_offset long, tokens int, ids_crc32 long, doc_ids array<long>, block int, number long")


def write_manifest(path: str, total: int, length: int = LENGTH, shard_rows: int = SHARD_ROWS, key: int = KEY) -> None:
    store, root = fs.FileSystem.from_uri(path)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(f"{root}/manifest.json") as out:
        out.write(json.dumps({"sequences": total, "length": length, "shard_rows": shard_rows, "key": key, "dtype": "<u2"}).encode())


def read_from(path: str, slot: int = 0) -> Iterator[tuple[int, np.ndarray]]:
    """(slot, ids) from a slot on: one seek in one shard, then sequential reads."""
    store, root = fs.FileSystem.from_uri(path)
    with store.open_input_stream(f"{root}/manifest.json") as given:
        about = json.loads(given.read())
    stride = 2 * about["length"]
    while slot < about["sequences"]:
        with store.open_input_file(f"{root}/shard-{slot // about['shard_rows']:08d}.bin") as shard:
            shard.seek(slot % about["shard_rows"] * stride)
            while row := shard.read(stride):
                yield slot, np.frombuffer(row, about["dtype"])
                slot += 1


def materialise(docs: DataFrame, tokenizer: str, path: str, length: int = LENGTH, end_id: int = END_ID, shard_rows: int = SHARD_ROWS,
                key: str = "doc_id", text: str = "text", order_key: int = KEY) -> DataFrame:
    """Writes all documents as shards and a manifest below ``path``; the table of slots comes back.

    Repeated rows and null keys are documents like others. An empty table writes a manifest of no
    sequences. Other columns are not read.
    """
    slotted, total = with_slots(materialize(sequences(docs, tokenizer, length, end_id, key, text), "sequences"), order_key)
    report = materialize(write_shards(slotted, total, path, length, shard_rows), "slots")
    write_manifest(path, total, length, shard_rows, order_key)
    return report
