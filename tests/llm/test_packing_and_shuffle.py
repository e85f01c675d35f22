import random
import zlib
from collections import Counter, defaultdict
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkgauge.llm import packing, shuffle_matrix, training_order
from linkgauge.llm.tokens import TokenBytes, default_tokenizer


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_piece_once(seed):
    draw = random.Random(seed)
    counts = {draw.randint(1, 64): draw.randint(1, 40) for _ in range(30)}
    taken, ranks = defaultdict(list), defaultdict(list)
    for length, rank, count, first, at in packing.plan(counts, 64):
        ranks[length] += range(rank, rank + count)
        for i in range(count):
            taken[first + i].append((at, length))
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in counts.items()}
    for parts in taken.values():
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at <= 64
    # best-fit decreasing one piece at a time needs as many sequences
    rooms = []
    for length in sorted(Counter(counts).elements(), reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= length]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= length
        else:
            rooms.append(64 - length)
    assert len(taken) == len(rooms)


def test_pack(spark):
    texts = ["one two three " * 1500, "short", None, "", "short", "été " * 5, "a " * 5000]
    docs = spark.createDataFrame([(i if i != 4 else None, t, "x", 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, piece string, offset int, row int")
    packed = packing.pack(docs, default_tokenizer(), with_ids=True).cache()
    encode, rows = TokenBytes(default_tokenizer()), defaultdict(list)
    for r in packed.collect():
        rows[r.doc_id].append(r)
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length <= 8192
    for i, t in enumerate(texts):
        parts = sorted(rows[i if i != 4 else None], key=lambda r: r.piece)
        assert b"".join(bytes(p.ids) for p in parts) == encode(t) + bytes(4)
        assert [p.start for p in parts] == [2048 * k for k in range(len(parts))]
    whole = {r.sequence_id: bytes(r.ids) for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        assert whole[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)] == bytes(r.ids)
    assert sum(map(len, whole.values())) == 4 * packed.agg(F.sum("length")).first()[0]
    assert packing.pack(docs.limit(0), default_tokenizer()).count() == 0


def test_matrix_sums():
    matrix = shuffle_matrix.draw([10, 0, 7, 100], shuffle_matrix.shard_sizes(117, 8), [1])
    assert matrix.sum(axis=1).tolist() == [10, 0, 7, 100] and matrix.sum(axis=0).tolist() == shuffle_matrix.shard_sizes(117, 8)


def test_matrix_law():
    """Counts of a cell follow the hypergeometric law: mean and variance over many draws."""
    cells = np.array([shuffle_matrix.draw([30, 20, 10], [20, 20, 20], [s])[0, 0] for s in range(2000)])
    mean, variance = 30 * 20 / 60, 30 * (20 / 60) * (40 / 60) * (30 / 59)
    assert abs(cells.mean() - mean) < 0.2 and abs(cells.var() - variance) < 0.4


def test_large_numbers_add_up():
    matrix = shuffle_matrix.draw([3 * 10**9, 10**9], [2 * 10**9, 2 * 10**9], [3])
    assert matrix.sum(axis=1).tolist() == [3 * 10**9, 10**9] and matrix.sum(axis=0).tolist() == [2 * 10**9] * 2
    assert abs(matrix[0, 0] - 1.5 * 10**9) < 10**6


def test_shuffle(spark):
    docs = spark.range(1003).select((F.col("id") % 7).alias("doc_id"), F.lit("same").alias("text"), F.lit(5).alias("slot"), F.lit(None).cast("string").alias("block")).repartition(5)
    out = shuffle_matrix.shuffle_rows(docs, 8)
    assert sorted(out.columns) == ["block", "doc_id", "shard", "slot", "text"]
    slots = defaultdict(list)
    for r in out.collect():
        slots[r.shard].append(r.slot)
    assert sorted(map(len, slots.values())) == sorted(shuffle_matrix.shard_sizes(1003, 8))
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert Counter(r.doc_id for r in out.collect()) == Counter(i % 7 for i in range(1003))
    assert shuffle_matrix.shuffle_rows(docs.limit(0), 8).count() == 0
    assert shuffle_matrix.shuffle_rows(docs.limit(3), 8).count() == 3


def test_slots_are_uniform(spark):
    """Where a row goes does not depend on where it was: shards and slot halves are even over seeds."""
    docs = spark.range(64).repartition(3)
    hits = Counter()
    for seed in range(12):
        for r in shuffle_matrix.shuffle_rows(docs, 4, seed).collect():
            hits[r.shard, r.slot // 8, r.id // 32] += 1
    assert all(25 < n < 75 for n in hits.values())


@pytest.mark.parametrize("size", [1, 2, 3, 5, 64, 100, 1023, 5000])
def test_feistel_is_a_permutation(size):
    out = training_order.feistel(np.arange(size), size)
    assert sorted(out.tolist()) == list(range(size))
    if size > 100:
        assert (training_order.feistel(np.arange(size), size, 2) != out).mean() > 0.9 and abs(np.corrcoef(np.arange(size), out)[0, 1]) < 0.1


def test_shards_round_trip(spark, tmp_path):
    texts = ["one two three " * 300, None, "", "x", "été " * 50] * 6
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, ids string").repartition(3).cache()
    path = str(tmp_path / "shards")
    report = training_order.materialise(docs, default_tokenizer(), path, length=64, shard_rows=10).collect()
    got = dict(training_order.read_from(path))
    assert sorted(got) == list(range(len(report))) == sorted(r.slot for r in report)
    for r in report:
        assert zlib.crc32(got[r.slot].tobytes()) == r.ids_crc32 and (r.shard, r.byte_offset) == (r.slot // 10, r.slot % 10 * 128)
    assert [s for s, _ in training_order.read_from(path, 13)] == list(range(13, len(report)))
    # the sequences of a block, in order, are its documents
    ids = [int(x) for r in sorted(report, key=lambda r: (r.block, r.number)) for x in got[r.slot][: r.tokens]]
    encode = TokenBytes(default_tokenizer())
    pieces = Counter(tuple(np.frombuffer(encode(t), "<u4").tolist()) for t in texts)
    parts, open_part = Counter(), []
    for x in ids:
        if x == training_order.END_ID:
            parts[tuple(open_part)] += 1
            open_part = []
        else:
            open_part.append(x)
    assert parts == pieces and not open_part
    empty = str(tmp_path / "none")
    assert training_order.materialise(docs.limit(0), default_tokenizer(), empty).count() == 0 and list(training_order.read_from(empty)) == []


def test_large_draws_follow_the_law():
    """Inversion agrees with the law at small sizes, and huge draws need no normal."""
    class Uniform:
        def random(self):
            return self.at

    draw = Uniform()
    for good, bad, n in ((7, 9, 5), (3, 20, 21), (40, 2, 30)):
        seen = []
        for draw.at in (np.arange(20_000) + 0.5) / 20_000:
            seen.append(shuffle_matrix._by_inversion(draw, good, bad, n))
        for k in range(n + 1):
            assert abs(seen.count(k) / 20_000 - comb(good, k) * comb(bad, n - k) / comb(good + bad, n)) < 2e-4
    draw.at = 0.5
    assert abs(shuffle_matrix._hypergeometric(draw, 2_000_000_000, 6_000_000_000, 4_000_000_000) - 1_000_000_000) < 10
