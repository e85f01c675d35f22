"""Prefix trie of conversations on minimal-perfect-hash node tables.

A node is a distinct sequence of first turns, known by a 128-bit digest. Digests are sums of turn hashes times
powers of an odd base, so they can be summed over ranges of a long conversation, shifted and cut: no task needs a
whole conversation. Nodes are enumerated by one aggregate. Nodes of one conversation alone have a closed form. The
others are cut into units, subtrees whose nodes have about as many members; units are dealt over shards, and a
shard puts its digests into a minimal perfect hash table: each gets a slot whose digest is compared at every
lookup, counts are scattered into flat arrays by slot, and sums run through the array of parent slots from the
deepest level up. Units of few members come first; what their tops gathered is added to the units above.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkgauge.llm.text import mix
from linkgauge.session import materialize

FAMILY = 5  # a conversation starts like the one whose id is the next lower multiple
MOST_SHARED = 8
# members of the nodes of the lowest units, and the factor from one kind of unit to the next
UNIT = 4096
SHARD_NODES = 200_000
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
INVERSES = tuple(np.uint64(pow(int(b), -1, 1 << 64)) for b in BASES)
KEY = ["depth", "d1", "d2"]
EMPTY = sha256(b"").hexdigest()


def power(base: np.uint64, exponents: np.ndarray) -> np.ndarray:
    """base ** exponents modulo 2^64."""
    out, left, square = np.ones(len(exponents), dtype=np.uint64), exponents.astype(np.int64).copy(), np.array([base], dtype=np.uint64)
    while left.any():
        out = np.where(left & 1, out * square, out)
        square, left = square * square, left >> 1
    return out


def _unsigned(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


class NodeTable:
    """A minimal perfect hash of distinct (depth, d1, d2): slots 0 to n - 1, compared with the keys at every lookup.

    Level by level, keys that hash to a place of their own take it; the rest go to the next level. A place's slot
    is the number of taken places before it.
    """

    def __init__(self, depth: np.ndarray, d1: np.ndarray, d2: np.ndarray):
        self.levels: list[tuple[np.ndarray, int]] = []
        rest, before = np.arange(len(d1)), 0
        while len(rest):
            if len(self.levels) > 200:
                raise ValueError("equal keys in a node table")
            places = max(2, 2 * len(rest))
            at = self._place(depth[rest], d1[rest], d2[rest], len(self.levels), places)
            taken = np.bincount(at, minlength=places) == 1
            self.levels.append((np.where(taken, np.cumsum(taken) - 1 + before, -1), places))
            before += int(taken.sum())
            rest = rest[~taken[at]]
        self.keys = [np.zeros(before, dtype=x.dtype) for x in (depth, d1, d2)]
        slots = self._find(depth, d1, d2)
        for kept, given in zip(self.keys, (depth, d1, d2), strict=True):
            kept[slots] = given

    @staticmethod
    def _place(depth: np.ndarray, d1: np.ndarray, d2: np.ndarray, level: int, places: int) -> np.ndarray:
        odd = np.uint64((2 * level + 1) * 0x165667B19E3779F9 & 0xFFFFFFFFFFFFFFFF | 1)
        return (mix(mix(d1 + odd) ^ d2 * odd + depth.astype(np.uint64)) % np.uint64(places)).astype(np.int64)

    def _find(self, depth: np.ndarray, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
        slots, rest = np.full(len(d1), -1, dtype=np.int64), np.arange(len(d1))
        for level, (numbers, places) in enumerate(self.levels):
            found = numbers[self._place(depth[rest], d1[rest], d2[rest], level, places)]
            slots[rest] = found
            rest = rest[found < 0]
        return slots

    def slots(self, depth: np.ndarray, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for keys that are not in the table."""
        found = self._find(depth, d1, d2)
        safe = np.maximum(found, 0)
        same = (found >= 0) & (len(self.keys[0]) > 0)
        for kept, given in zip(self.keys, (depth, d1, d2), strict=True):
            same &= kept[safe] == given if len(kept) else False
        return np.where(same, found, -1)


def own_prefixes(turns: DataFrame) -> DataFrame:
    """conv, rank (from 1), t1, t2, bytes, p1, p2 of (conv, turn, t1, t2, bytes): sums of turn hashes times powers.

    Rows are sorted by conversation and turn in ranges of about equal size, so a very long conversation is dealt
    over tasks. A task sums inside its range; what a conversation that goes on brings along is one row a range.
    """
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("t1"), F.col("t2")]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, count, carried = None, 0, [np.uint64(0), np.uint64(0)]
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch["conv"].to_numpy()
            starts = np.concatenate([[True], conv[1:] != conv[:-1]])
            first = np.maximum.accumulate(np.where(starts, np.arange(len(conv)), 0))
            rank = np.arange(len(conv)) - first + 1
            goes_on = (first == 0) & (conv[0] == last)
            rank = rank + np.where(goes_on, count, 0)
            out = []
            for i, name in enumerate(("t1", "t2")):
                terms = _unsigned(batch[name]) * power(BASES[i], rank)
                total = np.cumsum(terms, dtype=np.uint64)
                inside = total - (total - terms)[first]
                out.append(inside + np.where(goes_on, carried[i], np.uint64(0)))
                carried[i] = out[i][-1]
            last, count = conv[-1], int(rank[-1])
            yield pa.RecordBatch.from_arrays(
                [batch["conv"], batch["part"], pa.array(rank), batch["t1"], batch["t2"], batch["bytes"], _signed(out[0]), _signed(out[1])],
                names=["conv", "part", "rank", "t1", "t2", "bytes", "p1", "p2"])

    ranged = turns.repartitionByRange(*order).sortWithinPartitions(*order)
    local = materialize(ranged.select("conv", F.spark_partition_id().alias("part"), "t1", "t2", "bytes").mapInArrow(
        sums, "conv long, part int, rank long, t1 long, t2 long, bytes long, p1 long, p2 long"), "prefixes")
    ends = local.groupBy("part").agg(
        F.min("conv").alias("first"), F.max("conv").alias("last"), F.max_by(F.struct("rank", "p1", "p2"), F.struct("conv", "rank")).alias("end")).collect()
    carry, open_conv, at = {}, None, (0, 0, 0)
    for row in sorted(ends, key=lambda r: r["part"]):  # one row for each range
        here = (row["end"]["rank"], row["end"]["p1"], row["end"]["p2"])
        if row["first"] == open_conv:
            carry[row["part"]] = (open_conv, *at)
            if row["last"] == open_conv:
                moved = [(int(p) + pow(int(b), at[0], 1 << 64) * int(q)) % (1 << 64) for p, b, q in zip(at[1:], BASES, here[1:], strict=True)]
                here = (at[0] + here[0], *moved)
        open_conv, at = row["last"], here
    if not carry:
        return local.drop("part")

    def shifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, conv, rank = batch["part"].to_numpy(), batch["conv"].to_numpy(), batch["rank"].to_numpy().copy()
            p = [_unsigned(batch["p1"]).copy(), _unsigned(batch["p2"]).copy()]
            for number in np.unique(part):
                if int(number) in carry:
                    of, count, *before = carry[int(number)]
                    rows = (part == number) & (conv == of)
                    for i in (0, 1):
                        p[i][rows] = p[i][rows] * power(BASES[i], np.array([count])) + np.uint64(before[i] % (1 << 64))
                    rank[rows] += count
            yield pa.RecordBatch.from_arrays(
                [batch["conv"], pa.array(rank), batch["t1"], batch["t2"], batch["bytes"], _signed(p[0]), _signed(p[1])],
                names=["conv", "rank", "t1", "t2", "bytes", "p1", "p2"])

    return materialize(local.mapInArrow(shifted, "conv long, rank long, t1 long, t2 long, bytes long, p1 long, p2 long"), "prefixes")


def rebuilt_paths(own: DataFrame, family: int = FAMILY, most: int = MOST_SHARED) -> DataFrame:
    """conv, depth, d1, d2 (digest), u1, u2 (the parent's), bytes (of the last text), last: a row for each
    rebuilt conversation and depth, depth 0 included.

    Of the shared conversation only the first ``most`` turns are gathered; own turns are shifted to their depth.
    """
    head = F.sort_array(F.collect_list(F.when(F.col("rank") <= most, F.struct("rank", "p1", "p2", "bytes"))))
    convs = materialize(own.groupBy("conv").agg(F.max("rank").alias("n"), head.alias("head")), "conversations")
    base = convs.select(F.col("conv").alias("b"), F.col("n").alias("bn"), F.col("head").alias("bhead"))
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % (most + 1)
    joined = convs.join(base, F.col("conv") - F.col("conv") % family == F.col("b"), "left").withColumn("h", h)
    joined = joined.withColumn("lb", F.least("h", F.coalesce("bn", F.lit(0))))
    at = lambda nodes, i, name: F.coalesce(F.get(nodes, (i - 1).cast("int"))[name], F.lit(0)).cast("long")
    plan = materialize(joined.select(
        "conv", "h", "lb", (F.col("lb") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"),
        F.slice(F.coalesce("bhead", F.array().cast("array<struct<rank:bigint,p1:bigint,p2:bigint,bytes:bigint>>")), F.lit(1), F.col("lb").cast("int")).alias("first"),
        *[at(F.col("bhead"), F.col("lb"), p).alias(f"s{p[1]}") for p in ("p1", "p2")],
        *[at(F.col("head"), F.col("h"), p).alias(f"k{p[1]}") for p in ("p1", "p2")]), "plans")
    zero = F.lit(0).cast("long")
    root = plan.select("conv", zero.alias("depth"), zero.alias("d1"), zero.alias("d2"), *[F.lit(None).cast("long").alias(u) for u in ("u1", "u2")],
                       zero.alias("bytes"), (F.col("length") == 0).alias("last"))
    each = F.transform("first", lambda x, i: F.struct(
        x["rank"].alias("depth"), x["p1"].alias("d1"), x["p2"].alias("d2"),
        *[F.when(i == 0, zero).otherwise(F.get("first", i - 1)[p]).alias(f"u{p[1]}") for p in ("p1", "p2")], x["bytes"].alias("bytes")))
    shared = plan.select("conv", "length", F.explode(each).alias("x")).select("conv", "x.*", (F.col("x.depth") == F.col("length")).alias("last"))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank, h, lb = (batch[c].to_numpy() for c in ("rank", "h", "lb"))
            depth = rank - h + lb
            columns = []
            for i in (0, 1):
                p, t, s, k = (_unsigned(batch[f"{c}{i + 1}"]) for c in "ptsk")
                digest = s + power(INVERSES[i], h - lb) * (p - k)
                columns += [_signed(digest), _signed(digest - t * power(BASES[i], depth))]
            yield pa.RecordBatch.from_arrays(
                [batch["conv"], pa.array(depth), columns[0], columns[2], columns[1], columns[3], batch["bytes"], pa.array(depth == batch["length"].to_numpy())],
                names=["conv", "depth", "d1", "d2", "u1", "u2", "bytes", "last"])

    rest = own.where(F.col("rank") > h).join(plan.drop("first"), "conv").select(
        "conv", "rank", "t1", "t2", "bytes", "p1", "p2", "h", "lb", "length", "s1", "s2", "k1", "k2").mapInArrow(
        placed, "conv long, depth long, d1 long, d2 long, u1 long, u2 long, bytes long, last boolean")
    columns = ["conv", *KEY, "u1", "u2", "bytes", "last"]
    return reduce(DataFrame.unionAll, [x.select(*columns) for x in (root, shared, rest)])


def end_hashes(paths: DataFrame) -> DataFrame:
    """depth, d1, d2, ends_sha256 of the nodes at which conversations end.

    Ids run through the hash in order, a batch at a time: a node's ids are never held together. SHA-256 has one
    order, so the ids of one node are one task's.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, done = None, None, []

        def out():
            return pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))],
                                              names=[*KEY, "ends_sha256"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch[c].to_numpy() for c in KEY]
            ids = batch["conv"].to_numpy()
            changes = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            for start, end in zip([0, *changes], [*changes, len(ids)], strict=True):
                key = tuple(int(k[start]) for k in keys)
                text = ",".join(map(str, ids[start:end].tolist())).encode()
                if key == now:
                    digest.update(b"," + text)
                else:
                    if now:
                        done.append((*now, digest.hexdigest()))
                    now, digest = key, sha256(text)
            if len(done) > 10_000:
                yield out()
                done.clear()
        if now:
            done.append((*now, digest.hexdigest()))
        yield out()

    ends = paths.where("last").select(*KEY, "conv").repartition(*KEY).sortWithinPartitions(*KEY, "conv")
    return ends.mapInArrow(run, "depth long, d1 long, d2 long, ends_sha256 string")


def _band(members: Column, unit: int, all_members: int) -> Column:
    """Which kind of unit a node is in: 0 for up to ``unit`` members, one more for each further factor of it."""
    steps, most = [], unit
    while most < all_members:
        steps.append((members > most).cast("int"))
        most *= unit
    return reduce(lambda a, b: a + b, steps, F.lit(0))


def unit_tops(shared: DataFrame) -> DataFrame:
    """``shared`` with the key (td, t1, t2) of the top of each node's unit: its highest ancestor of the same band.

    Pointers to parents are doubled, so rounds grow with the logarithm of a unit's depth.
    """
    own = F.col("ud").isNull() | (F.col("band") != F.col("uband"))
    now = materialize(shared.select(*KEY, *[F.when(own, F.col(c)).otherwise(F.col(u)).alias(t) for c, u, t in zip(KEY, ("ud", "u1", "u2"), ("td", "t1", "t2"), strict=True)]), "tops")
    while True:
        further = now.toDF("td", "t1", "t2", "nd", "n1", "n2")
        told = materialize(now.join(further, ["td", "t1", "t2"]).select(
            *KEY, F.col("nd").alias("td"), F.col("n1").alias("t1"), F.col("n2").alias("t2"),
            ((F.col("nd") != F.col("td")) | (F.col("n1") != F.col("t1")) | (F.col("n2") != F.col("t2"))).alias("moved")), "tops")
        now = told.drop("moved")
        if told.where("moved").isEmpty():
            return shared.join(now, KEY)


def _accumulate(table: pa.Table) -> pa.Table:
    """One shard: the sums over the subtrees of its units, through slots."""
    key = [table["depth"].to_numpy(), *[_unsigned(table[c].combine_chunks()) for c in ("d1", "d2")]]
    nodes = NodeTable(*key)
    slots = nodes.slots(*key)
    flat = lambda name: _scatter(slots, table[name].to_numpy())
    members, size, children, leaves, saved = (flat(c) for c in ("n", "bytes", "below_children", "below_leaves", "below_saved"))
    # a root has no parent; its own key stands in and is then cleared
    above = np.where(key[0] > 0, key[0] - 1, key[0])
    parents = nodes.slots(above, *[_unsigned(table[c].combine_chunks().fill_null(0)) for c in ("u1", "u2")])
    parent_slots = _scatter(slots, np.where(key[0] > 0, parents, -1))
    depth = _scatter(slots, key[0])
    order = np.argsort(-depth, kind="stable")
    for level in np.split(order, np.flatnonzero(np.diff(depth[order])) + 1) if len(order) else []:
        leaves[level] += children[level] == 0
        saved[level] += (members[level] - 1) * size[level]
        up = level[parent_slots[level] >= 0]
        for sums, more in ((children, 1), (leaves, leaves[up]), (saved, saved[up])):
            np.add.at(sums, parent_slots[up], more)
    result = table.select([*KEY, "conv", "parent_conv_id", "n", "u1", "u2", "top"])
    for name, values in (("n_children", children), ("n_leaves", leaves), ("saved_tokens", saved)):
        result = result.append_column(name, pa.array(values[slots]))
    return result


def _scatter(slots: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(slots), dtype=np.int64)
    out[slots] = values
    return out


def prefix_trie(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", unit: int = UNIT,
                shard_nodes: int = SHARD_NODES, family: int = FAMILY, most: int = MOST_SHARED) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: a row for each node.

    Turns go by their number, null first; turns of one number by the hash of role and text; repeated rows are
    turns each. Null role or text is empty text. Every conversation starts with the first turns of its family's (see
    ``rebuilt_paths``). Rows without a conversation id belong to no conversation; without any conversation there is
    no node. Other columns are not read.
    """
    parts = [F.coalesce(F.col(c), F.lit("")) for c in (role, text)]
    turns = materialize(conversations.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"), F.xxhash64(*parts).alias("t1"),
        F.xxhash64(F.lit(7), *parts).alias("t2"), F.octet_length(parts[1]).cast("long").alias("bytes")), "turns")
    paths = materialize(rebuilt_paths(own_prefixes(turns), family, most), "paths")
    nodes = materialize(paths.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n"), F.min("conv").alias("conv"), F.min("u1").alias("u1"), F.min("u2").alias("u2"), F.max("bytes").alias("bytes"),
        F.count_if("last").alias("n_ends")), "nodes")
    many = nodes.where("n > 1")
    total, n_shared = many.agg(F.coalesce(F.max("n"), F.lit(0)), F.count(F.lit(1))).first()
    above = many.select(F.col("depth").alias("ud"), F.col("d1").alias("u1"), F.col("d2").alias("u2"), F.col("conv").alias("parent_conv_id"), F.col("n").alias("un"))
    placed = materialize(nodes.withColumn("ud", F.col("depth") - 1).join(above, ["ud", "u1", "u2"], "left"), "placed")
    placed = placed.withColumn("ud", F.when(F.col("depth") > 0, F.col("ud")))

    # one conversation alone: its nodes are a path, below a shared node or the root
    single = placed.where("n = 1").select(
        *KEY, "conv", F.when(F.col("depth") > 0, F.coalesce("parent_conv_id", "conv")).alias("parent_conv_id"), "n",
        (1 - F.col("n_ends")).alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"))
    one = F.lit(1).cast("long")
    given = [placed.where("n = 1 AND un > 1").groupBy(F.col("ud").alias("depth"), F.col("u1").alias("d1"), F.col("u2").alias("d2")).agg(
        F.count(one).alias("below_children"), F.count(one).alias("below_leaves"), F.sum(F.lit(0)).alias("below_saved"))]

    shared = placed.where("n > 1").withColumns({"band": _band(F.col("n"), unit, total), "uband": _band(F.col("un"), unit, total)})
    topped = unit_tops(shared).withColumns({
        "top": (F.col("td") == F.col("depth")) & (F.col("t1") == F.col("d1")) & (F.col("t2") == F.col("d2")),
        "shard": F.pmod(F.xxhash64("td", "t1", "t2"), F.lit(max(1, -(-n_shared // shard_nodes))))})
    topped = materialize(topped, "units")
    schema = ("depth long, d1 long, d2 long, conv long, parent_conv_id long, n long, u1 long, u2 long, top boolean, "
              "n_children long, n_leaves long, saved_tokens long")
    done, band, reach = [], 0, 1
    while reach < total:
        below = reduce(DataFrame.unionAll, given).groupBy(*KEY).agg(*[F.sum(c).alias(c) for c in ("below_children", "below_leaves", "below_saved")])
        rows = topped.where(F.col("band") == band).join(below, KEY, "left").na.fill(0, ["below_children", "below_leaves", "below_saved"])
        sums = materialize(rows.groupBy("shard").applyInArrow(_accumulate, schema), "sums")
        done.append(sums)
        given.append(sums.where("top AND depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("u1").alias("d1"), F.col("u2").alias("d2")).agg(
            F.count(one).alias("below_children"), F.sum("n_leaves").alias("below_leaves"), F.sum("saved_tokens").alias("below_saved")))
        band, reach = band + 1, reach * unit
    every = reduce(DataFrame.unionAll, [x.select(single.columns) for x in [single, *done]])
    told = every.join(materialize(end_hashes(paths), "ends"), KEY, "left")
    return told.select(
        F.col("conv").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))
