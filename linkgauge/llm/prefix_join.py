"""Near duplicates: an exact set-similarity join on word shingles by grouped prefixes.

Shingles get one order: those that few documents share first (see ``frequent_shingles``), each part by
hash. Two sets can reach the similarity only if their prefixes in this order share a shingle. Documents
with equal prefix and size form one group; groups, not documents, are joined and filtered by size and
position, and what is left is expanded to members, filtered by histograms of the whole sets (an upper
bound of the overlap), and verified on whole sets.

Components need no pair of documents that are known to be connected. So a first round links each member
of a shared prefix shingle to the least changed of them; only pairs across the components that are then left
are joined. Every link between different components is still found and verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkgauge.llm.components import components
from linkgauge.llm.text import WHITE, shingle_sets, text_key
from linkgauge.session import materialize

WORDS = 5
PERCENT = 80
# How the order treats common shingles; it moves work, never results
COMMON_DOCS = 3
COMMON_KEPT = 500_000
# open shingles of a set that tell at which one a pair meets; it moves work, never results
EARLIER = 8


def needed(n: int, percent: int) -> int:
    """Least overlap of a set of ``n`` with any set it is linked to."""
    return -(-percent * n // 100)


def several_times(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values that come more than once, and how often."""
    values = np.sort(values)
    same = np.concatenate([[False], values[1:] == values[:-1], [False]])
    first, last = np.flatnonzero(~same[:-1] & same[1:]), np.flatnonzero(same[:-1] & ~same[1:])
    return values[first], last - first + 1


class Listed:
    """Which hashes stand in a sorted list; most others are told by their first bits, without a search."""

    BITS = 23

    def __init__(self, values: np.ndarray):
        self.values, self.shift = values, np.uint64(64 - self.BITS)
        self.cells = np.zeros(1 << self.BITS, bool)
        self.cells[values >> self.shift] = True

    def has(self, found: np.ndarray) -> np.ndarray:
        there = self.cells[found >> self.shift]
        at = np.flatnonzero(there)
        if len(at):
            there[at] = self.values[np.minimum(np.searchsorted(self.values, found[at]), len(self.values) - 1)] == found[at]
        return there


def frequent_shingles(docs: DataFrame, text: str, size: int) -> np.ndarray:
    """Sorted hashes of the most common shingles: at most ``COMMON_KEPT``, so they can be broadcast.

    All documents count. Tasks send the shingles that several documents of an Arrow batch share, so the
    counts are lower bounds. They only decide which shingles stand last in the order: any order finds
    the same links.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, counts = several_times(np.concatenate([*shingle_sets(batch["text"], size), np.zeros(0, np.uint64)]))
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(counts)], names=["h", "n"])

    counted = docs.select(F.col(text).alias("text")).mapInArrow(run, "h long, n long")
    often = materialize(counted.groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON_DOCS), "common")
    # the least count that leaves no more than COMMON_KEPT: no task and no sort sees more than that many
    steps = Window.partitionBy(F.lit(0)).orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)
    kept = often.groupBy("n").agg(F.count(F.lit(1)).alias("k")).withColumn("k", F.sum("k").over(steps)).where(F.col("k") <= COMMON_KEPT)
    least = kept.agg(F.min("n")).first()[0]
    top = often.where(F.lit(False) if least is None else F.col("n") >= least)
    return np.sort(top.select("h").toArrow()["h"].to_numpy().astype(np.int64).view(np.uint64))


def histogram(found: np.ndarray) -> bytes:
    """How many shingles of a set fall into each of 2^k cells of two to four on average; empty: unknown."""
    cells = 1 << max(3, len(found).bit_length() - 2)
    counts = np.bincount((found & np.uint64(cells - 1)).astype(np.int64), minlength=cells)
    return counts.astype(np.uint8).tobytes() if len(found) and counts.max() < 256 else b""


def most_common(x: bytes, y: bytes) -> int:
    """An upper bound of the overlap of two sets, from their histograms; a finer one is folded."""
    a, b = np.frombuffer(x, np.uint8).astype(np.int64), np.frombuffer(y, np.uint8).astype(np.int64)
    if not len(a) or not len(b):
        return 1 << 60
    cells = min(len(a), len(b))
    return int(np.minimum(a.reshape(-1, cells).sum(axis=0), b.reshape(-1, cells).sum(axis=0)).sum())


def prefixes(docs: DataFrame, key: str, text: str, size: int, percent: int) -> DataFrame:
    """doc_id, t1, t2 (text hashes), n, cid (128-bit hash of the set), gid (of prefix and size), prefix, cells (histogram) for each row."""
    common = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, text, size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = Listed(common.value)
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for found in shingle_sets(batch["text"], size):
                n = len(found)
                late = listed.has(found)
                ordered = np.concatenate([found[~late], found[late]])
                head = ordered[: n - needed(n, percent) + 1] if n else ordered
                rows[0].append(n)
                rows[1].append(blake2b(found.tobytes(), digest_size=16).digest())
                rows[2].append(blake2b(head.tobytes() + n.to_bytes(8, "little"), digest_size=16).digest())
                rows[3].append(head.view(np.int64))
                rows[4].append(histogram(found))
            lengths = np.cumsum([0, *map(len, rows[3])])
            flat = np.concatenate([*rows[3], np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["t1"], batch["t2"], pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.binary()), pa.array(rows[2], pa.binary()),
                 pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(flat)), pa.array(rows[4], pa.binary())],
                names=["doc_id", "t1", "t2", "n", "cid", "gid", "prefix", "cells"])

    t1, t2, _ = text_key(text)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), t1.alias("t1"), t2.alias("t2"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, t1 long, t2 long, n long, cid binary, gid binary, prefix array<long>, cells binary")


def whole_sets(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """cid, hashes: the set of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                sets = shingle_sets(batch["text"].slice(start, 1000), size)
                lengths = np.cumsum([0, *map(len, sets)])
                flat = np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                     pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(flat))], names=["cid", "hashes"])

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "cid binary, hashes array<long>")


def _can_link(na: Column, pa_: Column, nb: Column, pb: Column, percent: int) -> Column:
    """Size and position filters for the first shingle that two ordered sets share, at places pa_ and pb (from 0).

    No shingle before it is common, so what stands behind it bounds the overlap. Linked sets pass at
    their first common shingle; that they may fail at later ones costs nothing.
    """
    most = 1 + F.least(na - 1 - pa_, nb - 1 - pb)
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (100 * most >= percent * (na + nb - most))


def verified(pairs: DataFrame, members: DataFrame, docs: DataFrame, key: str, text: str, size: int, percent: int) -> DataFrame:
    """The (a, b) of ``pairs`` whose whole sets reach the similarity.

    Whole sets are built again from the texts, only for what the histograms leave.
    """
    cells = members.select("cid", "n", "cells").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch["na"].to_numpy(), batch["nb"].to_numpy()
            most = np.array([most_common(x.as_py(), y.as_py()) for x, y in zip(batch["ca"], batch["cb"], strict=True)], dtype=np.int64)
            most = np.minimum(most, np.minimum(na, nb))
            yield batch.select(["a", "b"]).filter(pa.array(100 * most >= percent * (na + nb - most)))

    ends = [cells.select(F.col("cid").alias(x), F.col("n").alias(f"n{x}"), F.col("cells").alias(f"c{x}")) for x in ("a", "b")]
    left = materialize(pairs.select("a", "b").distinct().join(ends[0], "a").join(ends[1], "b").mapInArrow(run, "a binary, b binary"), "pairs")
    if left.isEmpty():
        return left
    needed_sets = materialize(left.select(F.col("a").alias("cid")).unionAll(left.select("b")).distinct(), "needed")
    ids = members.join(needed_sets, "cid", "left_semi").select(F.col("doc_id").alias("__id")).distinct()
    texts = docs.join(ids, F.col(key).cast("long").eqNullSafe(F.col("__id")), "left_semi")
    found = whole_sets(texts, key, text, size).join(needed_sets, "cid", "left_semi").dropDuplicates(["cid"])
    sets = materialize(found, "sets")
    same = F.size(F.array_intersect("ha", "hb"))
    return (
        left.join(sets.select(F.col("cid").alias("a"), F.col("hashes").alias("ha")), "a")
        .join(sets.select(F.col("cid").alias("b"), F.col("hashes").alias("hb")), "b")
        .select("a", "b", same.alias("same"), (F.size("ha") + F.size("hb") - same).alias("all"))
        .where(100 * F.col("same") >= percent * F.col("all")).select("a", "b")
    )


class _Parts:
    """The component of each candidate set, as far as links are known."""

    def __init__(self, members: DataFrame):
        self.now = members.select("cid", F.col("cid").alias("comp")).distinct()

    def add(self, links: DataFrame) -> bool:
        """Join components by verified links (a, b) of cids; False if there are none."""
        if links.isEmpty():
            return False
        now = self.now
        ends = links
        for c in ("a", "b"):
            ends = ends.join(now.select(F.col("cid").alias(c), F.col("comp").alias(f"comp_{c}")), c)
        found = components(ends.select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b")))
        self.now = materialize(now.join(found, now["comp"] == found["node"], "left").select("cid", F.coalesce("component", "comp").alias("comp")), "parts")
        return True


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id: one row for each row of ``docs``.

    Sets are linked when ``100 * common >= percent * all``. class_id is the smallest doc_id with the same
    set, component_id the smallest doc_id reachable by links. Rows with null key take part; an id that only
    nulls could give is null. Null, empty and word-free texts have the empty set, are linked with nothing
    and stand for themselves. Repeated rows each stay. Other columns are not read.
    """
    return _labelled_rows(docs, key, text, size, percent).select("doc_id", "n_shingles", "component_id", "class_id")


def _labelled_rows(docs: DataFrame, key: str, text: str, size: int, percent: int) -> DataFrame:
    """The columns of ``near_duplicates``, t1, t2, and chosen: whether the row stands for its component."""
    rows = materialize(prefixes(docs, key, text, size, percent), "prefixes")
    full = rows.where(F.col("n") > 0)
    g64 = F.xxhash64("gid").alias("g")
    shared = materialize(_shared_shingles(full), "shared")
    # members: the different sets of groups that share a shingle, or that hold several sets
    many = full.groupBy(g64).agg(F.min("cid").alias("low"), F.max("cid").alias("high")).where("low != high").select("g")
    wanted = materialize(shared.select("g").unionAll(many).distinct(), "groups")
    members = full.select(g64, "n", "cid", "doc_id", "cells").join(wanted, "g", "left_semi")
    members = materialize(members.groupBy("g", "n", "cid").agg(F.min("doc_id").alias("doc_id"), F.first("cells").alias("cells")), "members")
    check = lambda pairs: materialize(verified(pairs, members, docs, key, text, size, percent), "links")

    heads = members.groupBy("g").agg(F.min("cid").alias("head"))
    inside = members.join(heads, "g").where(F.col("cid") != F.col("head")).select(F.col("head").alias("a"), F.col("cid").alias("b"))
    named = [heads.select(F.col("g").alias(x), F.col("head").alias(h)) for x, h in (("x", "a"), ("y", "b"))]
    stars = _star_pairs(shared, percent).join(named[0], "x").join(named[1], "y").select("a", "b")
    parts = _Parts(members)
    parts.add(check(stars.unionAll(inside)))
    parts.add(check(_left_over(shared, members, parts.now, percent)))
    return _labelled(rows, parts.now)


def _shared_shingles(full: DataFrame) -> DataFrame:
    """g, n, pos, token: the prefix shingles of each group, where several groups have them; others link nothing."""
    # gid tells n; as a key n is in both uses of the groups, which so are one shuffle
    groups = full.groupBy("gid", "n").agg(F.first("prefix").alias("prefix"))
    postings = groups.select(F.xxhash64("gid").alias("g"), "n", F.posexplode("prefix").alias("pos", "token"))
    # a group has a shingle once, and a count is shorter than two ids
    several = postings.groupBy("token").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("token")
    return postings.join(several, "token", "left_semi")


def _star_pairs(shared: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, y) of groups: one for each shared shingle, and each other that has it.

    The one is where the shingle stands first: what stands before a common shingle are mostly changes that no
    other document has, so it is the least changed copy, which most of the others are linked to.
    """
    drawn = shared.groupBy("token").agg(F.min(F.struct("pos", F.xxhash64("token", "g").alias("h"), "g", "n")).alias("d"))
    drawn = drawn.select("token", F.col("d.g").alias("dg"), F.col("d.n").alias("dn"), F.col("d.pos").alias("dpos"))
    hits = shared.join(drawn, "token").where((F.col("g") != F.col("dg")) & _can_link(F.col("n"), F.col("pos"), F.col("dn"), F.col("dpos"), percent))
    return hits.select(F.least("g", "dg").alias("x"), F.greatest("g", "dg").alias("y")).distinct()


def _reach(n: Column, pos: Column, percent: int) -> Column:
    """The largest set that a set of ``n``, whose first common shingle is at ``pos``, can be linked to."""
    return F.floor((100 + percent) * (n - pos) / percent) - n


def _open_rows(shared: DataFrame, spans: DataFrame, percent: int) -> DataFrame:
    """The rows (token, g, n, pos, part) that may still link to another component at their token, with ``reach`` and ``main``.

    A row stays if another component has a row at the token that is small enough for it and reaches it. That
    needs no pair of rows: the least size and the largest reach of each (token, component), and of all other
    components, tell. ``main`` is the component with most rows at the token.
    """
    rows = shared.join(spans, "g").withColumn("reach", _reach(F.col("n"), F.col("pos"), percent))
    # most shingles are in one component by now
    mixed = rows.groupBy("token").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low != high").select("token")
    rows = materialize(rows.join(mixed, "token", "left_semi"), "mixed")
    cells = rows.groupBy("token", "part").agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("least"), F.max("reach").alias("most"))
    cells = materialize(cells, "cells")
    first = cells.groupBy("token").agg(
        F.min(F.struct("least", "part")).alias("a"), F.max(F.struct("most", "part")).alias("b"), F.max(F.struct("k", "part")).alias("m"))
    others = cells.join(first, "token").groupBy("token").agg(
        F.min(F.when(F.col("part") != F.col("a.part"), F.col("least"))).alias("second_least"),
        F.max(F.when(F.col("part") != F.col("b.part"), F.col("most"))).alias("second_most")).where(F.col("second_least").isNotNull())
    facts = first.join(others, "token").select(
        "token", F.col("a.least").alias("least"), F.col("a.part").alias("least_part"), F.col("b.most").alias("most"), F.col("b.part").alias("most_part"),
        "second_least", "second_most", F.col("m.part").alias("main"))
    least = F.when(F.col("part") == F.col("least_part"), F.col("second_least")).otherwise(F.col("least"))
    most = F.when(F.col("part") == F.col("most_part"), F.col("second_most")).otherwise(F.col("most"))
    return materialize(rows.join(facts, "token").where((least <= F.col("reach")) & (most >= F.col("n"))).select(
        "token", "g", "n", "pos", "part", "reach", "main"), "open")


def _left_over(shared: DataFrame, members: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """Member pairs of group pairs that pass the filters and aren't known to be connected.

    Rows of a token's largest component never meet each other, only the other rows meet it; and a pair meets at
    its first common shingle, as far as the first ``EARLIER`` open shingles of both tell.
    """
    placed = materialize(members.join(parts, "cid").select("g", "cid", F.xxhash64("comp").alias("comp")), "placed")
    both = placed.groupBy("g").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
    # a group with members in several components is a part of its own
    spans = both.select("g", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.xxhash64("g", "low")).alias("part"))
    rows = _open_rows(shared, spans, percent)
    firsts = rows.groupBy("g").agg(F.slice(F.sort_array(F.collect_list(F.struct("pos", "token"))), 1, EARLIER).alias("firsts"))
    earlier = F.transform(F.filter("firsts", lambda x: x["pos"] < F.col("pos")), lambda x: x["token"])
    told = materialize(rows.join(firsts, "g").select("token", "g", "n", "pos", "part", "reach", "main", earlier.alias("earlier")), "open")
    columns = ("g", "n", "part", "reach", "earlier")
    x = told.where(F.col("part") != F.col("main")).select("token", "main", *[F.col(c).alias(f"x{c}") for c in columns])
    y = told.select("token", *[F.col(c).alias(f"y{c}") for c in columns])
    # a pair outside the main component meets once, by the order of its groups
    once = (F.col("ypart") == F.col("main")) | (F.col("xg") < F.col("yg"))
    fits = (F.col("yn") <= F.col("xreach")) & (F.col("xn") <= F.col("yreach")) & (100 * F.least("xn", "yn") >= percent * F.greatest("xn", "yn"))
    met = x.join(y, "token").where((F.col("xpart") != F.col("ypart")) & once & fits & ~F.arrays_overlap("xearlier", "yearlier"))
    pairs = met.select(F.least("xg", "yg").alias("x"), F.greatest("xg", "yg").alias("y")).distinct()
    same = both.where(F.col("low") != F.col("high")).select(F.col("g").alias("x"), F.col("g").alias("y"))
    first = placed.toDF("x", "a", "comp_a")
    second = placed.toDF("y", "b", "comp_b")
    return pairs.unionAll(same).join(first, "x").join(second, "y").where("comp_a != comp_b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _labelled(rows: DataFrame, parts: DataFrame) -> DataFrame:
    known = rows.select("doc_id", "t1", "t2", "n", "cid").join(parts, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    full = known.where(F.col("n") > 0)
    # ids may be null or repeat, so a row is known by id and text
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "t1", "t2")
    classes = full.groupBy("cid", "comp").agg(F.min("doc_id").alias("class_id"), F.min(row).alias("least"))
    whole = classes.groupBy("comp").agg(F.min("class_id").alias("component_id"), F.min("least").alias("least"))
    ids = classes.drop("least").join(whole, "comp").select(F.col("cid").alias("c"), "class_id", "component_id", "least")
    empty = F.col("n") == 0
    return known.join(ids, (F.col("cid") == F.col("c")) & ~empty, "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(empty, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(empty, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        "t1", "t2", (empty | row.eqNullSafe(F.col("least"))).alias("chosen"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each component of near duplicates: the one whose key is its id.

    Of several texts with that key the one with the smallest hash stays, of several rows with that key and equal
    text one; where a component has null keys alone, its smallest text hash stays. Rows without words all stay.
    """
    found = materialize(_labelled_rows(docs, key, text, size, percent).select("doc_id", "n_shingles", "t1", "t2", "chosen"), "components")
    gone = found.where(~F.col("chosen")).select(F.col("doc_id").alias("__id"), F.col("t1").alias("__1"), F.col("t2").alias("__2")).distinct()
    t1, t2, _ = text_key(text)
    # a join by shuffle at every size: what is sent of the texts grows with them alone
    kept = docs.join(gone.hint("merge"), F.col(key).cast("long").eqNullSafe(F.col("__id")) & (t1 == F.col("__1")) & (t2 == F.col("__2")), "left_anti")
    # texts move a second time only where rows repeat
    if found.where("n_shingles > 0 AND chosen").groupBy("doc_id", "t1", "t2").count().where("count > 1").isEmpty():
        return kept
    # equal rows are merged before they are sent, rows without words have a number each
    worded = F.length(F.translate(text, WHITE, "")) > 0
    told = kept.withColumns({"__k": F.col(key).cast("long"), "__1": t1, "__2": t2, "__n": F.when(worded, -1).otherwise(F.monotonically_increasing_id())})
    return told.dropDuplicates(["__k", "__1", "__2", "__n"]).drop("__k", "__1", "__2", "__n")
