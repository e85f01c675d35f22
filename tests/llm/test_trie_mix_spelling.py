"""The conversation trie, the source mix and spelling variants against brute force, on odd rows too."""

import os
import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkgauge.llm import mixing, prefix_trie, queries, spelling

TURNS = "conv_id long, turn long, role string, text string, n long, depth string"


@pytest.fixture
def many_ranges(spark):
    """Small tables in several ranges too."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def brute_trie(rows):
    convs, paths, nodes = defaultdict(list), {}, defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(turns, key=lambda x: x[:2])] for c, turns in convs.items()}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        paths[c] = own.get(c - c % 5, [])[:h] + own[c][h:]
        for d in range(len(paths[c]) + 1):
            nodes[tuple(paths[c][:d])].append(c)
    children, leaves, saved, out = Counter(), Counter(), Counter(), set()
    for key in sorted(nodes, key=len, reverse=True):
        leaves[key] += not children[key]
        saved[key] += (len(nodes[key]) - 1) * (len(key[-1][1].encode()) if key else 0)
        if key:
            for sums, more in ((children, 1), (leaves, leaves[key]), (saved, saved[key])):
                sums[key[:-1]] += more
    for key, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(paths[c]) == len(key))
        out.add((min(members), len(key), min(nodes[key[:-1]]) if key else None, len(members), children[key], leaves[key], saved[key], sha256(ends.encode()).hexdigest()))
    return out


def told(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(set(rows)) == len(rows)
    return set(rows)


def talks(seed, convs=60, roles=("user", "assistant", None)):
    """Conversations of few different turns, so that many share their first ones; some have none left, some are copies."""
    draw, rows = random.Random(seed), []
    for c in range(convs):
        if draw.random() < 0.15:
            continue
        for turn in range(draw.choice([1, 2, 3, 7, 12, 25])):
            rows.append((c, turn if turn else draw.choice([None, 0]), roles[turn % len(roles)], draw.choice(["", None, "ja", "néin", "ok"]) if turn > 2 else "hello", 1, "x"))
    return rows


@pytest.mark.parametrize("unit,shard_nodes", [(2, 3), (5, 40), (4096, 200_000)])
def test_trie_agrees_with_brute_force(spark, many_ranges, unit, shard_nodes):
    rows = talks(unit)
    got = told(prefix_trie.prefix_trie(spark.createDataFrame(rows, TURNS), unit=unit, shard_nodes=shard_nodes))
    assert got == brute_trie(rows)


def test_a_long_conversation_is_dealt_over_ranges(spark, many_ranges):
    rows = [(10, i, "user", f"t{i % 7}", 1, "x") for i in range(900)] + [(11, i, "user", f"t{i % 7}", 1, "x") for i in range(900)] + talks(3, 8)
    df = spark.createDataFrame(rows, TURNS)
    turns = df.select(F.col("conv_id").alias("conv"), "turn", F.xxhash64("text").alias("t1"), F.xxhash64("role").alias("t2"), F.lit(1).cast("long").alias("bytes"))
    parts = turns.repartitionByRange("conv", "turn").where("conv = 10").select(F.spark_partition_id().alias("p")).distinct().count()
    assert parts > 1
    prefix_of = {(r.conv, r.rank): r.p1 for r in prefix_trie.own_prefixes(turns).collect()}
    assert len(prefix_of) == len(rows) and prefix_of[10, 900] == prefix_of[11, 900] and prefix_of[10, 7] != prefix_of[10, 8]
    assert told(prefix_trie.prefix_trie(df, unit=3, shard_nodes=50)) == brute_trie(rows)


def test_trie_of_odd_rows(spark):
    """Null ids belong to no conversation, repeated rows are turns, a conversation may be left without turns."""
    rows = [(None, 0, "user", "a", 1, "x"), (3, None, None, None, 1, "x"), (3, None, None, None, 1, "x"), (7, 5, "user", "long " * 60_000, 1, "x"), (-4, 1, "user", "a", 1, "x")]
    df = spark.createDataFrame(rows, TURNS)
    assert told(prefix_trie.prefix_trie(df)) == brute_trie(rows)
    turnless = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 9 > 2 and c % 5)
    alone = told(prefix_trie.prefix_trie(spark.createDataFrame([(turnless, 0, "user", "a", 1, "x")], TURNS)))
    assert alone == {(turnless, 0, None, 1, 0, 1, 0, sha256(str(turnless).encode()).hexdigest())}
    assert told(prefix_trie.prefix_trie(df.limit(0))) == set()


def test_node_table_is_minimal_perfect_and_verified():
    draw = np.random.default_rng(5)
    for n in (0, 1, 2, 500, 20_000):
        depth, d1, d2 = draw.integers(0, 9, n), draw.integers(0, 1 << 63, n).astype(np.uint64), draw.integers(0, 1 << 63, n).astype(np.uint64)
        table = prefix_trie.NodeTable(depth, d1, d2)
        assert sorted(table.slots(depth, d1, d2)) == list(range(n))
        assert (table.slots(depth, d1, d2 + np.uint64(1)) == -1).all() and (table.slots(depth + 1, d1, d2) == -1).all()


def test_powers_have_inverses():
    exponents = np.array([0, 1, 2, 63, 10**9])
    for base, inverse in zip(prefix_trie.BASES, prefix_trie.INVERSES, strict=True):
        assert [int(x) for x in prefix_trie.power(base, exponents)] == [pow(int(base), int(e), 1 << 64) for e in exponents]
        assert (prefix_trie.power(base, exponents) * prefix_trie.power(inverse, exponents) == 1).all()


# ---- mix

DOCS = "doc_id long, source string, size long, mix string, source_size int, _part int"


def fill(sizes, weights=(5, 2, 1), most=3):
    """Targets by sharing again what is above, step by step."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_ones, left = {}, set(names), sum(sizes.values())
    while open_ones:
        share = {s: left * weight[s] / sum(weight[x] for x in open_ones) for s in open_ones}
        above = {s for s in open_ones if share[s] > most * sizes[s] + 1e-9}
        if not above:
            return target | share
        target |= {s: float(most * sizes[s]) for s in above}
        left, open_ones = left - sum(most * sizes[s] for s in above), open_ones - above
    return target


@pytest.mark.parametrize("seed", range(3))
def test_mix_meets_targets(spark, many_ranges, seed):
    draw = random.Random(seed)
    sources = ["a", "b", "é", "z", "", None, "tiny"]
    rows = [(draw.choice([None, i]), draw.choice(sources[:6]) if i > 3 else "tiny", draw.choice([None, 0, 3, 50, 50, 400]), "m", 1, 2) for i in range(600)] + [(9, "a", 7, "m", 1, 2)] * 3
    df = spark.createDataFrame(rows, DOCS)
    out = mixing.mix(df)
    name = out.columns[-1]
    assert out.columns[:-1] == df.columns and name == "_mix"
    got = [tuple(r) for r in out.collect()]
    assert Counter(r[:6] for r in got) == Counter(rows)
    sizes = {s: sum(r[2] or 0 for r in rows if r[1] == s) for s in sources}
    target = fill(sizes)
    assert target["tiny"] == 3 * sizes["tiny"]
    for s in sources:
        mine = [r[-1] for r in got if r[1] == s]
        assert all(m.source_size == sizes[s] and m.target == pytest.approx(target[s]) for m in mine)
        assert abs(sum(m.taken for m in mine) - target[s]) <= max(r[2] or 0 for r in rows if r[1] == s)
    assert all(0 <= r[-1].copies <= 3 and r[-1].taken == r[-1].copies * (r[2] or 0) for r in got)
    again = mixing.mix(df.repartition(7))
    assert Counter(map(repr, got)) == Counter(map(repr, [tuple(r) for r in again.collect()]))
    emitted = mixing.emit(out, name)
    assert emitted.count() == sum(r[-1].copies for r in got)
    assert emitted.columns[-1] == "copy" and emitted.agg(F.max("copy")).first()[0] <= 3


@pytest.mark.parametrize("total", [2**29, 2**31 - 8, 2**33])
def test_mix_of_many_words(spark, total):
    """Words that fit an int as their weighted share does not, and words that fit none."""
    df = spark.createDataFrame([(i, s, total // 8, "m", 1, 2) for i, s in enumerate("aaaabbcc")], DOCS)
    got = mixing.mix(df).collect()
    target = fill({"a": total // 2, "b": total // 4, "c": total // 4})
    assert len(got) == 8 and all(r._mix.target == pytest.approx(target[r.source]) for r in got)
    assert all(abs(sum(r._mix.taken for r in got if r.source == s) - target[s]) <= total // 8 for s in "abc")


def test_mix_of_nothing(spark):
    df = spark.createDataFrame([(1, "a", 0, "m", 1, 2), (2, None, None, "m", 1, 2)], DOCS)
    assert mixing.mix(df.limit(0)).collect() == []
    assert [(r._mix.target, r._mix.taken) for r in mixing.mix(df).collect()] == [(0.0, 0), (0.0, 0)]
    texts = spark.createDataFrame([(None,), ("",), (" \t\x0b\n",), ("a\x0bb c  d",), ("x " * 50_000,)], "text string")
    assert [r[0] for r in texts.select(mixing.word_count(F.col("text"))).collect()] == [0, 0, 0, 3, 50_000]


# ---- spelling

def brute_words(rows, every=199, least=5, length=6):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{word}".encode())
            counts[word[: h % len(word)] + word[h % len(word) + 1 :] if h % every == 0 else word] += 1
    return {w: n for w, n in counts.items() if len(w) >= length and n >= least}


def one_apart(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]


def brute_variants(words):
    form, out = {}, set()
    near = {w: [x for x in words if one_apart(w, x)] for w in words}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 5 * n else None
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, n, len(near[w]), form[w], words[form[w]] if form[w] else None, root))
    return out


def variant_words(seed, n=250):
    """Words with variants of variants, letters in another order, letters of two bytes, and one crowded signature."""
    draw, words = random.Random(seed), {}
    for _ in range(n):
        word = "".join(draw.choice("aeiéérnstÿ") for _ in range(draw.randint(6, 9)))
        for times in (1, 7, 60):
            words.setdefault(word, draw.randint(5, 9) * times)
            i = draw.randrange(len(word))
            word = draw.choice([word[:i] + word[i + 1 :], word[:i] + draw.choice("aeé") + word[i:], word[:i] + draw.choice("aeé") + word[i + 1 :], word[::-1]])
    return {w: c for w, c in words.items() if len(w) >= 6}


@pytest.mark.parametrize("paired,parts", [(64, 7), (2, 7), (10, 4)])
def test_variants_agree_with_brute_force(spark, paired, parts):
    words = variant_words(paired) | dict.fromkeys(["".join(random.Random(i).sample("abcdefgh", 8)) for i in range(60)], 9)
    df = spark.createDataFrame([(w, n, 1) for w, n in words.items()] + [(None, 5, 1)], "word string, n long, root int")
    assert told(spelling.spelling_variants(df, paired=paired, parts=parts)) == brute_variants(words)
    assert told(spelling.spelling_variants(df.limit(0))) == set()


def test_signatures_find_all_within_distance_two():
    draw = random.Random(2)
    for _ in range(300):
        word = "".join(draw.choice("abcdé") for _ in range(draw.randint(6, 12)))
        i = draw.randrange(len(word))
        for other in (word[:i] + word[i + 1 :], word[:i] + "c" + word[i:], word[:i] + "x" + word[i + 1 :]):
            differ = spelling.part_hashes(word, 7) != spelling.part_hashes(other, 7)
            assert differ.sum() <= 2


def test_vocabulary_and_changes(spark):
    text = "Straße STRASSEN straßen, Éclair éclair; x÷y×zzzz abc " * 3
    rows = [(i, text) for i in range(120)] + [(None, "Nullnull " * 9), (5, None), (6, ""), (7, "langtext " * 40_000), (7, text), (7, text)]
    df = spark.createDataFrame([(*r, "w") for r in rows], "doc_id long, text string, word string")
    got = spelling.vocabulary(df, change=lambda run: spelling.misspelt(run, F.col("doc_id"), 199))
    assert {r.word: r.n for r in got.collect()} == brute_words(rows)
    assert spelling.vocabulary(df.limit(0)).count() == 0


SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables")
def test_registered_queries(spark):
    read = lambda name, *columns: [tuple(r) for r in spark.read.parquet(f"{SMALL}/{name}.parquet").select(*columns).collect()]
    assert told(queries.op11_prefix_trie(spark, SMALL)) == brute_trie(read("conversations", "conv_id", "turn", "role", "text"))
    documents = read("documents", "doc_id", "text")
    assert told(queries.op13_spelling_variants(spark, SMALL)) == brute_variants(brute_words(documents))
    mixed = queries.op12_systematic_mix(spark, SMALL)
    assert {"doc_id bigint", "size bigint", "source_size bigint", "target double", "taken bigint"} <= {f"{n} {t}" for n, t in mixed.dtypes}
    assert mixed.count() == len(documents)
