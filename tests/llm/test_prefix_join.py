import random
import time
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from linkgauge.llm import prefix_join, text
from linkgauge.llm.components import components

SCHEMA = "doc_id long, text string, cid string, n int"


def shingles(text):
    lower = (text or "").translate({i: i + 32 for i in range(65, 91)})
    for ch in "\t\n\x0b\x0c\r":
        lower = lower.replace(ch, " ")
    words = [w for w in lower.split(" ") if w]
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows):
    """component of each row by all pairs."""
    sets, up = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            up[max(find(i), find(j))] = min(find(i), find(j))
    ids = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            ids[find(i)] = min(key, ids.get(find(i), key))
    return [(key, len(sets[i]), ids.get(find(i)) if sets[i] else key) for i, (key, _) in enumerate(rows)]


def corpus(seed):
    draw = random.Random(seed)
    word = lambda: f"w{draw.randint(0, 5000)}"
    rows, passage = [], " ".join(word() for _ in range(40))
    for _ in range(6):
        base = [word() for _ in range(draw.choice([3, 30, 120, 300]))]
        for _ in range(draw.choice([1, 3, 25])):
            copy = list(base)
            for _ in range(draw.choice([0, 1, 2, 4])):
                copy[draw.randrange(len(copy))] = word()
            rows.append(" ".join(copy).title() if draw.random() < 0.2 else " \n".join(copy))
    rows += [" ".join(word() for _ in range(60)) + " " + passage for _ in range(10)]
    rows += ["", None, "  \t", "one", "One", "two words", "same five words are here", "a " * 5000, "b"]
    draw.shuffle(rows)
    return [(i if draw.random() > 0.02 else None, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_all_pairs(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame([(*r, "c", 1) for r in rows], SCHEMA).repartition(3)
    got = prefix_join.near_duplicates(docs).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute(rows), key=repr)


def test_any_order_of_shingles_gives_the_same(spark, monkeypatch):
    rows = corpus(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = sorted(brute(rows), key=repr)
    monkeypatch.setattr(prefix_join, "COMMON_KEPT", 1)
    got = prefix_join.near_duplicates(docs).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=repr) == expected


def test_one_of_each_and_empty_tables(spark):
    text = " ".join(f"w{i}" for i in range(50))
    docs = spark.createDataFrame([(3, text, "", 0), (1, text, "", 0), (1, text, "", 0), (5, None, "", 0), (6, "", "", 0), (7, "other words", "", 0)], SCHEMA)
    assert sorted(r.doc_id for r in prefix_join.one_of_each(docs).collect()) == [1, 5, 6, 7]
    assert prefix_join.one_of_each(docs.limit(0)).count() == 0


def test_one_of_each_by_key_and_text(spark):
    words = lambda start, n=50: " ".join(f"w{i}" for i in range(start, start + n))
    kept = lambda rows: sorted(map(tuple, prefix_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    copied, near, other, third = words(0), words(0) + " changed", words(100), words(200)
    # a copy without a key takes no other row without a key along
    rows = [(1, copied), (None, near), (None, other), (None, None), (None, ""), (None, "")]
    assert kept(rows) == sorted([rows[0], *rows[2:]], key=repr)
    # nor does a copy take another text with its key along
    assert kept([(1, copied), (2, near), (2, other)]) == sorted([(1, copied), (2, other)], key=repr)
    # near copies without a key, or with one key: one stays, equal rows too
    for key in (None, 4):
        left = kept([(key, copied), (key, near), (key, near), (key, copied), (key, third), (key, " "), (key, " ")])
        assert len(left) == 4 and left.count((key, " ")) == 2 and (key, third) in left


def test_histogram_bounds_the_overlap():
    random_set = lambda n, s: np.unique(np.random.default_rng(s).integers(0, 2**63, n).astype(np.uint64))
    for s in range(20):
        a, b = random_set(40 * (s + 1), s), random_set(700, 100 + s)
        b = np.unique(np.concatenate([b, a[: 20 * s]]))
        common = len(np.intersect1d(a, b))
        assert common <= prefix_join.most_common(prefix_join.histogram(a), prefix_join.histogram(b))
    assert prefix_join.most_common(b"", prefix_join.histogram(random_set(9, 1))) > 10**6


def test_long_chain(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1001), (1005, 1001)]
    out = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {i: 0 for i in range(201)} | {1000: 1000, 1001: 1000, 1005: 1000}


def hot_corpus(seed):
    """One text that all documents have parts of: copies with words changed, lines cut, words added, around the limit; some are strays."""
    draw = random.Random(seed)
    word = lambda: f"w{draw.randint(0, 10**6)}"
    base, rows = [f"b{i}" for i in range(90)], []
    for _ in range(110):
        copy = list(base)
        for _ in range(draw.choice([0, 1, 2, 3, 4])):
            copy[draw.randrange(len(copy))] = word()
        if draw.random() < 0.5:
            start, size = draw.randrange(60), draw.choice([5, 10, 15, 20])
            del copy[start : start + size]
        copy += [word() for _ in range(draw.choice([0, 0, 5, 10, 20]))]
        rows.append(" ".join(copy))
    family = base[40:] + [word() for _ in range(40)]
    rows += [" ".join([*family[:i], word(), *family[i + 1 :]]) for i in range(0, 80, 8)]
    return list(enumerate(rows))


@pytest.mark.parametrize("seed,earlier", [(1, 8), (2, 1), (3, 3)])
def test_a_shingle_that_all_have(spark, monkeypatch, seed, earlier):
    monkeypatch.setattr(prefix_join, "EARLIER", earlier)
    rows = hot_corpus(seed)
    docs = spark.createDataFrame([(*r, "c", 1) for r in rows], SCHEMA).repartition(3)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in prefix_join.near_duplicates(docs).collect()]
    expected = brute(rows)
    assert len({c for _, _, c in expected}) > 20 and sorted(got) == sorted(expected)


def test_rows_that_reach_no_other_component_are_dropped(spark):
    """By the least size and largest reach of the other components; the rest stays, whatever its component."""
    rows = [(1, 10, 100, 0, 7), (1, 11, 100, 5, 7), (1, 12, 100, 30, 8), (1, 13, 70, 0, 9), (2, 10, 100, 1, 7), (2, 11, 100, 6, 7)]
    shared = spark.createDataFrame([r[:4] for r in rows], "token long, g long, n long, pos long")
    spans = spark.createDataFrame(sorted({(r[1], r[4]) for r in rows}), "g long, part long")
    assert prefix_join._open_rows(shared, spans, 80).count() == 0
    more = spark.createDataFrame([(1, 14, 90, 2), (1, 15, 70, 3)], "token long, g long, n long, pos long")
    parts = spark.createDataFrame([(14, 5), (15, 6)], "g long, part long")
    left = prefix_join._open_rows(shared.unionAll(more), spans.unionAll(parts), 80)
    assert {(r.token, r.g, r.main) for r in left.collect()} == {(1, 10, 7), (1, 11, 7), (1, 13, 7), (1, 14, 7), (1, 15, 7)}


def test_groups_are_shuffled_once_for_their_shared_shingles(spark):
    """The prefixes of all groups went through two shuffles: one to find shared shingles, one to keep them."""
    rows = [(b"a", 9, [5, 1, 2]), (b"a", 9, [5, 1, 2]), (b"b", 8, [2, 3]), (b"c", 4, [4]), (b"d", 7, [6, 5])]
    full = spark.createDataFrame(rows, "gid binary, n long, prefix array<long>").repartition(3)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        shared = prefix_join._shared_shingles(full)
        plan = shared._jdf.queryExecution().executedPlan().toString()
        got = Counter((r["token"], r["pos"], r["n"]) for r in shared.collect())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert got == {(5, 0, 9): 1, (2, 2, 9): 1, (2, 0, 8): 1, (5, 1, 7): 1}
    assert plan.count("Exchange hashpartitioning(gid") == 2 and plan.count("ReusedExchange") == 1


def odd_texts():
    draw = random.Random(5)
    word = lambda: draw.choice(["a", "A", "\x00", "\x00\x00", "caf\u00e9", "\u00c9", "\u00a0", "eightby8", "ninebytes", "x" * 32, "x" * 33, "x" * 32 + "y", "y" * 5000, f"w{draw.randint(0, 99)}"])
    some = [draw.choice(["", " ", "\n\t"]) + draw.choice([" ", "\x0b\x0c", "\r\n"]).join(word() for _ in range(draw.randint(0, 30))) + draw.choice(["", "\x0b"]) for _ in range(300)]
    return [None, "", " \n", "ends", "begins", None, *some, "one two three four", "One  two three four five", ""]


@pytest.mark.parametrize("size,piece,kind", [(5, 1, pa.string()), (5, 100, pa.large_string()), (1, 1 << 18, pa.string()), (9, 1 << 18, pa.string()), (40, 1 << 18, pa.string())])
def test_sets_of_many_texts_at_once(monkeypatch, size, piece, kind):
    """Equal windows have equal hashes, others others, whatever stands beside a text and wherever it is cut off."""
    monkeypatch.setattr(text, "PIECE", piece)
    texts = odd_texts()
    sets = text.shingle_sets(pa.array(["before", *texts, "behind"], kind).slice(1, len(texts)), size)
    hashes = {}
    for value, found in zip(texts, sets, strict=True):
        words = (value or "").encode().lower().split()
        windows = {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()
        assert len(found) == len(windows) and (found[1:] > found[:-1]).all()
        assert np.array_equal(text.shingle_sets(pa.array([value], kind), size)[0], found)
        if len(windows) == 1:
            hashes[windows.pop()] = found[0]
    assert len(set(hashes.values())) == len(hashes)
    assert text.shingle_sets(pa.array([], kind), size) == []


def test_long_windows_keep_the_order_of_their_words(spark):
    """The first and the ninth word of a window could change places without a change of its hash."""
    words = [f"w{i}" for i in range(9)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join([words[8], *words[1:8], words[0]]))], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in prefix_join.near_duplicates(docs, size=9).collect()} == {(1, 1), (2, 2)}


def test_listed_hashes_are_told():
    draw = np.random.default_rng(1)
    values = np.unique(draw.integers(0, 2**64, 5000, dtype=np.uint64))
    near = np.concatenate([values, values + np.uint64(1), draw.integers(0, 2**64, 5000, dtype=np.uint64), np.array([0, 2**64 - 1], np.uint64)])
    assert np.array_equal(prefix_join.Listed(values).has(near), np.isin(near, values))
    assert not prefix_join.Listed(values[:0]).has(near).any()
    found, counts = prefix_join.several_times(np.array([7, 1, 7, 3, 1, 7, 9], np.uint64))
    assert found.tolist() == [1, 7] and counts.tolist() == [2, 3]
    assert [len(x) for x in prefix_join.several_times(values[:0])] == [0, 0]


def test_sets_cost_no_python_for_each_word():
    """Every word was looked up in a dictionary of Python; texts of one batch are now hashed together."""
    draw = random.Random(3)
    texts = pa.array([" ".join(f"w{draw.randrange(10**6)}" for _ in range(500)) for _ in range(400)])

    def cpu(work):
        start = time.process_time()
        work()
        return time.process_time() - start

    plain = lambda: [dict.fromkeys(x.as_py().encode().lower().split()) for x in texts]
    assert min(cpu(lambda: text.shingle_sets(texts, 5)) for _ in range(5)) < 2 * min(cpu(plain) for _ in range(5))
