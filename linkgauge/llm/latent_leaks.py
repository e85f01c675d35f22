"""Benchmark decontamination by latent semantic retrieval.

The terms are the telling words of the benchmark items: those in few documents, and the rarest of each
item. Passages are TF-IDF rows over them. A randomised SVD of all passages is computed by Spark (each task
adds up ``A^T A Q`` for its passages), a window at every telling word of every document is projected and
compared with all items by cosine, and candidates are checked by longest common subsequence and by the
item's answer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkgauge.llm.text import text_key
from linkgauge.session import materialize

SEED = 11
RANK, EXTRA = 128, 16  # latent dimensions, and more directions for the sketch
PASSAGE = 32  # words of the passages that the latent space is fitted to
WINDOWS = (24, 40, 72)  # window sizes; an item is searched in the least that is no shorter than it
COSINE = 0.25
COMMON_SHARE = 0.005  # words in more documents than this share say little
RAREST = 8  # but the rarest words of an item always count
NEAR_COPY, PARAPHRASE, ANSWER = 0.8, 0.6, 0.6  # shares of an item's telling words found in order
MAX_TERMS = 2_000_000  # bound of what is sent to every task: terms and items, see items_of
EDGES = ".,;:!?\"'()[]{}<>*#$%&|-_=/\\"


def plain(word: str) -> str:
    """A word without case and without punctuation at its ends."""
    return word.casefold().strip(EDGES)


@dataclass
class Items:
    ids: list[int]
    words: list[np.ndarray]  # term numbers, in order
    terms: dict[str, int]


def items_of(benchmark: DataFrame, key: str, text: str) -> Items:
    """The benchmark on the driver. It is a query set: its words are counted first, and a benchmark of
    more than ``MAX_TERMS`` words is refused; give it in parts then."""
    rows = benchmark.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    size = rows.agg(F.sum(F.size(F.split("t", r"\s+")))).first()[0] or 0
    if size > MAX_TERMS:
        raise ValueError(f"the benchmark has {size} words; pass parts of at most {MAX_TERMS}")
    terms: dict[str, int] = {}
    ids, words = [], []
    for k, t in sorted(map(tuple, rows.distinct().collect())):
        found = [terms.setdefault(w, len(terms)) for w in map(plain, t.split()) if w]
        if found:
            ids.append(k)
            words.append(np.array(found, dtype=np.int32))
    return Items(ids, words, terms)


class _Terms(dict):
    """Word to term number, -1 for words outside the benchmark; emptied when full."""

    def __init__(self, terms: dict[str, int], most: int = 500_000):
        super().__init__()
        self.terms, self.most = terms, most

    def __missing__(self, word: str) -> int:
        value = self.terms.get(plain(word), -1)
        if len(self) >= self.most:
            self.clear()
        self[word] = value
        return value


def term_rows(docs: DataFrame, items: Items, key: str, text: str) -> DataFrame:
    """k, t1, t2 (key and text hashes), terms (numbers of all words, -1 for other words)."""
    shared = docs.sparkSession.sparkContext.broadcast(items.terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Terms(shared.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                found, ends = [], [0]
                for value in part["text"]:
                    words = value.as_py().split()
                    found.append(np.fromiter(map(memo.__getitem__, words), dtype=np.int32, count=len(words)))
                    ends.append(ends[-1] + len(words))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*found, np.zeros(0, np.int32)])))
                yield pa.RecordBatch.from_arrays([part["k"], part["t1"], part["t2"], lists], names=["k", "t1", "t2", "terms"])

    t1, t2, _ = text_key(text)
    rows = docs.where(F.col(text).isNotNull()).select(F.col(key).cast("long").alias("k"), t1.alias("t1"), t2.alias("t2"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "k long, t1 long, t2 long, terms array<int>")


def _parts(batch: pa.RecordBatch, words: int = 200_000) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, terms, ends of rows) of pieces of a batch with about so many words."""
    lists = batch["terms"]
    ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    row = 0
    while row < batch.num_rows:
        stop = max(row + 1, int(np.searchsorted(ends, ends[row] + words, side="right")) - 1)
        stop = min(stop, batch.num_rows)
        yield row, flat[ends[row] : ends[stop]], ends[row : stop + 1] - ends[row]
        row = stop


def document_counts(rows: DataFrame, terms: int) -> tuple[int, np.ndarray]:
    """Number of documents, and of documents with each term; tasks send one row a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(terms + 1, dtype=np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for _, flat, ends in _parts(batch):
                owner = np.repeat(np.arange(len(ends) - 1, dtype=np.int64), np.diff(ends))
                pairs = np.unique(owner[flat >= 0] * terms + flat[flat >= 0])
                total[:terms] += np.bincount(pairs % terms, minlength=terms)
        total[terms] = n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["term", "n"])

    out = np.zeros(terms + 1, dtype=np.int64)
    for r in rows.select("terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r.term] = r.n
    return int(out[terms]), out[:terms]


def sketch(rows: DataFrame, weights: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """``A^T A basis`` for the TF-IDF matrix A of all passages. Tasks send a row for each term."""
    spark = rows.sparkSession.sparkContext
    sent = spark.broadcast((weights.astype(np.float32), (weights[:, None] * basis).astype(np.float32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, scaled = sent.value
        total = np.zeros(scaled.shape, dtype=np.float64)
        for batch in batches:
            for _, flat, ends in _parts(batch):
                owner = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
                passage = owner * (1 << 40) + (np.arange(len(flat)) - ends[owner]) // PASSAGE
                good = (flat >= 0) & (weight[flat] > 0)
                term, passage = flat[good], passage[good]
                if not len(term):
                    continue
                starts = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]])
                norms = np.sqrt(np.add.reduceat(weight[term] ** 2, starts))  # repeated terms count apart
                projected = np.add.reduceat(scaled[term], starts, axis=0) / (norms[:, None] ** 2)
                number = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(term)]))
                order = np.argsort(term, kind="stable")
                runs = np.flatnonzero(np.r_[True, term[order][1:] != term[order][:-1]])
                sums = np.add.reduceat(projected[number[order]], runs, axis=0)
                total[term[order][runs]] += sums * weight[term[order][runs], None]
        at = np.flatnonzero(np.abs(total).sum(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(list(total[at].astype(np.float32)), pa.list_(pa.float32()))], names=["term", "v"])

    parts = rows.select("terms").mapInArrow(run, "term long, v array<float>")
    columns = [F.sum(F.col("v")[i]).alias(f"v{i}") for i in range(basis.shape[1])]
    out = np.zeros(basis.shape)
    for r in parts.groupBy("term").agg(*columns).collect():  # one row for each benchmark term
        out[r[0]] = r[1:]
    return out


def latent_space(rows: DataFrame, weights: np.ndarray, rank: int = RANK, seed: int = SEED) -> np.ndarray:
    """terms x rank right singular vectors of the passage matrix: randomised range finder, one power step."""
    random = np.random.default_rng(seed)
    width = min(rank + EXTRA, len(weights))
    basis, _ = np.linalg.qr(sketch(rows, weights, random.standard_normal((len(weights), width))))
    again = sketch(rows, weights, basis)
    values, vectors = np.linalg.eigh((basis.T @ again + again.T @ basis) / 2)
    return basis @ vectors[:, np.argsort(values)[::-1][:rank]]


def common_subsequence(item: np.ndarray, passage: np.ndarray, places: dict[int, int]) -> int:
    """Length of the longest common subsequence, by bit vectors; places: bits of each term in the item."""
    row = (1 << len(item)) - 1
    full = row
    for term in passage.tolist():
        hit = row & places.get(term, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(item) - row.bit_count()


def _bits(words: np.ndarray) -> dict[int, int]:
    places: dict[int, int] = {}
    for i, w in enumerate(words.tolist()):
        places[w] = places.get(w, 0) | 1 << i
    return places


def telling_terms(items: Items, documents: int, counts: np.ndarray) -> np.ndarray:
    """Which terms count: those in few documents, and each item's rarest."""
    telling = counts <= COMMON_SHARE * documents
    for words in items.words:
        own = np.unique(words)
        telling[own[np.lexsort((own, counts[own]))[:RAREST]]] = True
    return telling


def search(rows: DataFrame, items: Items, weights: np.ndarray, space: np.ndarray, cosine: float = COSINE) -> DataFrame:
    """k, t1, t2, item_id, cosine, common, answer, start: each row's best window for each item it leaks.

    ``weights`` are 0 for words that don't count. A window begins at every other word, so an item lies
    in one window from its first telling word on.
    """
    mapped = (weights[:, None] * space).astype(np.float32)
    words = [w[weights[w] > 0] for w in items.words]
    vectors = np.stack([mapped[w].sum(axis=0) for w in words]) if words else np.zeros((0, space.shape[1]), np.float32)
    norms = np.maximum(np.linalg.norm(vectors, axis=1), 1e-9)
    sizes = np.array([next((s for s in WINDOWS if s >= len(w)), max(WINDOWS[-1], len(w))) for w in items.words])
    # no window with fewer telling words can pass the check of any item
    least = min((-(-int(PARAPHRASE * 100) * len(w) // 100) for w in words if len(w)), default=1)
    sent = rows.sparkSession.sparkContext.broadcast((mapped, vectors / norms[:, None], norms, sizes, items.ids, words, weights > 0, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mapped, vectors, lengths, sizes, ids, words, telling, least = sent.value
        checks = [_Check(w) for w in words]
        kept = np.append(telling, False)  # number -1: other words
        for batch in batches:
            hits: list[tuple] = []
            for first, flat, ends in _parts(batch):
                at = np.flatnonzero(kept[flat])
                row = np.searchsorted(ends, at, side="right") - 1
                place = at + row * (1 << 20)  # rows lie further apart than any window
                for size in np.unique(sizes):
                    own = np.flatnonzero(sizes == size)
                    stop = np.searchsorted(place, place + size)
                    start = np.flatnonzero(stop - np.arange(len(place)) >= max(1, least))
                    for piece in np.array_split(start, max(1, len(start) // 10_000)):
                        if not len(piece):
                            continue
                        low, high = int(piece[0]), int(stop[piece].max())
                        sums = np.zeros((high - low + 1, mapped.shape[1]), dtype=np.float32)
                        np.cumsum(mapped[flat[at[low:high]]], axis=0, out=sums[1:])
                        found = sums[stop[piece] - low] - sums[piece - low]
                        size_of = np.maximum(np.linalg.norm(found, axis=1), 1e-9)
                        likeness = found @ vectors[own].T
                        # an item in the window shows along the item's direction by its own length, less what a paraphrase leaves out
                        for i, j in np.argwhere((likeness >= cosine * size_of[:, None]) & (likeness >= cosine * lengths[own])).tolist():
                            one, item = int(piece[i]), int(own[j])
                            left = int(np.searchsorted(place, place[one] - size // 2))
                            right = int(np.searchsorted(place, place[one] + size + size // 2))
                            common, answer, leak = checks[item](flat[at[left:right]])
                            if leak:
                                hits.append((first + int(row[one]), ids[item], float(likeness[i, j] / size_of[i]), common, answer, int(at[one] - ends[row[one]])))
            yield _best(batch, hits)

    return rows.mapInArrow(run, "k long, t1 long, t2 long, item_id long, cosine double, common double, answer double, start long")


def _best(batch: pa.RecordBatch, hits: list[tuple]) -> pa.RecordBatch:
    found = pd.DataFrame(hits, columns=["row", "item_id", "cosine", "common", "answer", "start"])
    found = found.sort_values(["row", "item_id", "common", "cosine", "start"], ascending=[True, True, False, False, True]).drop_duplicates(["row", "item_id"])
    at = pa.array(found["row"].to_numpy(np.int64))
    names = ["item_id", "cosine", "common", "answer", "start"]
    kinds = [pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
    return pa.RecordBatch.from_arrays(
        [*(batch[c].take(at) for c in ("k", "t1", "t2")), *(pa.array(found[n].to_numpy(), k) for n, k in zip(names, kinds, strict=True))],
        names=["k", "t1", "t2", *names])


class _Check:
    """Is an item in a passage: a near copy, or a paraphrase that gives the answer?

    Both are sequences of telling words. The answer is the last third of the item.
    """

    def __init__(self, words: np.ndarray):
        self.words, self.places = words, _bits(words)
        self.answer = words[-max(1, -(-len(words) // 3)) :]
        self.answer_places = _bits(self.answer)

    def __call__(self, passage: np.ndarray) -> tuple[float, float, bool]:
        if not len(self.words):
            return 0.0, 0.0, False
        common = common_subsequence(self.words, passage, self.places) / len(self.words)
        if common < PARAPHRASE:
            return common, 0.0, False
        answer = common_subsequence(self.answer, passage, self.answer_places) / len(self.answer)
        return common, answer, common >= NEAR_COPY or answer >= ANSWER


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each (document, item) it leaks: k (the key), t1, t2 (text hashes), item_id, cosine,
    common and answer (shares found in order), start (word of the window). Documents without a leak have none.

    Null texts and texts without words leak nothing; null items and items without words are not searched;
    repeated rows each give their rows; empty tables give none. Other columns are not read.
    """
    items = items_of(benchmark, item, item_text)
    rows = materialize(term_rows(docs, items, key, text), "terms")
    total, counts = document_counts(rows, max(1, len(items.terms)))
    weights = np.where(telling_terms(items, total, counts), np.log((1 + total) / (1 + counts)) + 1e-3, 0.0)
    space = latent_space(rows, weights) if items.terms else np.zeros((1, 1))
    return search(rows, items, weights, space)


def without_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows that leak an item."""
    found = materialize(leaks(docs, benchmark, key, text), "leaks").select(F.col("k").alias("__k"), F.col("t1").alias("__1"), F.col("t2").alias("__2")).distinct()
    t1, t2, _ = text_key(text)
    # a join by shuffle at every size: what is sent of the texts grows with them alone
    return docs.join(found.hint("merge"), F.col(key).cast("long").eqNullSafe(F.col("__k")) & (t1 == F.col("__1")) & (t2 == F.col("__2")), "left_anti")
