"""Spelling variants by PartEnum signatures.

Two words that differ by one inserted, deleted or replaced letter have letter multisets that, as binary vectors
over (letter, how often it came before), lie within Hamming distance two. PartEnum cuts the dimensions of the
vectors into parts and emits one signature for each choice of parts that leaves two out: vectors within distance
two differ in two parts at most, so they share a signature. Signatures are joined by equality and each pair is
verified on the words. A signature of many words is split by a second exact key before it is joined.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from hashlib import blake2b
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkgauge.session import materialize

LETTERS = "A-Za-z\\u00C0-\\u00FF"
MIN_LENGTH = 6
MIN_COUNT = 5
TIMES = 5
HAMMING = 2
PARTS = 7
# words of one signature that are paired directly; larger ones are split by a second key
PAIRED = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def misspelt(word: Column, key: Column, every: int) -> Column:
    """``word`` without one letter where ``every`` divides the unsigned crc32 of ``<key>:<word>``; a null key is empty text."""
    hashed = F.crc32(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), word).cast("binary"))
    at = (hashed % F.length(word)).cast("int")
    shorter = F.concat(F.substr(word, F.lit(1), at), F.substr(word, at + 2))
    return F.when(hashed % every == 0, shorter).otherwise(word)


def vocabulary(docs: DataFrame, text: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, change=None) -> DataFrame:
    """word, n: the letter runs of whole texts, A-Z in lower case, with their occurrences over all documents.

    Words of under ``min_length`` code points or ``min_count`` occurrences are no words. ``change`` maps the column
    of a run before it is counted. Counts are partial before the shuffle, so a frequent word is one row a task.
    """
    # a run that is too short stays so: the greedy pattern finds whole runs of at least the length
    runs = F.regexp_extract_all(F.col(text), F.lit(f"[{LETTERS}]{{{min_length},}}"), F.lit(0))
    words = docs.where(F.col(text).isNotNull()).select("*", F.explode(runs).alias("__run"))
    low = F.translate("__run", UPPER, LOWER)
    words = words.withColumn("__run", low).select((change(F.col("__run")) if change else F.col("__run")).alias("word"))
    return words.where(F.length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


@cache
def _dimension(letter: str, before: int, parts: int) -> tuple[int, int]:
    """The part of a dimension and its hash."""
    digest = int.from_bytes(blake2b(f"{letter}{before}".encode(), digest_size=9).digest(), "little")
    return digest % 251 % parts, digest >> 8


def part_hashes(word: str, parts: int) -> np.ndarray:
    """One hash for each part: the sum of the hashes of the multiset's dimensions in it."""
    out, seen = [0] * parts, {}
    for letter in word:
        before = seen.get(letter, 0)
        seen[letter] = before + 1
        part, value = _dimension(letter, before, parts)
        out[part] += value
    return np.array([v & 0xFFFFFFFFFFFFFFFF for v in out], dtype=np.uint64)


def signatures(words: DataFrame, parts: int = PARTS, distance: int = HAMMING) -> DataFrame:
    """word, sig: one row for each choice of ``parts - distance`` parts of a word's vector."""
    chosen = np.zeros((len(list(combinations(range(parts), distance))), parts), dtype=np.uint64)
    for row, left_out in enumerate(combinations(range(parts), distance)):
        chosen[row] = [0 if p in left_out else (0x9E3779B97F4A7C15 * (2 * p + 3)) & 0xFFFFFFFFFFFFFFFF for p in range(parts)]
    number = np.arange(len(chosen), dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 5000):
                piece = batch.slice(start, 5000)
                hashes = np.array([part_hashes(w.as_py(), parts) for w in piece["word"]], dtype=np.uint64).reshape(-1, parts)
                mixed = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                mixed ^= mixed >> np.uint64(32)
                sums = (mixed[:, None, :] * chosen[None, :, :]).sum(axis=2, dtype=np.uint64) + number
                yield pa.RecordBatch.from_arrays(
                    [piece["word"].take(pa.array(np.repeat(np.arange(piece.num_rows), len(chosen)))), pa.array(sums.ravel().view(np.int64))], names=["word", "sig"])

    return words.select("word").mapInArrow(run, "word string, sig long")


def _second_key(word: Column) -> Column:
    """The word, and the word without each of its letters: words one edit apart share one of these."""
    at = F.sequence(F.lit(1), F.length(word))
    return F.array_distinct(F.concat(F.array(word), F.transform(at, lambda i: F.concat(F.substr(word, F.lit(1), i - 1), F.substr(word, i + 1)))))


def near_words(words: DataFrame, parts: int = PARTS, paired: int = PAIRED) -> DataFrame:
    """a, b: both orders of each pair of ``words`` one edit apart, once.

    A signature of up to ``paired`` words is joined with itself. Larger ones, which letters in another order or very
    common endings make, are joined on the signature and a second key: words one edit apart have a form in common
    when each may lose one letter. That is exact too, and a group of it holds words that are alike.
    """
    signed = materialize(signatures(words, parts), "signatures")
    sizes = signed.groupBy("sig").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    shared = materialize(signed.join(sizes, "sig"), "shared")
    small, large = shared.where(F.col("k") <= paired), shared.where(F.col("k") > paired)
    close = F.levenshtein("a", "b", 1) == 1
    pairs = small.select("sig", F.col("word").alias("a")).join(small.select("sig", F.col("word").alias("b")), "sig").where((F.col("a") < F.col("b")) & close)
    split = materialize(large.select("sig", "word", F.explode(_second_key(F.col("word"))).alias("form")), "forms")
    # a form that one word has alone pairs nothing
    again = split.select("sig", "form", F.col("word").alias("a")).join(split.select("sig", "form", F.col("word").alias("b")), ["sig", "form"]).where(
        (F.col("a") < F.col("b")) & close)
    once = materialize(pairs.select("a", "b").unionAll(again.select("a", "b")).distinct(), "near")
    return once.unionAll(once.select(F.col("b").alias("a"), F.col("a").alias("b")))


def roots(forms: DataFrame) -> DataFrame:
    """word, root for each row of (word, form): the end of the chain of forms.

    A form is at least ``TIMES`` as frequent as its word, so chains are logarithmic in the counts and have no
    circles; each round doubles the steps.
    """
    now = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = now.select(F.col("word").alias("w"), F.col("root").alias("next"))
        told = materialize(now.join(further, F.col("root") == F.col("w"), "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now = told.select("word", "root")
        if told.where("moved").isEmpty():
            return now


def spelling_variants(words: DataFrame, times: int = TIMES, parts: int = PARTS, paired: int = PAIRED) -> DataFrame:
    """word, n, n_near, form, form_n, root for each row of ``words`` (word, n), whose words are distinct.

    form is the near word of largest n (ties: the smallest in code-point order) if its n is at least ``times``
    the word's, else null; root is the end of the chain of forms, the word itself without one. A word alone has
    n_near 0; an empty table gives an empty result. Null words are no words. Other columns are not read.
    """
    words = materialize(words.where(F.col("word").isNotNull()).select("word", "n"), "words")
    pairs = near_words(words, parts, paired)
    # pairs meet their counts by word; no word is near to very many
    best = pairs.join(words.select(F.col("word").alias("b"), "n"), "b").groupBy(F.col("a").alias("word")).agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), F.col("b").alias("form"))).alias("best"))
    found = words.join(best, "word", "left")
    good = -F.col("best.less") >= times * F.col("n")
    told = materialize(found.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(good, F.col("best.form")).alias("form"), F.when(good, -F.col("best.less")).alias("form_n")), "variants")
    ends = roots(told.where(F.col("form").isNotNull()))
    return told.join(ends, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
