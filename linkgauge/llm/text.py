"""Words, hashes and row helpers that several operators share."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ASCII white space: the only characters that separate words
WHITE = " \t\n\x0b\f\r"
_WORD = ~np.isin(np.arange(256), [*WHITE.encode()])
_LOWER = np.array([x + 32 if 65 <= x <= 90 else x for x in range(256)], dtype=np.uint8)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_ODD = np.uint64(0x9E3779B97F4A7C15)
# by number of bytes: what is left of eight
_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=np.uint64)
# words of more bytes are hashed one by one
LONG = 32
# texts are worked on together up to so many bytes; a longer one is alone
PIECE = 1 << 18


def mix(values: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    values = (values ^ (values >> np.uint64(30))) * _MIX[0]
    values = (values ^ (values >> np.uint64(27))) * _MIX[1]
    return values ^ (values >> np.uint64(31))


def word_hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each word of ``data``, eight bytes of all words at a time; eight bytes follow the last word."""
    found = lengths.astype(np.uint64) * _ODD
    eights = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    found = mix(found ^ (eights[starts] & _MASKS[np.minimum(lengths, 8)]))
    for done in range(8, LONG, 8):
        more = np.flatnonzero(lengths > done)
        found[more] = mix(found[more] ^ (eights[starts[more] + done] & _MASKS[np.minimum(lengths[more] - done, 8)]))
    for i in np.flatnonzero(lengths > LONG):
        word = data[starts[i] : starts[i] + lengths[i]].tobytes()
        found[i] = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
    return found


def _windows(words: np.ndarray, size: int) -> np.ndarray:
    """A hash for each row of ``size`` neighbours, in their order."""
    total = np.zeros(max(0, len(words) - size + 1), dtype=np.uint64)
    for i in range(size):
        total = total * _ODD + words[i : i + len(total)]
    return mix(total + np.uint64(size))


def _sets_of(data: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The sets of texts that stand one after the other in ``data``, and how many shingles each has."""
    data = np.concatenate([_LOWER[data], np.zeros(8, np.uint8)])
    inside = np.concatenate([[False], _WORD[data[:-8]], [False]])
    # a word ends with its text: between two texts there is no byte
    bounds = np.concatenate([[0], ends])
    first, last = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    begun = bounds[:-1][bounds[:-1] < bounds[1:]]
    ended = bounds[1:][bounds[:-1] < bounds[1:]] - 1
    first[begun], last[ended] = inside[1:-1][begun], inside[1:-1][ended]
    starts = np.flatnonzero(first)
    words = word_hashes(data, starts, np.flatnonzero(last) + 1 - starts)
    at = np.searchsorted(starts, bounds)
    count = np.diff(at)
    # a window is kept at its first word; the last words of a text begin none, and few words are one window
    found, kept = np.zeros(len(words), np.uint64), np.ones(len(words), bool)
    whole = _windows(words, size)
    found[: len(whole)] = whole
    for i in range(1, min(size, max(count, default=0) + 1)):
        kept[at[1:][count >= i] - i] = False
    for n in np.unique(count[(count > 0) & (count < size)]):
        begin = at[:-1][count == n]
        kept[begin] = True
        found[begin] = _windows(words[begin[:, None] + np.arange(n)].T, n)[0]
    found, to = found[kept], np.concatenate([[0], np.cumsum(kept)])[at]
    for a, b in zip(to[:-1].tolist(), to[1:].tolist(), strict=True):
        found[a:b].sort()
    new = np.ones(len(found), bool)
    new[1:] = found[1:] != found[:-1]
    new[to[:-1][to[:-1] < to[1:]]] = True
    return found[new], np.diff(np.concatenate([[0], np.cumsum(new)])[to])


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Of each text, the sorted distinct hashes of its windows of ``size`` words, with A-Z in lower case.

    Fewer words are one window, none are no window; null is empty. Texts are hashed together, not word by word.
    """
    plain = texts.cast(pa.large_binary()).fill_null(b"")
    if not len(plain):
        return []
    _, offsets, content = plain.buffers()
    at = np.frombuffer(offsets, np.int64)[plain.offset : plain.offset + len(plain) + 1]
    data = np.frombuffer(content, np.uint8) if content else np.zeros(0, np.uint8)
    sets, start = [], 0
    while start < len(plain):
        end = max(start + 1, int(np.searchsorted(at, at[start] + PIECE, "right")) - 1)
        found, counts = _sets_of(data[at[start] : at[end]], at[start + 1 : end + 1] - at[start], size)
        sets += np.split(found, np.cumsum(counts)[:-1])
        start = end
    return sets


def text_key(text: str | Column) -> list[Column]:
    """Two 64-bit hashes and the length: one key for equal texts. Null and empty texts differ."""
    text = F.col(text) if isinstance(text, str) else text
    return [F.xxhash64(text), F.xxhash64(F.lit(7), text), F.coalesce(F.octet_length(text), F.lit(-1))]


def spare_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores in front, so that no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
