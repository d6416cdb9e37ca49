"""Vectorised text kernels: code points, word hashes and word n-grams of whole Arrow batches.

Texts are never cut. Batches are worked through in slices of about ``SLICE`` code points
(a longer text makes a slice of its own), so memory follows the longest text, not the batch.
All hashes are fixed functions of the text: the same on every executor and in every run.
"""

from __future__ import annotations

import sys
import unicodedata  # noqa: F401  (documents where the letter and digit classes come from)
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1_500_000

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit integers."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


@lru_cache(1)
def _lower_mix() -> np.ndarray:
    """Per code point the mixed value of its lower case, 0 for what is neither letter nor digit."""
    low = np.arange(sys.maxunicode + 1, dtype=U)
    word = np.zeros(sys.maxunicode + 1, bool)
    for i in range(sys.maxunicode + 1):
        c = chr(i)
        if c.isalnum():
            word[i] = True
            low[i] = ord(c.lower()[0])
    return np.where(word, mix(low + U(1)) | U(1), U(0))


@lru_cache(1)
def _char_mix() -> np.ndarray:
    return mix(np.arange(sys.maxunicode + 1, dtype=U) + U(1))


_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the hash base and of its inverse, modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, SLICE + 100_000)
        made = []
        for b in (_BASE, _INVERSE):
            a = np.full(size, b, U)
            a[0] = 1
            made.append(np.cumprod(a))
        if size > 4 * SLICE:  # for one very long text only
            return made[0], made[1]
        _POWERS[:] = made
    return _POWERS[0], _POWERS[1]


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the texts in a row, and the offsets of each text; null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lengths = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
    off = np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)
    byte_off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = b"" if raw is None else memoryview(raw)[byte_off[0] : byte_off[-1]]
    cp = np.frombuffer(str(data, "utf-8").encode("utf-32-le"), np.uint32) if len(data) else np.zeros(0, np.uint32)
    return cp, off


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``SLICE`` characters of ``column``."""
    lengths = pc.fill_null(pc.utf8_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(lengths):
        if held and held + n > SLICE:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of every word in order; a word is a maximal run of letters and digits, lower-cased."""
    cp, off = code_points(texts)
    if not len(cp):
        return np.zeros(0, U), np.zeros(0, np.int64)
    m = _lower_mix()[cp]
    is_word = m != 0
    before = np.empty_like(is_word)
    before[0] = False
    before[1:] = is_word[:-1]
    heads = off[:-1][np.diff(off) > 0]
    before[heads] = False
    start = np.flatnonzero(is_word & ~before)
    after = np.empty_like(is_word)
    after[-1] = False
    after[:-1] = is_word[1:]
    after[heads[1:] - 1] = False
    end = np.flatnonzero(is_word & ~after)
    up, down = powers(len(cp))
    m *= up[: len(cp)]
    np.cumsum(m, out=m)
    h = m[end]
    h[1:] -= m[start[1:] - 1]
    if len(start) and start[0] > 0:
        h[0] -= m[start[0] - 1]
    h *= down[start]
    return mix(h), np.searchsorted(off, start, side="right") - 1


#: Bits of an n-gram hash; the bits above hold the number of the text within a slice.
GRAM_BITS = 44


def word_grams(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram, text number, words per text): the distinct word ``n``-grams of each text, ascending within it."""
    h, doc = word_hashes(texts)
    words = np.bincount(doc, minlength=len(texts))
    if len(h) < n:
        return np.zeros(0, U), np.zeros(0, np.int64), words
    last = len(h) - n + 1
    g = np.zeros(last, U)
    for k in range(n):
        g = g * U(0xD6E8FEB86659FD93) + h[k : k + last]
    inside = doc[:last] == doc[n - 1 :]
    key = (doc[:last][inside].astype(U) << U(GRAM_BITS)) | (mix(g[inside]) >> U(64 - GRAM_BITS))
    key.sort()
    if len(key):
        key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    return key & U((1 << GRAM_BITS) - 1), (key >> U(GRAM_BITS)).astype(np.int64), words


def spans(doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of each run of equal numbers in ``doc``, and its number."""
    if not len(doc):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    s = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    return s, doc[s]


def rolling(cp: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``k`` code points, at its first position; and whether it lies within one text."""
    if len(cp) < k:
        return np.zeros(0, U), np.zeros(0, bool)
    up, down = powers(len(cp))
    m = _char_mix()[cp]
    m *= up[: len(cp)]
    np.cumsum(m, out=m)
    h = m[k - 1 :].copy()
    h[1:] -= m[:-k]
    h *= down[: len(h)]
    inside = np.zeros(len(cp) + 1, np.int32)
    n = np.diff(off)
    ok = n >= k
    np.add.at(inside, off[:-1][ok], 1)
    np.add.at(inside, off[1:][ok] - k + 1, -1)
    return mix(h), np.cumsum(inside[: len(h)]) > 0
