"""Words of many texts at once: spans, 64-bit hashes and shingles by numpy.

A word's hash is a polynomial over its bytes modulo 2**64, got for all words
from one prefix sum, then mixed; equal words have equal hashes, and different
ones differ but for a chance of about 2**-64 a pair.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from folioforge.llm.common import text_bytes

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_STEP = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F)]

#: Byte classes. SPACED: words are what stands between ASCII white space, and A-Z fold to a-z.
_space = np.zeros(256, bool)
_space[[0x20, *range(9, 14)]] = True
_alnum = np.zeros(256, bool)
_alnum[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
IS_SPACE, IS_WORD = _space, _alnum
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_SHORT = 1 << 12


def _series(base: np.uint64, n: int) -> np.ndarray:
    a = np.full(n, base, np.uint64)
    a[0] = 1
    return np.multiply.accumulate(a)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n, made anew each time: a long text's would stay for good."""
    return tuple(
        (_series(np.multiply.accumulate(np.full(_SHORT, base, np.uint64))[-1], -(-n // _SHORT))[:, None] * _series(base, _SHORT)).reshape(-1)[:n]
        for base in (_BASE, _BASE_INV)
    )


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Words:
    """Words of a column: ``start``/``end`` are byte positions in ``data``;
    row r owns the words ``first[r]`` to ``first[r + 1]``."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def scan(col: pa.Array, *, fold: bool = True, alnum: bool = False) -> Words:
    """``alnum``: words are runs of ASCII letters and digits and of non-ASCII
    characters (with Latin-1 letters folded too); else runs of anything but ASCII
    white space. ``fold``: A-Z hash as a-z. Nulls and empty texts have no words."""
    raw, offsets = text_bytes(col)
    n, rows = len(raw), len(offsets) - 1
    none = np.zeros(0, np.int64)
    if not n:
        return Words(raw, offsets, none, none, np.zeros(rows + 1, np.int64), np.zeros(0, np.uint64))
    inside = IS_WORD[raw] if alnum else ~IS_SPACE[raw]
    data = LOWER[raw] if fold else raw
    if fold and alnum:
        upper = np.zeros(n, bool)
        upper[1:] = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E)
        data = data.copy()
        data[upper] += 0x20
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | cut[:n]))
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | cut[1:])) + 1
    up, down = _power(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
    h = mix((total[end] - total[start]) * down[start])
    return Words(raw, offsets, start, end, np.searchsorted(start, offsets), h)


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's ``k``-word windows in order (all its words as one where
    there are fewer; none without words), and where each row's begin."""
    h, n = words.hash, words.counts
    size = np.where(n == 0, 0, np.maximum(1, n - k + 1))
    first = np.concatenate([[0], np.cumsum(size)])
    total = len(h)
    wide = np.zeros(max(0, total - k + 1), np.uint64)
    if len(wide):
        for i in range(k):
            wide += h[i : total - k + 1 + i] * _STEP[i]
    out = np.zeros(first[-1], np.uint64)
    full = np.flatnonzero(n >= k)
    if len(full):
        length = size[full]
        at = np.repeat(words.first[full] - first[full], length)
        to = np.repeat(first[full] - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
        out[to] = wide[to + at]
    for r in np.flatnonzero((n > 0) & (n < k)):
        s = words.first[r]
        x = np.full(1, n[r], np.uint64)
        for i in range(n[r]):
            x += h[s + i : s + i + 1] * _STEP[i]
        out[first[r]] = x[0]
    return mix(out), first


def window_counts(words: Words, k: int) -> np.ndarray:
    """For each word: whether it lies in a ``k``-word window that its row has twice or more."""
    h, n = words.hash, words.counts
    total = len(h)
    marked = np.zeros(total, bool)
    if total < k:
        return marked
    wide = np.zeros(total - k + 1, np.uint64)
    for i in range(k):
        wide += h[i : total - k + 1 + i] * _STEP[i]
    row = np.repeat(np.arange(len(n)), n)
    at = np.flatnonzero(row[: total - k + 1] == row[k - 1 :])
    key = mix(mix(wide[at]) + row[at].astype(np.uint64) * _STEP[0])
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    same = np.zeros(len(at), bool)
    equal = ordered[1:] == ordered[:-1]
    same[1:] |= equal
    same[:-1] |= equal
    hit = at[order[same]]
    for i in range(k):
        marked[hit + i] = True
    return marked
