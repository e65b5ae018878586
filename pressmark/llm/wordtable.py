"""Words of many texts at once, as byte positions and 64-bit hashes in numpy arrays.

Word classes are closed under UTF-8: every byte of a non-ASCII character is 0x80 or more, so a table
of 256 bytes tells words from gaps without decoding.  A word's hash is a polynomial over random
64-bit values of its bytes; all words of a slice follow from one running sum.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BYTES = np.random.default_rng(20240601).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_GRAM = np.random.default_rng(20240602).integers(1, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Digits, letters and everything beyond ASCII.
LETTERS = np.zeros(256, bool)
LETTERS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, _INVERSE)):
            grown = np.full(size, base, np.uint64)
            grown[0] = 1
            _powers[k] = np.multiply.accumulate(grown)
    return _powers[0][:n], _powers[1][:n]


@dataclass
class Words:
    """``bytes`` of all texts; word j is bytes[starts[j]:ends[j]]; text i holds words bounds[i]:bounds[i + 1]."""

    bytes: np.ndarray
    edges: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts())

    def hashes(self) -> np.ndarray:
        """One hash a word."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        power, inverse = _power_tables(len(self.bytes))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[self.bytes] * power, dtype=np.uint64)])
        return mix((total[self.ends] - total[self.starts]) * inverse[self.starts])


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column (null: empty) and where each text begins, with the end."""
    texts = pc.fill_null(texts, "")
    if pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.string())
    _, offsets, data = texts.buffers()
    edges = np.frombuffer(offsets, np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    if data is None or edges[-1] == edges[0]:
        return np.zeros(0, np.uint8), edges - edges[0]
    return np.frombuffer(data, np.uint8)[edges[0]:edges[-1]], edges - edges[0]


def words_of(texts: pa.Array, letters: np.ndarray, lower: bool = True) -> Words:
    raw, edges = text_bytes(texts)
    data = LOWER[raw] if lower else raw
    inside = letters[data]
    before = np.concatenate([[False], inside[:-1]]) if len(inside) else inside
    after = np.concatenate([inside[1:], [False]]) if len(inside) else inside
    if len(inside):
        first = edges[:-1][edges[:-1] < len(data)]
        before[first] = False
        last = edges[1:][edges[1:] > 0] - 1
        after[last] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return Words(data, edges, starts, ends, np.searchsorted(starts, edges))


def hash_of(word: str) -> int:
    return int(words_of(pa.array([word]), np.ones(256, bool)).hashes()[0])


def gram_hashes(hashes: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``n``-word windows and the bounds of each text's windows.

    A text of fewer words, but at least one, has one window: its whole sequence.
    """
    counts = np.diff(bounds)
    windows = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    out_bounds = np.concatenate([[0], np.cumsum(windows)])
    begin = np.repeat(bounds[:-1], windows) + np.arange(out_bounds[-1]) - np.repeat(out_bounds[:-1], windows)
    width = np.repeat(np.minimum(counts, n), windows)
    padded = np.concatenate([hashes, np.zeros(n, np.uint64)])
    total = width.astype(np.uint64)
    for k in range(n):
        total = total + np.where(width > k, padded[begin + k] * _GRAM[k], np.uint64(0))
    return mix(total), out_bounds
