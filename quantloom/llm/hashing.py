"""Vectorised hashing of bytes, windows, words and shingles. All numbers wrap at 64 bits."""

from __future__ import annotations

import functools

import numpy as np

U = np.uint64
_random = np.random.default_rng(20240501)
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
BYTE_VALUES = _random.integers(1, 2**63, (2, 256), dtype=np.uint64) * U(2) + U(1)
WORD_VALUES = _random.integers(1, 2**63, 16, dtype=np.uint64) * U(2) + U(1)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection whose every output bit depends on every input bit."""
    x = x ^ (x >> U(31))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@functools.lru_cache(maxsize=4)
def _powers(size: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    base = BASES[which] | 1
    up, down = np.full(size, U(base)), np.full(size, U(pow(base, -1, 2**64)))
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n).bit_length())
    return _powers(size, which)


class Prefixes:
    """Polynomial hashes of all substrings of ``data`` from one pass over it."""

    def __init__(self, data: np.ndarray, which: int = 0):
        up, self.down = powers(len(data) + 1, which)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_VALUES[which][data] * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def windows(self, width: int) -> np.ndarray:
        n = len(self.sums) - width
        return mix((self.sums[width:] - self.sums[:n]) * self.down[:n])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, by running minima of blocks from both ends."""
    n = len(values)
    padded = np.full(-(-n // width) * width, U(2**64 - 1))
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    from_left = np.minimum.accumulate(blocks, axis=1).ravel()
    from_right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(from_right[: n - width + 1], from_left[width - 1 : n])


def word_hashes(text: bytes) -> np.ndarray:
    """A hash of each word, in order; white space separates words."""
    data = np.frombuffer(text, np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64)
    space = np.concatenate([[True], IS_SPACE[data], [True]])
    edge = np.flatnonzero(space[1:] != space[:-1])
    return Prefixes(data).of(edge[::2], edge[1::2])


def shingles(text: bytes, words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The distinct runs of ``words`` words as sorted hashes, and how often each occurs. A shorter text with words is one run."""
    w = word_hashes(text)
    if not len(w):
        return w, np.zeros(0, np.int64)
    k = min(words, len(w))
    n = len(w) - k + 1
    total = np.full(n, U(k))
    for j in range(k):
        total = total + w[j : j + n] * WORD_VALUES[j]
    return np.unique(mix(total), return_counts=True)
