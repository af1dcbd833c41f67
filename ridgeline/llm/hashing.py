"""Vectorised hashes of words and of stretches of words."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import xxhash

#: Odd constants.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def joined(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The hash of a stretch from the hashes of its two parts; not linear in either, and the order counts."""
    return mix(mix(x) * np.uint64(BASES[0]) + y * np.uint64(BASES[1]))


def word_digests(words: list[bytes]) -> np.ndarray:
    """128-bit hashes of words, as rows of two 64-bit numbers."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), np.uint64).reshape(-1, 2)


def window_digests(words: np.ndarray, length: int) -> np.ndarray:
    """128-bit digests of all stretches of `length` words, from the words' digests: two hashes that share no input,
    each put together from those of stretches of 1, 2, 4, ... words. A row for each start; `length` is 1 at least."""
    n = len(words) - length + 1
    if n <= 0:
        return np.empty((0, 2), np.uint64)
    out = []
    for h in words.T:
        power, size, done, have = h, 1, None, 0
        while size <= length:
            if length & size:
                done = power[:n] if done is None else joined(done[:n], power[have : have + n])
                have += size
            if 2 * size <= length:
                power = joined(power[:-size], power[size:])
            size *= 2
        out.append(mix(done))
    return np.stack(out, 1)


@lru_cache(32)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n + 1 powers of base and of its inverse, modulo 2**64."""
    up, down = np.full(n + 1, base, np.uint64), np.full(n + 1, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


class Rolling:
    """Hashes of short stretches (some dozens of words), all of one length at once, from prefix sums modulo 2**64."""

    def __init__(self, words: np.ndarray, base: int) -> None:
        self.up, down = _powers(base, 1 << len(words).bit_length())
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * down[: len(words)])])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.up[start])
