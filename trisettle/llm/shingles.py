"""Sets of word shingles as sorted 64-bit hashes, with numpy over the bytes of a text.

Words are hashed by prefix sums of a polynomial modulo 2**64 and mixed; two different shingles of a pair of texts
share a hash with a chance of about (shingles of both)**2 / 2**64.
"""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of the base and of its inverse, grown as longer texts come."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, 2 * len(self.up), 1 << 16)
            factors = np.full((2, size), [[BASE], [INVERSE]], np.uint64)
            factors[:, 0] = 1
            self.up, self.down = np.cumprod(factors, axis=1, dtype=np.uint64)
        return self.up, self.down


POWERS = Powers()


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums; the hash of data[a:b] is (sums[b] - sums[a]) * down[a]."""
    up, _ = POWERS.to(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTES[data] * up[: len(data)], out=out[1:])
    return out


def word_hashes(text: str) -> np.ndarray:
    """Hashes of the words of a text with A-Z lowered."""
    data = np.frombuffer(text.encode("utf-8", "replace").lower(), np.uint8)
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~SPACES[data]
    edges = np.diff(inside)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    if not len(starts):
        return np.zeros(0, np.uint64)
    sums = prefix_hash(data)
    return mixed((sums[ends] - sums[starts]) * POWERS.down[starts])


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """The distinct shingles of ``size`` words, sorted; of fewer words the whole sequence as one; none without words."""
    words = word_hashes(text) if text else np.zeros(0, np.uint64)
    if not len(words):
        return words
    if len(words) < size:
        out = np.array([0xD6E8FEB86659FD93 + len(words)], np.uint64)
        for word in words:
            out = mixed(out * np.uint64(BASE) + word)
        return out
    n = len(words) - size + 1
    out = words[:n].copy()
    for k in range(1, size):
        out = mixed(out * np.uint64(BASE) + words[k: n + k])
    return np.unique(out)
