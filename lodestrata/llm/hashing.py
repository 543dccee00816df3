"""Vectorised 64-bit hashes of the words of many texts at once."""

from __future__ import annotations

import numpy as np

_RNG = np.random.Generator(np.random.PCG64(20240517))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 2**64)
_powers = {}
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def _power(base: int, n: int) -> np.ndarray:
    found = _powers.get(base)
    if found is None or len(found) < n:
        found = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        found[0] = 1
        np.multiply.accumulate(found, out=found)
        if n <= 1 << 23:  # tables for single very long texts aren't kept
            _powers[base] = found
    return found[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hashed_words(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs without ASCII white space) of all texts, and where each text's words begin (n + 1 offsets)."""
    joined = b"\n".join(texts) + b"\n"
    if lower:
        joined = joined.lower()
    x = np.frombuffer(joined, dtype=np.uint8)
    space = SPACE[x]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[0::2], edge[1::2]
    sums = np.zeros(len(x) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[x] * _power(_P, len(x)), out=sums[1:])
    words = mix((sums[ends] - sums[starts]) * _power(_P_INV, len(x))[starts] + (ends - starts).astype(np.uint64))
    lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    begins = np.concatenate(([0], np.cumsum(lengths)))
    return words, np.searchsorted(starts, begins)


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Distinct hashes, sorted, of a text's runs of ``width`` words; of the whole text if it has fewer words."""
    if not len(words):
        return words
    width = min(width, len(words))
    n = len(words) - width + 1
    h = words[:n] + np.uint64(width)
    for j in range(1, width):
        h = mix(h * np.uint64(_P)) + words[j : j + n]
    h = np.sort(mix(h))
    return h[np.concatenate(([True], h[1:] != h[:-1]))]
