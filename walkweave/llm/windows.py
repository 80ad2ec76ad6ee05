"""Names of all windows of a sequence, by doubling.

A window of 2n symbols is named by the names of its two halves, so windows of
any length need only a logarithmic number of steps over the sequence.  Names are
64-bit hashes; two lanes with different constants make 128 bits together, which
stand for the window itself.
"""

from __future__ import annotations

import numpy as np
import xxhash

_LANES = ((0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93), (0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F))


def _pair(a: np.ndarray, b: np.ndarray, lane: int) -> np.ndarray:
    """Names for pairs of names."""
    x, y = _LANES[lane]
    out = a * np.uint64(x)
    out ^= b
    out ^= out >> np.uint64(32)
    out *= np.uint64(y)
    out ^= out >> np.uint64(29)
    return out


def window_names(symbols: np.ndarray, length: int, lane: int) -> np.ndarray:
    """The name of each window of ``length`` symbols (uint64), by the binary digits of ``length``."""
    count = len(symbols) - length + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    level, size, done, names = symbols, 1, 0, None
    parts = []
    while True:
        if length & size:
            parts.append((size, level))
        if 2 * size > length:
            break
        level = _pair(level[: len(level) - size], level[size:], lane)
        size *= 2
    for size, level in reversed(parts):
        part = level[done : done + count]
        names = part if names is None else _pair(names, part, lane)
        done += size
    return names.copy() if names is symbols[:count] else names


def word_symbols(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Two lanes of a 128-bit hash of each word."""
    both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), "<u8").reshape(-1, 2)
    return np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])


#: A random symbol for each byte value and lane (from a rule, so that all workers have the same).
BYTE_SYMBOLS = tuple(np.array([xxhash.xxh64_intdigest(bytes([b]), seed=17 + lane) for b in range(256)], np.uint64) for lane in (0, 1))


def byte_symbols(data: bytes, lane: int) -> np.ndarray:
    return BYTE_SYMBOLS[lane][np.frombuffer(data, np.uint8)]


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    count = len(values) - width + 1
    level, size = values, 1
    while 2 * size <= width:
        level = np.minimum(level[: len(level) - size], level[size:])
        size *= 2
    return np.minimum(level[:count], level[width - size : width - size + count])
