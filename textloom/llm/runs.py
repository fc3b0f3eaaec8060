"""Hashes of runs of bytes, many at once: a polynomial of the bytes' codes by prefix sums, then mixed."""

from __future__ import annotations

import numpy as np
import xxhash

_FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]
_BASE = 0x5851F42D4C957F2B
_CODES = np.array([xxhash.xxh3_64_intdigest(bytes([b])) for b in range(256)], np.uint64)
#: Powers are kept for so many bytes, the piece in which callers work; longer runs make their own.
PIECE = 1 << 18


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _FACTORS[1]
    return h ^ (h >> np.uint64(29))


def factor(k: int) -> np.uint64:
    return _FACTORS[k % len(_FACTORS)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of _BASE and of its inverse modulo 2 ** 64."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        steps = np.full(n, base, np.uint64)
        steps[:1] = 1
        out.append(np.cumprod(steps))
    return out[0], out[1]


_KEPT = _powers(2 * PIECE)


def hashes(piece: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of a piece of bytes; equal runs have equal hashes, wherever they stand."""
    n = len(piece)
    up, down = _KEPT if n <= len(_KEPT[0]) else _powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_CODES.take(piece) * up[:n], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts])
