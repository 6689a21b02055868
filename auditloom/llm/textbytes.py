"""Words and fixed-length strings of many texts at once, as 64-bit fingerprints in numpy.

A string's fingerprint is a sum of byte weights times powers of an odd base
modulo 2**64, so fingerprints of all words come from one running sum. Byte
weights are pseudo-random and results are mixed. Equal strings always agree;
different ones agree with a probability of about n**2 / 2**65 among n strings.
"""

from __future__ import annotations

import numpy as np

from auditloom.llm.common import mix64

BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that it can be inverted modulo 2**64
_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
WEIGHTS = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)
PLACES = mix64(np.arange(101, 133, dtype=np.uint64)) | np.uint64(1)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((BASE, _INVERSE)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers[i] = np.cumprod(p, dtype=np.uint64)
    return _powers[0], _powers[1]


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case; other bytes stay."""
    return _LOWER[data]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint of each word (bytes other than space and 9 to 13), and for each row the number of words before it."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    solid = ~_SPACE[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    edges = offsets[1:-1]
    edges = edges[edges < n]
    begins[edges] = solid[edges]  # a word never goes on in the next row
    starts = np.flatnonzero(begins)
    ends_mask = solid.copy()
    ends_mask[:-1] &= ~solid[1:] | begins[1:]
    ends = np.flatnonzero(ends_mask) + 1
    power, inverse = _grown(n)
    run = np.empty(n + 1, np.uint64)
    run[0] = 0
    np.cumsum(WEIGHTS[data] * power[:n], dtype=np.uint64, out=run[1:])
    return mix64((run[ends] - run[starts]) * inverse[starts]), np.searchsorted(starts, offsets)


def shingles(prints: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints of all runs of ``size`` words of one row; of the whole row where it has fewer."""
    n = len(prints)
    if n == 0:
        return prints
    k = min(size, n)
    total = prints[: n - k + 1] * PLACES[0]
    for i in range(1, k):
        total = total + prints[i : n - k + 1 + i] * PLACES[i]
    return mix64(total + np.uint64(k))


_MIX = mix64(np.arange(201, 205, dtype=np.uint64)) | np.uint64(1)
_HALF = np.uint64(32)


def _eights(data: np.ndarray) -> np.ndarray:
    """The 8 bytes at each place as a number."""
    return np.ndarray(max(0, len(data) - 7), "<u8", np.ascontiguousarray(data).data, strides=(1,)) if len(data) > 7 else np.zeros(0, np.uint64)


def names32(data: np.ndarray) -> np.ndarray:
    """A name of 64 bits for the 32 bytes at each place: a filter, since some pairs clash more often than chance."""
    if len(data) < 32:
        return np.zeros(0, np.uint64)
    eight = _eights(data) * _MIX[0]
    eight ^= eight >> _HALF
    two = eight[:-8] * PLACES[0]
    two += eight[8:] * PLACES[1]
    four = two[:-16] * PLACES[2]
    four += two[16:] * PLACES[3]
    return mix64(four)


def names_at(data: np.ndarray, places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of 64 and of 32 bits for the ``length`` bytes (8 or more) at some places. The first is a chain
    over words of 8 bytes, each step mixed in full; the second adds up the chain's states."""
    eight = _eights(data)
    one, other = np.full(len(places), _MIX[1]), np.zeros(len(places), np.uint64)
    for offset in [*range(0, length - 8, 8), length - 8]:
        one ^= eight[places + offset]
        one *= _MIX[2]
        one ^= one >> _HALF
        other += one
        other *= _MIX[3]
    return mix64(one), (mix64(other) >> _HALF).astype(np.uint32)
