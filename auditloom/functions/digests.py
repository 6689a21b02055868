"""The numbers of ``rng.uniform`` for many texts at once: MD5 of one block, step by step over arrays."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa

_SHIFTS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_SINES = [np.uint32(int(abs(v) * 4294967296)) for v in np.sin(np.arange(1, 65, dtype=float))]
_WORDS = ([i for i in range(16)], [(5 * i + 1) % 16 for i in range(16)], [(3 * i + 5) % 16 for i in range(16)], [7 * i % 16 for i in range(16)])
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Texts at once: the arrays of a step stay in a core's cache.
TEXTS = 32768


def parts(texts: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes, as ``heads`` takes them."""
    _, offsets, data = texts.buffers()
    return np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1], np.frombuffer(data or b"", np.uint8)


def heads(prefixes: Sequence[bytes], offsets: np.ndarray, data: np.ndarray) -> Iterator[tuple[int, slice, np.ndarray]]:
    """``prefix's place, slice of texts, first four bytes of md5(prefix + text) as whole numbers``, for every prefix and
    text; ``offsets`` has one more number than there are texts, whose bytes lie in ``data`` one after the other."""
    n = len(offsets) - 1
    for a in range(0, n, TEXTS):
        at, ends = slice(a, min(n, a + TEXTS)), offsets[a : a + TEXTS + 1].astype(np.int64)
        sizes, own = np.diff(ends), data[ends[0] : ends[-1]]
        row = np.repeat(np.arange(len(sizes)), sizes)
        column = np.arange(len(own)) - np.repeat(ends[:-1] - ends[0], sizes)
        by_size: dict[int, list] = {}
        for i, p in enumerate(prefixes):
            by_size.setdefault(len(p), []).append(i)
        for size, members in by_size.items():
            if size + sizes.max() > 55:  # more than one block
                for i in members:
                    texts = (own[s:e].tobytes() for s, e in zip(ends[:-1] - ends[0], ends[1:] - ends[0], strict=True))
                    yield i, at, np.array([int.from_bytes(hashlib.md5(prefixes[i] + t).digest()[:4], "big") for t in texts], np.uint32)
                continue
            block = np.zeros((len(sizes), 64), np.uint8)
            block[row, column + size] = own
            block[np.arange(len(sizes)), sizes + size] = 0x80
            words = np.ascontiguousarray(block.view("<u4").T)
            words[14] = (sizes + size) * 8
            used = [w if w.any() else None for w in words]
            for i in members:
                first = np.frombuffer(prefixes[i].ljust(-size % 4 + size, b"\0"), "<u4")
                yield i, at, _first_word([(words[k] | first[k] if k < len(first) else used[k]) for k in range(16)], len(sizes)).byteswap()


def _first_word(words: Sequence[np.ndarray | None], n: int) -> np.ndarray:
    a, b, c, d = (np.full(n, s, np.uint32) for s in _START)
    f, spare = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(61):  # the last three steps do not touch the first word
        turn = i // 16
        if turn == 0:
            np.bitwise_and(np.bitwise_xor(c, d, out=f), b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif turn == 1:
            np.bitwise_and(np.bitwise_xor(b, c, out=f), d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif turn == 2:
            np.bitwise_xor(np.bitwise_xor(b, c, out=f), d, out=f)
        else:
            np.bitwise_or(np.invert(d, out=f), b, out=f)
            np.bitwise_xor(f, c, out=f)
        np.add(f, a, out=f)
        np.add(f, _SINES[i], out=f)
        word, s = words[_WORDS[turn][i % 16]], _SHIFTS[turn][i % 4]
        if word is not None:
            np.add(f, word, out=f)
        np.left_shift(f, np.uint32(s), out=spare)
        np.right_shift(f, np.uint32(32 - s), out=f)
        np.bitwise_or(f, spare, out=f)
        np.add(f, b, out=f)
        a, b, c, d, f = d, f, b, c, a
    return b + np.uint32(_START[0])
