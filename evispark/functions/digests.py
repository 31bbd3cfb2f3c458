"""md5 of many short texts at once, in numpy: for draws that SQL can make too."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

_SHIFTS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_SINES = [int(abs(math.sin(i + 1)) * (1 << 32)) for i in range(64)]
_PLACES = [i if i < 16 else (5 * i + 1) % 16 if i < 32 else (3 * i + 5) % 16 if i < 48 else 7 * i % 16 for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Numbers that a step takes together.
TOGETHER = 8192


@lru_cache(64)
def decimals(low: int, high: int) -> np.ndarray:
    """The digits of numbers low to high - 1, which have equally many, as bytes."""
    size = len(str(low))
    return (np.arange(low, high)[:, None] // 10 ** np.arange(size - 1, -1, -1) % 10 + 48).astype(np.uint8)


def heads(prefix: bytes, digits: np.ndarray) -> np.ndarray:
    """The first 32 bits of the md5 of prefix and each row of digits, together at most 55 bytes."""
    size = len(prefix) + digits.shape[1]
    if size > 55:
        raise ValueError("texts are longer than a block")
    m = np.zeros((len(digits), 64), np.uint8)
    m[:, : len(prefix)] = np.frombuffer(prefix, np.uint8)
    m[:, len(prefix) : size] = digits
    m[:, size] = 0x80
    words = [np.ascontiguousarray(w) for w in m.view("<u4").T[: size // 4 + 1]]
    a, b, c, d = (np.full(len(digits), x, np.uint32) for x in _START)
    for i in range(64):
        if i < 16:
            f = b & (c ^ d)
            f ^= d
        elif i < 32:
            f = d & (b ^ c)
            f ^= c
        elif i < 48:
            f = b ^ c
            f ^= d
        else:
            f = b | ~d
            f ^= c
        k = _PLACES[i]
        f += a
        f += np.uint32((_SINES[i] + (size * 8 if k == 14 else 0)) & 0xFFFFFFFF)
        if k < len(words):
            f += words[k]
        high = f >> np.uint32(32 - _SHIFTS[i])
        f <<= np.uint32(_SHIFTS[i])
        f |= high
        f += b
        a, d, c, b = d, c, b, f
    return (a + np.uint32(_START[0])).byteswap()


def numbered_heads(prefix: bytes, low: int, high: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first number, heads) of the md5 of prefix and each number from low to high - 1, in steps."""
    while low < high:
        stop = min(high, low + TOGETHER, 10 ** len(str(low)))
        yield low, heads(prefix, decimals(low, stop))
        low = stop
