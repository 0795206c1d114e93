"""Hash-derived randomness: a number depends on its key alone, so results don't change with partitioning."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(key: Column) -> Column:
    """[0, 1) from the first 32 bits of the key's md5."""
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def keyed(seed: str, *columns: Column | str) -> Column:
    """The text seed:a:b... of some columns."""
    return F.concat_ws(":", F.lit(seed), *(F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in columns))


def uniform_of(key: str) -> float:
    return int(hashlib.md5(key.encode()).hexdigest()[:8], 16) / 4294967296.0


def gaussian_of(key: str) -> float:
    """Standard normal by Box-Muller from two hashed uniforms."""
    u = (int(hashlib.md5(f"{key}:a".encode()).hexdigest()[:8], 16) + 0.5) / 4294967296.0
    return math.sqrt(-2 * math.log(u)) * math.cos(2 * math.pi * uniform_of(f"{key}:b"))


def gaussian_matrix(seed: str, rows: int, columns: int) -> np.ndarray:
    return np.array([[gaussian_of(f"{seed}:{r}:{c}") for c in range(columns)] for r in range(rows)])


def uniform_vector(seed: str, n: int) -> np.ndarray:
    return np.array([uniform_of(f"{seed}:{k}") for k in range(n)])


#: Numbers of one length are hashed so many at a time, so that the lanes of all words stay in a core's cache.
LANES = 1 << 14
_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]


def uniforms_of(prefix: str, n: int) -> Iterator[np.ndarray]:
    """uniform_of(prefix + str(t)) for t from 0 to n - 1, some at a time: md5 on whole arrays, several times the speed of a
    call per text. Texts of more than one md5 block take a call each."""
    head, lo = prefix.encode(), 0
    while lo < n:
        digits = len(str(lo))
        hi = min(n, lo + LANES, 10**digits)
        if len(head) + digits > 55:
            yield np.array([uniform_of(f"{prefix}{t}") for t in range(lo, hi)])
        else:
            yield _first_word(head, lo, hi, digits) / 4294967296.0
        lo = hi


def _first_word(head: bytes, lo: int, hi: int, digits: int) -> np.ndarray:
    """The first 32 bits of the md5 of head and each number from lo to hi - 1, all of so many digits."""
    block = bytearray(head + bytes(digits) + b"\x80").ljust(64, b"\0")
    block[56:64] = (8 * (len(head) + digits)).to_bytes(8, "little")
    words: list = [int.from_bytes(block[k : k + 4], "little") for k in range(0, 64, 4)]
    rest = np.arange(lo, hi)
    for at in range(len(head) + digits - 1, len(head) - 1, -1):
        rest, digit = np.divmod(rest, 10)
        words[at // 4] = words[at // 4] + ((digit + 48).astype(np.uint32) << np.uint32(8 * (at % 4)))
    words = [w if isinstance(w, np.ndarray) else int(w) for w in words]
    start = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
    a, b, c, d = (np.full(hi - lo, x, np.uint32) for x in start)
    f, g = np.empty_like(a), np.empty_like(a)
    for i in range(61):  # the last three steps leave the first word as it is
        turn, k = i // 16, (i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16
        if turn < 2:  # the bits of y where x is set, else those of z
            x, y, z = (b, c, d) if turn == 0 else (d, b, c)
            np.bitwise_xor(y, z, out=f)
            np.bitwise_and(f, x, out=f)
            np.bitwise_xor(f, z, out=f)
        elif turn == 2:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        np.add(f, a, out=f)
        if isinstance(words[k], int):
            np.add(f, np.uint32((words[k] + _SINES[i]) % 2**32), out=f)
        else:
            np.add(f, words[k], out=f)
            np.add(f, np.uint32(_SINES[i]), out=f)
        by = _TURNS[turn][i % 4]
        np.left_shift(f, np.uint32(by), out=g)
        np.right_shift(f, np.uint32(32 - by), out=f)
        np.bitwise_or(f, g, out=f)
        np.add(f, b, out=f)
        a, b, c, d, f = d, f, b, c, a
    return (b + np.uint32(start[0])).byteswap()
