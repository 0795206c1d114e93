"""Vectorised splitting and hashing of texts, straight on the UTF-8 bytes of an Arrow column.

Every separator used by the operators is ASCII, and no byte of a longer UTF-8 sequence is below 0x80,
so words and lines can be found byte by byte without decoding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are worked on in runs of about so many bytes (one longer text is a run of its own).
RUN_BYTES = 1 << 20
_SLICE = 1 << 17

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C55)
_LEN = np.uint64(0xD6E8FEB86659FD93)
#: Odd multipliers of the words of a window, by place.
PLACE = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(n: int) -> np.ndarray:
    p = np.full(n, _BASE, np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


_POWERS = _powers(4096)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: True for bytes of words [^\x20\x09-\x0D]+.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False

#: True for bytes of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (lower-cased letters, digits, all non-ASCII).
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = True
ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True

#: True for bytes that begin a code point.
HEADS = (np.arange(256) & 0xC0) != 0x80


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def runs(offsets: np.ndarray, limit: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about limit bytes together."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def text_runs(column: pa.Array, limit: int = RUN_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, end, bytes, offsets) for runs of the column's texts, offsets from 0."""
    raw, at = column_bytes(column)
    for i, j in runs(at, limit):
        yield i, j, raw[at[i] : at[j]], at[i : j + 1] - at[i]


def word_spans(b: np.ndarray, at: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the words of a run; words never cross texts."""
    inside = table[b]
    if not inside.any():
        none = np.zeros(0, np.int64)
        return none, none, none
    edge = np.zeros(len(b) + 1, bool)
    edge[at] = True
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(at, starts, "right") - 1


def span_hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span (spans in order, disjoint; they may be empty)."""
    size = ends - starts
    out = np.zeros(len(starts), np.uint64)
    full = np.flatnonzero(size > 0)
    if len(full):
        n, s = size[full], starts[full]
        last = np.cumsum(n)
        powers = _POWERS if (longest := int(n.max())) <= len(_POWERS) else _powers(longest)
        # In slices whose arrays stay in a core's cache.
        cuts = np.unique(np.searchsorted(last, np.arange(_SLICE, int(last[-1]) + _SLICE, _SLICE), "right"))
        lo = 0
        for hi in [*cuts.tolist(), len(n)]:
            if hi > lo:
                k = n[lo:hi]
                first = np.cumsum(k) - k
                place = np.arange(int(k.sum())) - np.repeat(first, k)
                part = _BYTE[b[place + np.repeat(s[lo:hi], k)]] * powers[place]
                out[full[lo:hi]] = np.add.reduceat(part, first)
                lo = hi
    return mix(out + size.astype(np.uint64) * _LEN)


def windows(h: np.ndarray, owner: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of windows of so many consecutive words of one text; places are their first words."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    value = np.zeros(n, np.uint64)
    for k in range(size):
        value += h[k : k + n] * PLACE[k]
    at = np.flatnonzero(owner[:n] == owner[size - 1 :])
    return at, mix(value[at])


def per_text(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Number of True bytes of each text of a run."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def line_spans(b: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the \\n-split lines of a run; an empty text has one empty line."""
    breaks = np.flatnonzero(b == 10)
    owner = np.searchsorted(at, breaks, "right") - 1
    texts = np.arange(len(at) - 1)
    starts = np.concatenate([at[:-1], breaks + 1])
    ends = np.concatenate([at[1:], breaks])
    first = np.concatenate([texts, owner])
    order = np.lexsort((starts, first))
    starts, owners = starts[order], first[order]
    order = np.lexsort((ends, first))
    return starts, ends[order], owners
