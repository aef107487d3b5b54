"""NumPy kernels over the buffers of Arrow string columns.

Texts are handled as UTF-8 bytes in blocks of at most ``BLOCK`` bytes (one
longer text makes a block of its own), so memory follows the block and never
the partition.  All hashes are 64-bit and depend on content alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 19

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)

#: White space of the contracts: blank and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: tuple[np.ndarray, np.ndarray] | None = None


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, up to n."""
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size = max(n, BLOCK + 1)
        up, down = np.full(size, _BASE, _U), np.full(size, _BASE_INV, _U)
        up[0] = down[0] = 1
        _powers = np.cumprod(up, dtype=_U), np.cumprod(down, dtype=_U)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words (the splitmix64 constants)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and len+1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    _, offs, data = column.buffers()
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offs, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets


def blocks(raw: np.ndarray, offsets: np.ndarray, size: int = BLOCK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets from 0) of runs of whole texts."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and len(texts)+1 offsets into them.

    A word is a maximal run of bytes other than white space in one text.
    """
    inside = ~SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each byte span, from one running polynomial sum."""
    up, down = _power_tables(len(data) + 1)
    run = np.empty(len(data) + 1, _U)
    run[0] = 0
    np.cumsum((data.astype(_U) + _U(1)) * up[: len(data)], dtype=_U, out=run[1:])
    return mix((run[ends] - run[starts]) * down[starts] + (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93))


def gram_hashes(data: np.ndarray, q: int) -> np.ndarray:
    """A hash of the q bytes at each start (len - q + 1 of them)."""
    n = len(data) - q + 1
    if n <= 0:
        return np.zeros(0, _U)
    up, down = _power_tables(len(data) + 1)
    run = np.empty(len(data) + 1, _U)
    run[0] = 0
    np.cumsum((data.astype(_U) + _U(1)) * up[: len(data)], dtype=_U, out=run[1:])
    return mix((run[q:] - run[:-q]) * down[:n])


_TURN = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = 5) -> Iterator[np.ndarray]:
    """Per text the sorted distinct hashes of its k-word shingles.

    Words are taken after lower-casing A-Z.  A text of 1 to k-1 words gives
    one shingle, the whole sequence; a text without words gives none.
    """
    data = LOWER[data]
    starts, ends, at = words(data, offsets)
    h = span_hashes(data, starts, ends)
    full = np.zeros(0, _U)
    if len(h) >= k:
        full = np.zeros(len(h) - k + 1, _U)
        for i in range(k):
            full += (h[i : i + len(full)] ^ _U(i + 1)) * _U(_TURN[i % 5] + 2 * (i // 5))
        full = mix(full)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= k:
            s = np.sort(full[a : b - k + 1])
            keep = np.empty(len(s), bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            yield s[keep]
        elif b > a:
            x = _U(b - a)
            for w in h[a:b]:
                x = mix(np.array([x ^ w], _U) * _U(_BASE))[0]
            yield np.array([x], _U)
        else:
            yield np.zeros(0, _U)
