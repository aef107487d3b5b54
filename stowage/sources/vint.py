"""Variable-length integers of the archive format.

The leading zeros of the first byte tell how many bytes follow; its low bits
are the high part, later bytes are little-endian, and each length starts where
the shorter one ended, so every value has one spelling.
"""

from __future__ import annotations

import numpy as np

from .errors import ParseError

#: Where each length's values start: 0, 2^7, 2^7 + 2^14, and so on.
BIAS = [0]
for _k in range(1, 9):
    BIAS.append(BIAS[-1] + (1 << (7 * _k)))
U64 = (1 << 64) - 1


_SHORT = [bytes([0x80 | k]) for k in range(128)]


def encode_vu64(value: int) -> bytes:
    if 0 <= value < 128:
        return _SHORT[value]
    if not 0 <= value <= U64:
        raise ValueError(f"{value} is not an unsigned 64-bit value")
    n = next((k for k in range(8) if value < BIAS[k + 1]), 8)
    raw = value - BIAS[n]
    low = raw & ((1 << (8 * n)) - 1)
    head = (0x80 >> n) | (raw >> (8 * n)) if n < 8 else 0
    return bytes([head]) + low.to_bytes(n, "little")


def decode_vu64(data: bytes, at: int = 0, end: int | None = None) -> tuple[int, int]:
    """(value, place after it); end: where the bytes to read from end, if before all of them."""
    end = len(data) if end is None else end
    if at >= end:
        raise ParseError("integer past the end", at)
    head = data[at]
    if head >= 0x80:
        return head & 0x7F, at + 1
    n = 8 - head.bit_length()
    stop = at + 1 + n
    if stop > end:
        raise ParseError("integer is cut off", at)
    high = head & ((0x80 >> n) - 1) if n < 8 else 0
    value = (high << (8 * n) | int.from_bytes(data[at + 1 : stop], "little")) + BIAS[n]
    if value > U64:
        raise ParseError("integer exceeds 64 bits", at)
    return value, stop


def zigzag(value: int) -> int:
    return value << 1 if value >= 0 else ((-value) << 1) - 1


def unzigzag(value: int) -> int:
    return (value >> 1) ^ -(value & 1)


def encode_vi64(value: int) -> bytes:
    return encode_vu64(zigzag(value))


def decode_vi64(data: bytes, at: int = 0) -> tuple[int, int]:
    value, stop = decode_vu64(data, at)
    return unzigzag(value), stop


def vu_sizes(values: np.ndarray) -> np.ndarray:
    """The length of each value's spelling."""
    return 1 + np.searchsorted(np.array(BIAS[1:], np.uint64), values.astype(np.uint64), "right")


def put_vu(out: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
    """Spells values into bytes, each at its place."""
    values, sizes = values.astype(np.uint64), vu_sizes(values)
    for n in np.unique(sizes).tolist():
        n -= 1
        mine = sizes == n + 1
        raw, p = values[mine] - np.uint64(BIAS[n]), at[mine]
        out[p] = (0x80 >> n) | (raw >> np.uint64(8 * n) if n < 8 else 0)
        for k in range(n):
            out[p + 1 + k] = (raw >> np.uint64(8 * k)) & np.uint64(0xFF)


def get_vu(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values spelled at these places, and the places after them; an IndexError where one is cut off."""
    head = data[at]
    sizes = 1 + 8 - np.frexp(head.astype(np.float64))[1]
    values = np.empty(len(at), np.uint64)
    for n in np.unique(sizes).tolist():
        n -= 1
        mine = sizes == n + 1
        raw, p = np.zeros(int(mine.sum()), np.uint64), at[mine]
        for k in range(n):
            raw |= data[p + 1 + k].astype(np.uint64) << np.uint64(8 * k)
        high = (head[mine] & ((0x80 >> n) - 1 if n < 8 else 0)).astype(np.uint64)
        values[mine] = raw + (high << np.uint64(8 * n) if n < 8 else np.uint64(0)) + np.uint64(BIAS[n])
        if n == 8 and (values[mine] < np.uint64(BIAS[8])).any():
            raise IndexError("an integer exceeds 64 bits")
    return values, at + sizes
