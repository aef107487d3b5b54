"""Many entries as one compressed binary value, for shuffles of columns in blocks."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import pickle

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column
from pyspark.sql import functions as F


def pack(*arrays) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(arrays, protocol=5))


def unpack(body: bytes) -> tuple:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(body))


def planes(x: np.ndarray, width: int) -> np.ndarray:
    """The lowest ``width`` bytes of each number, all first bytes first; high bytes that repeat compress to nothing."""
    return np.ascontiguousarray(np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width].T)


def unplaned(x: np.ndarray) -> np.ndarray:
    """The numbers (uint64) that ``planes`` took apart."""
    out = np.zeros((x.shape[1], 8), np.uint8)
    out[:, : x.shape[0]] = x.T
    return out.reshape(-1).view("<u8").astype(np.uint64)


_U32 = np.uint32


def _hashed(numbers: np.ndarray, seed: np.ndarray | int) -> np.ndarray:
    """Murmur3 (x86, 32 bits) of 4-byte numbers, by which Spark's hash partitioning deals an int."""
    with np.errstate(over="ignore"):
        k = numbers.astype(_U32) * _U32(0xCC9E2D51)
        k = ((k << _U32(15)) | (k >> _U32(17))) * _U32(0x1B873593)
        h = np.broadcast_to(np.asarray(seed, _U32), k.shape) ^ k
        h = ((h << _U32(13)) | (h >> _U32(19))) * _U32(5) + _U32(0xE6546B64)
        h = h ^ _U32(4)
        h = (h ^ (h >> _U32(16))) * _U32(0x85EBCA6B)
        h = (h ^ (h >> _U32(13))) * _U32(0xC2B2AE35)
        return h ^ (h >> _U32(16))


def labels(parts: int, *before: int) -> np.ndarray:
    """For each of ``parts`` tasks, an int that a shuffle by (``before``, int) deals to a task of its own.

    A shuffle hashes its keys, so parts numbered 0, 1, 2 would leave a third of
    the tasks empty and give others several.  Should Spark deal otherwise, only
    the balance is lost.
    """
    out, tried = np.full(parts, -1, np.int32), 0
    while (out < 0).any():
        k = np.arange(tried, tried + 16 * parts)
        tried += 16 * parts
        h: np.ndarray | int = 42
        for b in before:
            h = _hashed(np.full(len(k), b), h)
        to = _hashed(k, h).view(np.int32).astype(np.int64) % parts
        first, at = np.unique(to, return_index=True)
        new = out[first] < 0
        out[first[new]] = k[at[new]]
    return out


class Deal:
    """How hashed values are dealt to parts: ``by_part`` for shuffles by part, ``by_kind`` for those by (kind 0, part)."""

    def __init__(self, parts: int):
        self.parts, self._one, self._two = parts, labels(parts), labels(parts, 0)

    def by_part(self, words: np.ndarray) -> np.ndarray:
        return self._one[(words % np.uint64(self.parts)).astype(np.int64)]

    def by_kind(self, words: np.ndarray) -> np.ndarray:
        return self._two[(words % np.uint64(self.parts)).astype(np.int64)]

    def column(self, number: Column) -> Column:
        """The label of a part's number (0 on) in shuffles by part."""
        return F.element_at(F.array(*[F.lit(int(k)) for k in self._one]), number + 1)


_settled = False


def release() -> None:
    """Gives a Python worker's free memory back; workers live on between tasks beside the executor's heap.

    What a worker holds at the first time, mostly its modules, is not looked
    through again by later collections, which took longer than some tasks.
    """
    global _settled
    gc.collect()
    if not _settled:
        gc.freeze()
        _settled = True
    give_back()


def give_back() -> None:
    """Gives this process's freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)
