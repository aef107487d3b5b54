"""How often hashed tokens occur, in a table of fixed size.

Set-similarity joins order tokens by rarity.  Any fixed order gives exact
results, so tokens may share a counter; counts are never too low.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .packing import pack, release, unpack

#: 4 bytes each on the driver and in a broadcast.
SLOTS = 1 << 21
#: Tasks that add up the tables of the partitions.
ADDERS = 8

_U = np.uint64


def slot_of(token: np.ndarray) -> np.ndarray:
    return (token >> _U(65 - SLOTS.bit_length())).astype(np.int64)


def _packed(total: np.ndarray) -> pa.RecordBatch:
    used = np.flatnonzero(total)
    return pa.RecordBatch.from_arrays([pa.array([pack(used.astype(np.int32), total[used])], pa.binary())], names=["body"])


def slot_counts(df: DataFrame, tokens: Callable[[pa.RecordBatch], Iterator[np.ndarray]]) -> np.ndarray:
    """Occurrences by slot of the tokens that ``tokens`` gives for each batch of df."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        pending, size = [], 0
        for b in batches:
            for token in tokens(b):
                pending.append(slot_of(token).astype(np.int32))
                size += len(token)
                if size >= 1 << 20:
                    total += np.bincount(np.concatenate(pending), minlength=SLOTS)
                    pending, size = [], 0
        if pending:
            total += np.bincount(np.concatenate(pending), minlength=SLOTS)
        yield _packed(total)
        release()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for b in batches:
            for body in b.column("body").to_pylist():
                used, n = unpack(body)
                total[used] += n
        yield _packed(total)
        release()

    total = np.zeros(SLOTS, np.int64)
    for r in df.mapInArrow(count, "body binary").repartition(ADDERS).mapInArrow(add, "body binary").toLocalIterator():
        used, n = unpack(r["body"])
        total[used] += n
    return np.minimum(total, 2**31 - 1).astype(np.int32)
