"""Benchmark decontamination by q-gram lemma filtering.

A document is contaminated by a benchmark item if some region of it is within
``RATE`` edits a byte of the item's whole text, after lower-casing (A-Z only in
the rare text whose length in bytes that changes) and taking runs of white
space as one blank.  An item of n bytes may lose e =
RATE * n edits; e edits spoil at most q e of its n - q + 1 q-grams, so a region
that matches shares at least n - q + 1 - q e of them, on diagonals that lie
within e of each other.  Shared q-grams are counted in bands of diagonals of
twice the width w >= e + 1, one starting every w, so some band holds them all;
bands that reach the bound are verified by a banded alignment.

The item set is read in blocks of at most ``BLOCK_BYTES`` of text.  The texts
of at most ``PASS_BLOCKS`` blocks are broadcast together, so a pass over the
documents holds a fixed size of items whatever the table's; larger benchmarks
take several passes, each written to the shared folder.  A task indexes one
block at a time and holds it against ``GROUP_BYTES`` of documents.  Documents
are read whole, in blocks of memory of a fixed size.

Edge cases: a null or empty item matches nothing, as does an item under q
bytes unless a document holds it exactly; for short items e is lowered until
the bound is at least 1; of several regions of one item the one of fewest edits
is given, the first in the text where these tie (exact ones first); items of
equal text are all found; a null text is clean; very long texts are searched
whole; null ids and repeated rows get their own rows; all columns of docs are
kept, and the new one is lengthened where docs has its name; an empty table
gives an empty result, an empty benchmark a clean one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, fresh, read
from .kernels import LOWER, SPACE, blocks, gram_hashes, text_bytes

Q, RATE = 10, 0.07
BLOCK_BYTES, PASS_BLOCKS = 4 << 20, 8
GROUP_BYTES, ENTRIES = 32 << 20, 1 << 21
BITS = 22

_U = np.uint64


def normal(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalised bytes, their offsets, and the place each had."""
    space = SPACE[data]
    keep = np.ones(len(data), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    begin = offsets[:-1][offsets[:-1] < len(data)]
    keep[begin] = True
    place = np.flatnonzero(keep)
    out = LOWER[data[place]]
    out[space[place]] = 0x20
    return out, np.searchsorted(place, offsets), place


def lowered(column: pa.Array) -> pa.Array:
    """Lower case where that keeps a text's number of bytes, so places stay."""
    column = column.cast(pa.string())
    low = pc.utf8_lower(column)
    return pc.if_else(pc.equal(pc.binary_length(low), pc.binary_length(column)), low, column)


def trimmed(text: str | None) -> bytes:
    low = lowered(pa.array([text or ""])).to_pylist()[0].encode()
    return b" ".join(low.translate(LOWER.tobytes()).split())


class Items:
    """The q-grams of a block of benchmark items, by hash."""

    def __init__(self, items: list[tuple[int, str | None]], rate: float = RATE, q: int = Q):
        self.q = q
        known = [(i, x) for i, t in items if (x := trimmed(t))]
        self.ids = [i for i, _ in known]
        self.texts = [np.frombuffer(x, np.uint8) for _, x in known]
        n = np.array([len(t) for t in self.texts], np.int64)
        self.edits = np.minimum((n * rate).astype(np.int64), np.maximum((n - q) // q, 0))
        self.need = n - q + 1 - q * self.edits
        self.width = np.maximum(1 << np.ceil(np.log2(self.edits + 1)).astype(np.int64), 1)
        parts = [gram_hashes(t, q) for t in self.texts]
        gram = np.concatenate([*parts, np.zeros(0, _U)]).astype(_U)
        item = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p) for p in parts])
        place = np.concatenate([*(np.arange(len(p), dtype=np.int32) for p in parts), np.zeros(0, np.int32)])
        order = np.argsort(gram, kind="stable")
        gram, self.item, self.place = gram[order], item[order], place[order]
        self.gram, at = np.unique(gram, return_index=True)
        self.at = at.astype(np.int32)
        self.times = np.diff(np.append(self.at, np.int32(len(gram))))
        self.maybe = np.zeros(1 << BITS, bool)
        self.maybe[self.gram >> _U(64 - BITS)] = True
        self.short = [k for k, t in enumerate(self.texts) if len(t) < q]

    def _banded(self, p: np.ndarray, k: np.ndarray, text: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, item, band) and how many q-grams they share, for hits of q-grams k at places p, ENTRIES (or one place) at a time."""
        done: list[tuple[np.ndarray, np.ndarray]] = []
        upto, at = np.cumsum(self.times[k], dtype=np.int64), 0
        while at < len(p):
            stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + ENTRIES, "right")))
            here, gram = p[at:stop], k[at:stop]
            at = stop
            times = self.times[gram].astype(np.int64)
            entry = np.repeat(np.arange(len(here)), times)
            row = self.at[gram][entry] + np.arange(len(entry)) - np.repeat(np.cumsum(times) - times, times)
            item, doc = self.item[row].astype(np.int64), text[here][entry]
            # the diagonal inside the text, shifted so that none is negative
            diagonal = here[entry] - offsets[doc] - self.place[row] + (1 << 32)
            band = diagonal // self.width[item]
            key = np.concatenate([np.stack([doc, item, band]), np.stack([doc, item, band - 1])], axis=1)
            done.append(_merged(key, np.ones(key.shape[1], np.int64)))
            if len(done) > 1 and (at == len(p) or sum(len(c) for _, c in done) > ENTRIES):
                done = [_merged(np.concatenate([x for x, _ in done], axis=1), np.concatenate([c for _, c in done]))]
        return done[0]

    def found(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item, start, stop, edits) of the best verified region of each text and item."""
        data, offsets, place = normal(data, offsets)
        stop_of = np.append(place, place[-1] + 1 if len(place) else 0)
        h = gram_hashes(data, self.q)
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for k in self.short:
            for t in range(len(offsets) - 1):
                at = data[offsets[t] : offsets[t + 1]].tobytes().find(self.texts[k].tobytes())
                if at >= 0:
                    best[t, k] = (0, int(offsets[t] + at), int(offsets[t] + at + len(self.texts[k])))
        p = np.flatnonzero(self.maybe[h >> _U(64 - BITS)]) if len(self.gram) and len(h) else np.zeros(0, np.int64)
        if len(p):
            k = np.minimum(np.searchsorted(self.gram, h[p]), len(self.gram) - 1)
            hit = (self.gram[k] == h[p]) & (p + self.q <= offsets[1:][text[p]])
            p, k = p[hit], k[hit]
        if len(p):
            key, count = self._banded(p, k, text, offsets)
            enough = count >= self.need[key[1]]
            for d, i, b in key[:, enough].T.tolist():
                if (old := best.get((d, i))) is not None and old[0] == 0:
                    continue
                n, e, w = len(self.texts[i]), int(self.edits[i]), int(self.width[i])
                low = b * w - (1 << 32)
                lo = max(int(offsets[d]), int(offsets[d]) + low - e)
                hi = min(int(offsets[d + 1]), int(offsets[d]) + low + 2 * w + n + e)
                got = align(self.texts[i], data[lo:hi], e)
                if got is not None and (old is None or got[0] < old[0]):
                    best[d, i] = (got[0], lo + got[1], lo + got[2])
        for (d, i), (edits, a, b) in sorted(best.items()):
            shift = int(place[offsets[d]]) if offsets[d] < len(place) else 0
            yield d, i, int(place[a]) - shift, int(stop_of[b - 1]) + 1 - shift, edits


def _merged(key: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct columns of key, and the sums of their counts."""
    order = np.lexsort(key[::-1])
    key, count = key[:, order], count[order]
    cut = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(0)])
    return key[:, cut], np.add.reduceat(count, cut)


def align(item: np.ndarray, region: np.ndarray, most: int) -> tuple[int, int, int] | None:
    """(edits, start, stop) of the region's part nearest to the item, or None if it needs over ``most`` edits.

    The region is a band of diagonals and the item's length, so the table has
    the band's width for each byte of the item; a start is carried along.
    """
    at = region.tobytes().find(item.tobytes())
    if at >= 0:
        return 0, at, at + len(item)
    width = len(region) - len(item) + most  # diagonals -most .. len(region) - len(item)
    if width < 0:
        return None
    far = len(item) + most + 1
    j = np.arange(width + 1) - most  # column i + j for row i
    cost = np.where(j >= 0, 0, far)
    start = np.maximum(j, 0)
    ramp = np.arange(width + 1)
    for i in range(1, len(item) + 1):
        col = i + j
        inside = (col >= 1) & (col <= len(region))
        letter = region[np.clip(col - 1, 0, max(len(region) - 1, 0))] if len(region) else np.zeros(width + 1, np.uint8)
        take = np.where(inside, cost + (letter != item[i - 1]), far)
        drop = np.append(cost[1:] + 1, far)  # the item's byte is missing in the region
        now = np.minimum(take, drop)
        begin = np.where(take <= drop, start, np.append(start[1:], 0))
        now = np.where((col >= 0) & (col <= len(region)), now, far)
        run = (now - ramp) * (1 << 32) + begin  # the region has a byte more: least along the row
        least = np.minimum.accumulate(run)
        cost = np.minimum((least >> 32) + ramp, far)
        start = least & 0xFFFFFFFF
    k = int(np.argmin(cost))
    return (int(cost[k]), int(start[k]), int(len(item) + j[k])) if cost[k] <= most else None


_HIT_TYPE = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("edits", pa.int32())]))


def item_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", most: int = BLOCK_BYTES) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded size, one at a time on the driver."""
    block, size = [], 0
    for r in benchmark.select(id_col, text_col).where(F.col(text_col).isNotNull()).orderBy(id_col, text_col).toLocalIterator():
        if block and size + len(r[1]) > most:
            yield block
            block, size = [], 0
        block.append((r[0], r[1]))
        size += len(r[1])
    yield block


def _groups(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[list[pa.RecordBatch]]:
    """The batches in slices, of about GROUP_BYTES of text together (or one text)."""
    group, size = [], 0
    for b in batches:
        bytes_of = pc.fill_null(pc.binary_length(b.column(b.schema.get_field_index(column))), 0).to_numpy().astype(np.int64)
        at = 0
        while at < b.num_rows:
            upto = np.cumsum(bytes_of[at:])
            n = max(1 if not group else 0, int(np.searchsorted(upto, GROUP_BYTES - size, "right")))
            if n:
                group.append(b.slice(at, n))
                size += int(upto[n - 1])
                at += n
            if at < b.num_rows:
                yield group
                group, size = [], 0
    if group:
        yield group


def matches(docs: DataFrame, blocks_of_items: list[list[tuple[int, str]]], text_col: str, out: str, more: bool = False) -> DataFrame:
    """docs with the regions found (byte offsets in the text) in column out; more: docs has it, and the regions are added."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(blocks_of_items)
    kept = [f for f in docs.schema.fields if f.name != out] if more else docs.schema.fields
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        several = len(shared.value) > 1
        items = None if several else Items(shared.value[0])
        for group in _groups(batches, text_col):
            column = pa.chunked_array([b.column(b.schema.get_field_index(text_col)) for b in group]).combine_chunks()
            data, offsets = text_bytes(lowered(column))
            hits: list[list[dict]] = [[] for _ in range(len(column))]
            for block in shared.value:
                known = Items(block) if several else items
                for first, part, at in blocks(data, offsets):
                    for d, i, start, stop, edits in known.found(part, at):
                        hits[first + d].append({"item_id": known.ids[i], "start": start, "stop": stop, "edits": edits})
            at = 0
            for b in group:
                found = hits[at : at + b.num_rows]
                at += b.num_rows
                if more:
                    found = [(x or []) + y for x, y in zip(b.column(b.schema.get_field_index(out)).to_pylist(), found, strict=True)]
                yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(n)) for n in names), pa.array(found, _HIT_TYPE)], names=[*names, out])

    item = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("stop", T.LongType()), T.StructField("edits", T.IntegerType())])
    return docs.mapInArrow(run, T.StructType([*kept, T.StructField(out, T.ArrayType(item))]))


def contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", out: str = "hits", most: int = BLOCK_BYTES, pass_blocks: int = PASS_BLOCKS) -> DataFrame:
    """docs with the regions of benchmark items found in each text, in column ``out`` (lengthened where docs has it), which is the last."""
    (out,) = fresh(docs, out)
    scratch, more, some = None, False, []
    for block in item_blocks(benchmark, most=most):
        if len(some) == pass_blocks:
            scratch = scratch or Scratch(docs.sparkSession, "decontaminate")
            before, docs = docs, scratch.keep(matches(docs, some, text_col, out, more))
            if more:
                scratch.free(before)
            more, some = True, []
        some.append(block)
    return matches(docs, some, text_col, out, more)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return contaminated(docs, read(spark, sf_dir, "benchmark")).select(
        "doc_id",
        (F.size("hits") > 0).alias("contaminated"),
        F.size("hits").cast("long").alias("n_items"),
        F.array_sort(F.transform("hits", lambda h: h["item_id"])).alias("item_ids"),
        "hits",
    )
