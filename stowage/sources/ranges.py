"""Byte ranges of archived files, decoding only the blocks they touch.

Requests are rows of uri, record_index, offset, n.  Only these travel; each
executor opens the archive it needs, keeps the last few catalogs and decoded
blocks, and reads the bytes of a block by position.
"""

from __future__ import annotations

import io
from bisect import bisect_right
from collections import OrderedDict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .archive import known_archive, open_archive, open_file, payload
from .codecs import decompress
from .errors import ArchiveError, CodecError

#: Decoded blocks kept by a reader, and catalogs kept by a worker; bytes read that are sent on together.
BLOCKS, CATALOGS, PORTION = 8, 4, 32 << 20


def bounds(size: int, offset: int, n: int, mode: str = "clamp") -> tuple[int, int]:
    """start and stop inside a file of a size. strict refuses what reaches past the end, clamp_end a start past it."""
    if offset < 0 or n < 0:
        raise ArchiveError(f"range {offset}+{n} is negative")
    stop = offset + n
    if mode == "strict" and stop > size or mode in ("strict", "clamp_end") and offset > size:
        raise ArchiveError(f"range {offset}+{n} reaches past {size} bytes")
    if mode not in ("strict", "clamp", "clamp_end"):
        raise ValueError(f"unknown range mode {mode!r}")
    return min(offset, size), min(stop, size)


class FileReader:
    """One archived file: ranges, blocks by number, and the whole."""

    def __init__(self, catalog, f, index: int, base: int = 0):
        if not 1 <= index <= len(catalog.records):
            raise ArchiveError(f"no record {index}")
        self.record, self.f, self.base, self.dictionary = catalog.records[index - 1], f, base, catalog.dictionary
        if self.record.kind not in ("file", "chunked_file"):
            raise ArchiveError(f"record {index} is no file")
        self.blocks = catalog.blocks_of(index)
        self.starts = [a for a, _ in self.blocks]
        self.kept: OrderedDict[int, bytes] = OrderedDict()

    def __len__(self) -> int:
        return self.record.decompressed_length

    def _part(self, k: int) -> bytes:
        """Decoded block k (a whole file is its only block)."""
        if k in self.kept:
            self.kept.move_to_end(k)
            return self.kept[k]
        if self.record.kind == "file":
            body = payload(self.f, self.base, self.record, self.dictionary)
        else:
            start = self.blocks[k][1]
            stop = self.blocks[k + 1][1] if k + 1 < len(self.blocks) else self.record.data + self.record.length
            if stop <= start:
                raise CodecError("blocks aren't contiguous", start, self.record.name)
            body = decompress(self.f.read_at(stop - start, self.base + start), self.record.compression, self.dictionary)
            want = (self.starts[k + 1] if k + 1 < len(self.blocks) else len(self)) - self.starts[k]
            if len(body) != want:
                raise CodecError(f"block of {len(body)} bytes, {want} were expected", start, self.record.name)
        self.kept[k] = body
        while len(self.kept) > BLOCKS:
            self.kept.popitem(last=False)
        return body

    def block(self, number: int) -> bytes:
        """The block at exactly number * block_size."""
        at = number * (self.record.block_size or 0)
        if self.record.kind != "chunked_file" or at not in self.starts:
            raise ArchiveError(f"no block {number}", path=self.record.name)
        return self._part(self.starts.index(at))

    def read(self, offset: int, n: int, mode: str = "clamp") -> bytes:
        start, stop = bounds(len(self), offset, n, mode)
        if start >= stop:
            return b""
        if self.record.kind == "file":
            return self._part(0)[start:stop]
        if not self.blocks:
            raise CodecError("chunked file without blocks", self.record.data, self.record.name)
        out, k = [], bisect_right(self.starts, start) - 1
        while k < len(self.blocks) and self.starts[k] < stop:
            body = self._part(k)
            out.append(body[max(0, start - self.starts[k]) : stop - self.starts[k]])
            k += 1
        got = b"".join(out)
        if len(got) != stop - start:
            raise CodecError("blocks don't cover the range", path=self.record.name)
        return got


class SeekReader(io.RawIOBase):
    """A file object over an archived file; readers of one archive in one process share its catalog."""

    def __init__(self, uri: str, index: int, base: int = 0):
        catalog, _ = known_archive(uri, base)
        system, inner = open_file(uri)
        self.handle = system.open_input_file(inner)
        self.file, self.at = FileReader(catalog, self.handle, index, base), 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        at = offset + (0, self.at, len(self.file))[whence]
        if not 0 <= at <= len(self.file):
            raise ArchiveError(f"seek to {at} of {len(self.file)} bytes")
        self.at = at
        return at

    def readinto(self, buffer) -> int:
        got = self.file.read(self.at, len(buffer))
        buffer[: len(got)] = got
        self.at += len(got)
        return len(got)

    def close(self) -> None:
        if not self.closed:
            self.handle.close()
        super().close()


@lru_cache(maxsize=CATALOGS)
def _opened(uri: str, base: int, size: int, changed: object):
    system, inner = open_file(uri)
    return open_archive(uri, base)[0], system.open_input_file(inner)


def read_ranges(requests: DataFrame, mode: str = "clamp", base: int = 0) -> DataFrame:
    """requests(uri, record_index, offset, n, …) with the bytes asked for in ``content``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readers: OrderedDict[tuple, FileReader] = OrderedDict()
        for b in batches:
            col = lambda c: b.column(b.schema.get_field_index(c)).to_pylist()  # noqa: B023, E731
            out, held, sent = [], 0, 0
            for k, (uri, index, offset, n) in enumerate(zip(col("uri"), col("record_index"), col("offset"), col("n"), strict=True)):
                if (uri, index) not in readers:
                    system, inner = open_file(uri)
                    info = system.get_file_info(inner)
                    readers[uri, index] = FileReader(*_opened(uri, base, info.size, info.mtime_ns), index, base)
                    while len(readers) > BLOCKS:
                        readers.popitem(last=False)
                out.append(readers[uri, index].read(offset, n, mode))
                held += len(out[-1])
                if held >= PORTION or k + 1 == b.num_rows:  # what was asked for may be much more than the requests
                    done = b.slice(sent, len(out))
                    yield pa.RecordBatch.from_arrays([*done.columns, pa.array(out, pa.binary())], names=[*b.schema.names, "content"])
                    sent, out, held = k + 1, [], 0

    schema = T.StructType([*requests.schema.fields, T.StructField("content", T.BinaryType())])
    # requests of one file meet in one task, in order, so that a block is decoded once
    near = requests.repartition("uri", "record_index").sortWithinPartitions("uri", "record_index", "offset")
    return near.mapInArrow(run, schema)
