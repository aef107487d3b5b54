"""The data source ``archive``: an archive's tables as DataFrames.

spark.read.format("archive").option("table", "records").load(uri)

Tables: archives, records, attr_keys, attrs, paths, blocks, contents.  Each
archive is a partition (contents: a partition for every ``SLICE`` bytes of
it).  Catalog tables read the header and the trailer only.  Filters on uri,
archive_id, record_index (equal, or one of a list) and path (equal, or starting
with) are pushed down.
"""

from __future__ import annotations

import functools
import glob as globs
import itertools
import mmap
import os
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .codecs import decompress
from .errors import ArchiveError, CodecError, OpenError
from .wire import HEADER, MAGIC, Catalog, Header, Record, Records, decode_number, decode_trailer

SLICE = 128 << 20
#: Rows of the table of blocks that are sent on together; rows, and bytes of contents, of others.
ROWS = 1 << 16
SENT, SENT_BYTES = 1 << 13, 4 << 20

SCHEMAS = {
    "archives": "archive_id long, uri string, base_offset long, file_size long, version int, allow_external_symlinks boolean, allow_escapes boolean, alignment long, trailer_offset long, trailer_size long, dictionary binary, path_index_entries long, block_index_entries long",
    "records": "archive_id long, record_index long, record_type string, compression string, compression_id int, name string, path string, length long, decompressed_length long, data_offset long, block_size long, link_target_index long, external_target string, attrs map<string,binary>",
    "attr_keys": "archive_id long, key_index int, name string, attr_type string",
    "attrs": "archive_id long, record_index long, key string, declared_type string, effective_type string, raw binary, v_string string, v_long long, v_decimal decimal(20,0), v_bytes binary, v_ts timestamp, v_json string",
    "paths": "archive_id long, path string, record_index long, depth int, parent string, name string",
    "blocks": "archive_id long, record_index long, logical_offset long, physical_offset long",
    "contents": "archive_id long, record_index long, content binary",
}


def open_file(uri: str) -> tuple[fs.FileSystem, str]:
    """A file system and the path in it, for a URI or a plain path."""
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), os.path.abspath(uri))


def list_archives(path: str) -> list[str]:
    """Archives named by a path: a file, a folder's files, or a glob (plain paths)."""
    if any(c in path for c in "*?["):
        return sorted(p for p in globs.glob(path.removeprefix("file://"), recursive=True) if os.path.isfile(p))
    system, inner = open_file(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.Directory:
        found = system.get_file_info(fs.FileSelector(inner, recursive=True))
        return sorted(f.path for f in found if f.type == fs.FileType.File and not os.path.basename(f.path).startswith((".", "_")))
    if info.type == fs.FileType.NotFound:
        raise OpenError("no such archive", path=path)
    return [path]


def open_archive(uri: str, base: int = 0, strict: bool = False) -> tuple[Catalog, int]:
    """The catalog and the file's size; of a local file, the trailer is mapped, as archives are replaced and never changed."""
    system, inner = open_file(uri)
    with system.open_input_file(inner) as f:
        size = f.size()
        header = Header.decode(f.read_at(HEADER.size, base) if base + HEADER.size <= size else b"")
        start = base + header.trailer
        if header.trailer == 0:
            raise OpenError("the trailer's offset is zero", path=uri)
        if start > size or start >= 1 << 64:
            raise OpenError(f"the trailer starts at {start} of {size} bytes", path=uri)
        if isinstance(system, fs.LocalFileSystem) and size > start:
            with open(inner, "rb") as local:
                data = memoryview(mmap.mmap(local.fileno(), size, access=mmap.ACCESS_READ))[start:]
        else:
            data = f.read_at(size - start, start)
        return decode_trailer(data, header, strict), size


@functools.lru_cache(maxsize=4)
def _decoded(uri: str, base: int, strict: bool, size: int, changed: int) -> Catalog:
    return open_archive(uri, base, strict)[0]


def known_archive(uri: str, base: int = 0, strict: bool = False) -> tuple[Catalog, int]:
    """``open_archive``, where a worker that reads several slices of a file decodes its catalog once."""
    system, inner = open_file(uri)
    info = system.get_file_info(inner)
    if info.type != fs.FileType.File or info.mtime_ns is None:
        return open_archive(uri, base, strict)
    return _decoded(uri, base, strict, info.size, info.mtime_ns), info.size


def signed(value: int | None) -> int | None:
    """Checked: what Spark's long can't hold is an error, never another number."""
    if value is not None and value >= 1 << 63:
        raise ArchiveError(f"{value} exceeds a long")
    return value


def payload(f, base: int, record: Record, dictionary: bytes | None, blocks: list[tuple[int, int]] = ()) -> bytes:
    """A file's content; blocks: (logical, physical) of a chunked file in order."""
    if record.kind == "file":
        raw = f.read_at(record.length, base + record.data)
        if len(raw) != record.length:
            raise CodecError("payload is cut off", record.data, record.name)
        return decompress(raw, record.compression, dictionary)
    if record.decompressed_length and not blocks:
        raise CodecError("chunked file without blocks", record.data, record.name)
    out, expected = [], 0
    for k, (logical, physical) in enumerate(blocks):
        stop = blocks[k + 1][1] if k + 1 < len(blocks) else record.data + record.length
        if logical != expected or stop <= physical:
            raise CodecError("blocks aren't contiguous", physical, record.name)
        out.append(decompress(f.read_at(stop - physical, base + physical), record.compression, dictionary))
        expected += len(out[-1])
    if expected != record.decompressed_length:
        raise CodecError(f"blocks hold {expected} bytes, {record.decompressed_length} are declared", record.data, record.name)
    return b"".join(out)


@dataclass
class Part(InputPartition):
    archive_id: int
    uri: str
    low: int = 0
    high: int = 1 << 62

    def __init__(self, archive_id: int, uri: str, low: int = 0, high: int = 1 << 62):
        self.archive_id, self.uri, self.low, self.high = archive_id, uri, low, high


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], table: str):
        self.path, self.table = options["path"], table
        self.base, self.strict = int(options.get("base_offset", 0)), options.get("strict", "false").lower() == "true"
        self.equal: dict[str, object] = {}
        self.among: set[int] | None = None
        self.prefix: str | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = ".".join(f.attribute) if hasattr(f, "attribute") else ""
            if isinstance(f, EqualTo) and column in ("uri", "archive_id", "record_index", "path") and column not in self.equal:
                self.equal[column] = f.value
            elif isinstance(f, In) and column == "record_index" and self.among is None:
                self.among = set(f.value)
            elif isinstance(f, StringStartsWith) and column == "path" and self.prefix is None:
                self.prefix = f.value
            # pushed filters only save work; Spark applies them again
            yield f

    def partitions(self) -> list[Part]:
        found = []
        for k, uri in enumerate(list_archives(self.path)):
            if self.equal.get("archive_id", k) != k or self.equal.get("uri", uri) != uri:
                continue
            if self.table == "contents":
                system, inner = open_file(uri)
                size = max(1, system.get_file_info(inner).size)
                found += [Part(k, uri, low, low + SLICE) for low in range(0, size, SLICE)]
            else:
                found.append(Part(k, uri))
        return found or [Part(-1, "")]

    def read(self, part: Part) -> Iterator[tuple]:
        if part.archive_id < 0:
            return
        # a catalog is kept for the slices of contents only; other tables need it once, and it may be large
        catalog, size = (known_archive if self.table == "contents" else open_archive)(part.uri, self.base, self.strict)
        yield from getattr(self, f"_{self.table}")(part, catalog, size)

    def _asked(self, index: int) -> bool:
        return self.equal.get("record_index", index) == index and (self.among is None or index in self.among)

    def _wanted(self, path: str | None, index: int) -> bool:
        return (
            self._asked(index)
            and ("path" not in self.equal or self.equal["path"] == path)
            and (self.prefix is None or (path is not None and path.startswith(self.prefix)))
        )

    def _items(self, catalog: Catalog) -> Iterable[tuple[str, int]]:
        """Entries that the pushed filters leave, by lookup or prefix scan where the index allows it."""
        if catalog.paths is not None and not catalog.root:
            if "path" in self.equal:
                key = str(self.equal["path"])
                found = catalog.paths.get(key.encode())
                return [] if found is None else [(key, found)]
            if self.prefix is not None:
                return ((k.decode(), v) for k, v in catalog.paths.prefix(self.prefix.encode()))
        return catalog.walked()

    def _archives(self, part: Part, c: Catalog, size: int):
        h = c.header
        start = self.base + h.trailer
        yield (part.archive_id, part.uri, self.base, size, h.version, h.external, h.escapes, h.alignment, signed(h.trailer), size - start, c.dictionary, *(0 if i is None else signed(i.entries) for i in (c.paths, c.blocks)))

    def _paths(self, part: Part, c: Catalog, size: int):
        for path, index in self._items(c):
            if self._wanted(path, index):
                head, _, name = path.rpartition("\x1f")
                yield part.archive_id, path, signed(index), path.count("\x1f"), head if "\x1f" in path else None, name

    def _records(self, part: Part, c: Catalog, size: int):
        path_of: list[str | None] = [None] * (len(c.records) + 1)
        for path, index in self._items(c):
            if index < len(path_of):
                path_of[index] = path if path_of[index] is None else min(path, path_of[index])
        names = [n for n, _ in c.keys]
        for k, r in enumerate(c.records, 1):
            path = path_of[k]
            if not self._wanted(path, k):
                continue
            attrs = {names[i]: v for i, v in r.attrs.items() if i < len(names)}
            yield (part.archive_id, k, r.kind, r.compression, r.compression_id, r.name, path, signed(r.length), signed(r.decompressed_length), signed(r.data), r.block_size, signed(r.target), r.external_target, attrs)

    def _attr_keys(self, part: Part, c: Catalog, size: int):
        for k, (name, kind) in enumerate(c.keys):
            yield part.archive_id, k, name, kind

    def _attrs(self, part: Part, c: Catalog, size: int):
        import datetime
        import decimal
        import json

        epoch = datetime.datetime(2026, 1, 1, tzinfo=datetime.timezone.utc)
        records = ((k, r.attrs) for k, r in enumerate(c.records, 1) if self._asked(k))
        for index, attrs in itertools.chain([(None, c.attrs)], records):
            for key, raw in attrs.items():
                if key >= len(c.keys):
                    continue
                name, kind = c.keys[key]
                text = None
                if kind in ("string", "json"):
                    try:
                        text = raw.decode()
                    except UnicodeDecodeError:
                        text = None
                number = decode_number(kind, raw)
                effective, doc = kind, None
                if kind in ("string", "json"):
                    effective = "bytes" if text is None else kind
                    if kind == "json" and text is not None:
                        try:
                            json.loads(text)
                            doc = text
                        except ValueError:
                            effective = "string"
                elif kind in ("u128", "u256"):
                    effective = kind if len(raw) == {"u128": 16, "u256": 32}[kind] else "bytes"
                elif kind != "bytes" and number is None:
                    effective = "bytes"
                when = None
                if effective == "datetime":
                    try:
                        when = epoch + datetime.timedelta(minutes=number)
                    except OverflowError:
                        when = None
                yield (
                    part.archive_id, index, name, kind, effective, raw, text if effective in ("string", "json") else None, number if number is not None and effective != "vu64" and effective != "bytes" else None,
                    decimal.Decimal(number) if effective == "vu64" else None, raw if effective in ("bytes", "u128", "u256") else None, when, doc,
                )

    def _blocks(self, part: Part, c: Catalog, size: int):
        columns = c.block_columns()
        for low in range(0, len(columns[0]), ROWS):
            piece = [x[low : low + ROWS] for x in columns]
            if "record_index" in self.equal or self.among is not None:
                asked = np.array([self._asked(k) for k in piece[0].tolist()], bool)
                piece = [x[asked] for x in piece]
            for x in piece:
                signed(int(x.max(initial=0)))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(piece[0]), part.archive_id)), *(pa.array(x.astype(np.int64)) for x in piece)], names=["archive_id", "record_index", "logical_offset", "physical_offset"])

    def _contents(self, part: Part, c: Catalog, size: int):
        system, inner = open_file(part.uri)
        with system.open_input_file(inner) as f:
            # a slice's records are found by their places
            near = c.records.between(part.low - self.base, part.high - self.base) if isinstance(c.records, Records) else range(1, len(c.records) + 1)
            for k in near:
                if not self._asked(k):
                    continue
                r = c.records[k - 1]
                if r.kind not in ("file", "chunked_file") or not part.low <= self.base + r.data < part.high:
                    continue
                yield part.archive_id, k, payload(f, self.base, r, c.dictionary, c.blocks_of(k) if r.kind == "chunked_file" else ())


class ArchiveSource(DataSource):
    """Options: path, table (default records), base_offset, strict; for writing see ``sink``."""

    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        table = self.options.get("table", "records")
        if table not in SCHEMAS:
            raise OpenError(f"no table {table!r}; tables are {', '.join(SCHEMAS)}")
        return SCHEMAS[table]

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options), self.options.get("table", "records"))

    def writer(self, schema, overwrite: bool):
        from .sink import Writer

        return Writer(dict(self.options), schema, overwrite)


def register(spark: SparkSession) -> None:
    """Makes ``format("archive")`` known, with filters pushed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArchiveSource)


def load(spark: SparkSession, path: str, table: str = "records", **options):
    """A table of the archives under path."""
    return spark.read.format("archive").option("table", table).options(**options).load(path)


def scan(spark: SparkSession, path: str, table: str = "records", through: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None, schema: str | None = None, **options) -> DataFrame:
    """All of a table of the archives under path, read by tasks as batches.

    No filters are pushed, and Spark starts no Python beside the driver to plan
    it, which for a data source it does for each step, and keeps.  through: what
    a task turns the batches into, of this schema, before they leave it.
    """
    reader = Reader({"path": path} | {k: str(v) for k, v in options.items()}, table)
    parts = reader.partitions()
    kind = to_arrow_schema(StructType.fromDDL(SCHEMAS[table]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = (k for b in batches for k in b.column(0).to_pylist())
        found = itertools.chain.from_iterable(_batched(reader.read(parts[k]), kind) for k in numbers)
        yield from found if through is None else through(found)

    # by way of an RDD, as the planner takes what comes of a few rows for a few rows, which it would broadcast
    few = spark.range(0, len(parts), 1, len(parts))._jdf.toDF()
    numbers = DataFrame(spark._jsparkSession.createDataFrame(few.toJavaRDD(), few.schema()), spark)
    return numbers.mapInArrow(run, schema or SCHEMAS[table])


def _batched(rows: Iterator[tuple | pa.RecordBatch], kind: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows in batches of few rows and of few bytes in their last column, where that holds contents."""
    waiting, held = [], 0

    def batch() -> pa.RecordBatch:
        columns = zip(*waiting, strict=True)
        return pa.RecordBatch.from_arrays([pa.array([v if v is None else list(v.items()) for v in c] if pa.types.is_map(f.type) else c, f.type) for c, f in zip(columns, kind, strict=True)], schema=kind)

    for row in rows:
        if isinstance(row, pa.RecordBatch):
            yield row
            continue
        waiting.append(row)
        held += len(row[-1]) if isinstance(row[-1], bytes) else 0
        if len(waiting) >= SENT or held >= SENT_BYTES:
            yield batch()
            waiting, held = [], 0
    if waiting:
        yield batch()


def probe(spark: SparkSession, path: str, base_offset: int = 0):
    """path, length, is_archive of the files under path, told by their first four bytes; no more of them is read."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            found = []
            for uri in b.column(0).to_pylist():
                system, inner = open_file(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file:///") else uri)
                with system.open_input_file(inner) as f:
                    found.append(base_offset + 4 <= f.size() and f.read_at(4, base_offset) == MAGIC)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.bool_())], names=["path", "length", "is_archive"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length").mapInArrow(run, "path string, length long, is_archive boolean")
