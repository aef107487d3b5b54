"""Writing archives: create, append, extract, validate.

Rows to write have path and, as they apply, record_type, content, target
(path of a link's target), external_target, position, codec, chunked, attrs
(map of name to raw bytes).  Tasks compress payloads into part files beside
the archive, each with a table of its entries; these are laid out by position
and copied in, then the trailer and the header are written, and one rename
publishes the file.  ``write`` lays out in one task of an executor, so that the
driver holds no entry; a plain ``save`` does it in its commit.  Nothing is
visible before the rename, and an abort leaves nothing.
"""

from __future__ import annotations

import base64
import contextlib
import json
import os
import pickle
import stat
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSourceWriter, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType

from ..functions.digest import PORTION, blake3_many
from ..functions.paths import check_extractable
from ..functions.scalars import BLOCK_SIZE, DEFAULT_MODES, MIN_COMPRESSIBLE, SEP
from .archive import load, open_archive, open_file, scan
from .codecs import compress
from .errors import ExtractError, PathError, WriteError
from .pindex import built
from .vint import encode_vu64
from .wire import HEADER, STANDARD, XATTR, Catalog, Header, Record, decode_number, encode_front, encode_record, encode_trailer

U32 = (1 << 32) - 1


#: Entries of a part that are kept before they are added to its table, and laid out at once.
ROWS = 1 << 13
#: Rows of a batch that are made Python's at once.
FEW = 64
KINDS = ("directory", "file", "chunked_file", "link", "external_link")


@dataclass
class Prepared(WriterCommitMessage):
    """The name of a part: its payloads are in the file, its entries in the table beside it."""

    part: str
    dictionaries: set[bytes] = field(default_factory=set)


def table_of(part: str) -> str:
    return f"{part}.entries"


def _entry_type(position: pa.DataType) -> pa.Schema:
    """An entry: everything but its place. places: where in the payload each block of a chunked file begins."""
    return pa.schema({
        "position": position, "path": pa.binary(), "kind": pa.string(), "at": pa.int64(), "length": pa.int64(), "size": pa.int64(), "codec": pa.string(),
        "places": pa.list_(pa.int64()), "target": pa.binary(), "external": pa.string(), "names": pa.list_(pa.string()), "raw": pa.list_(pa.binary()),
    })


def prepare(content: bytes, codec: str, chunked: bool, block: int, level: int | None, dictionary: bytes | None) -> tuple[bytes, str, list[tuple[int, int]]]:
    """Payload bytes, the codec used and, for chunked content, (logical, place in the payload) of each block."""
    if not chunked:
        codec = "stored" if len(content) < MIN_COMPRESSIBLE else codec
        return compress(content, codec, level, dictionary if codec == "zstd" else None), codec, []
    if block <= 0 or not content:
        raise WriteError("chunked content needs bytes and a block size")
    out, blocks, at = [], [], 0
    for logical in range(0, len(content), block):
        body = compress(content[logical : logical + block], codec)  # default options, no dictionary
        blocks.append((logical, at))
        out.append(body)
        at += len(body)
    return b"".join(out), codec, blocks


class Writer(DataSourceWriter):
    """Options: path, alignment (0), codec (zstd), level, chunked (false), block_size, checksum (true), allow_escapes,
    allow_external_symlinks, dictionary (base64, for whole zstd files), create (false: replace or append by mode), walked
    (false; true: with chunked, files of at most a block stay whole), factor_owners (false; true: the first file's owner
    becomes the archive's, and equal ones are dropped), archive_attrs (JSON, name to type and base64)."""

    def __init__(self, options: dict[str, str], schema, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        flag = lambda k, d: options.get(k, d).lower() == "true"
        self.alignment, self.codec = int(options.get("alignment", 0)), options.get("codec", "zstd")
        self.level = int(options["level"]) if "level" in options else None
        self.chunked, self.block = flag("chunked", "false"), int(options.get("block_size", BLOCK_SIZE))
        self.checksum, self.escapes, self.external = flag("checksum", "true"), flag("allow_escapes", "false"), flag("allow_external_symlinks", "false")
        system, inner = open_file(self.path)
        self.exists = system.get_file_info(inner).type == fs.FileType.File
        self.dictionary = base64.b64decode(options["dictionary"]) if options.get("dictionary") else None
        self.walked, self.factor = flag("walked", "false"), flag("factor_owners", "false")
        self.attrs = {n: (t, base64.b64decode(v)) for n, (t, v) in json.loads(options.get("archive_attrs", "{}")).items()}
        if flag("create", "false") and self.exists:
            raise WriteError("the archive exists already", path=self.path)
        if not 0 <= self.alignment <= U32:
            raise WriteError(f"alignment {self.alignment} isn't an unsigned 32-bit value")
        # work: the folder of the parts, which are to be laid out later
        self.later = "work" in options
        self.work = options.get("work") or f"{inner}.parts-{uuid.uuid4().hex}"
        position = next((f.dataType for f in (schema.fields if schema else ()) if f.name == "position"), LongType())
        self.entries = _entry_type(to_arrow_type(position))

    def write(self, rows: Iterator[Row]) -> Prepared:
        return self.put(row.asDict() for row in rows)

    def put(self, rows: Iterator[dict]) -> Prepared:
        system, _ = open_file(self.path)
        system.create_dir(self.work)
        part = f"{self.work}/{uuid.uuid4().hex}"
        at, dictionaries = 0, set()
        waiting, held, kept = [], 0, []
        with system.open_output_stream(part) as out, system.open_output_stream(table_of(part)) as beside, pa.ipc.new_file(beside, self.entries) as table:

            def flush() -> None:
                self._hash(waiting)
                table.write_batch(pa.RecordBatch.from_pylist([e | {"names": list(e["attrs"]), "raw": list(e["attrs"].values())} for e in kept], self.entries))
                waiting.clear()
                kept.clear()

            for r in rows:
                kind = r.get("record_type") or ("file" if r.get("content") is not None else "directory")
                target = r.get("target")
                e = {"position": r.get("position"), "path": r["path"].encode(), "kind": "file" if kind == "chunked_file" else kind, "target": None if target is None else target.encode(), "external": r.get("external_target"), "at": at, "length": 0, "size": 0}
                if e["kind"] not in KINDS:
                    raise WriteError(f"unknown record type {kind!r}", path=r["path"])
                e["attrs"] = {k: bytes(v) for k, v in dict(r.get("attrs") or {}).items()}
                if e["kind"] == "file":
                    content = bytes(r.get("content") or b"")
                    wanted = r.get("chunked")
                    if wanted is None:
                        wanted = self.chunked and (len(content) > self.block or not self.walked)
                    # a row that says chunked_file must have bytes; others without any are stored whole
                    cut = kind == "chunked_file" or (bool(content) and wanted)
                    if r.get("dictionary") is not None:
                        dictionaries.add(bytes(r["dictionary"]))
                    body, e["codec"], blocks = prepare(content, r.get("codec") or self.codec, cut, self.block, self.level, self.dictionary)
                    if cut:
                        e |= {"kind": "chunked_file", "places": [place for _, place in blocks]}
                    e |= {"length": len(body), "size": len(content)}
                    if self.checksum:
                        waiting.append((e, content))
                        held += len(content)
                    out.write(body)
                    at += len(body)
                kept.append(e)
                if held >= PORTION or len(kept) >= ROWS:
                    flush()
                    held = 0
            flush()
        return Prepared(part, dictionaries)

    @staticmethod
    def _hash(waiting: list[tuple[dict, bytes]]) -> None:
        for (e, _), digest in zip(waiting, blake3_many([c for _, c in waiting]), strict=True):
            e["attrs"]["blake3"] = digest

    def commit(self, messages: list[Prepared | None]) -> None:
        parts = [m.part for m in messages if m]
        found = set().union(*(m.dictionaries for m in messages if m))
        if len(found | ({self.dictionary} if self.dictionary else set())) > 1 or (found and not self.dictionary):
            raise WriteError("all files of an archive must share its one dictionary", path=self.path)
        system, inner = open_file(self.path)
        if self.later:
            system.create_dir(self.work)
            with system.open_output_stream(f"{self.work}/plan") as out:
                out.write(pickle.dumps((self, parts)))
            return
        try:
            finish(system, self.lay(parts), inner)
        finally:
            _drop(system, self.work)

    def lay(self, parts: list[str]) -> str:
        """Lays the parts out as a draft of the archive; its path."""
        system, inner = open_file(self.path)
        old = Catalog(Header(1))
        if self.exists and not self.overwrite:
            old, _ = open_archive(self.path)
            if self.dictionary != old.dictionary:
                raise WriteError("an archive has one dictionary; append with the one it has", path=self.path)
        old.dictionary = self.dictionary
        entries = Entries(system, parts)
        attrs, factored = self.attrs, {}
        if self.factor and not old.records:
            factored = entries.owners()
            attrs = factored | attrs
        draft = f"{self.work}/draft-{uuid.uuid4().hex}"
        with system.open_output_stream(draft) as out:
            layout(out, system, inner if old.records else None, old, entries, self.alignment, self.escapes, self.external, attrs, {n: raw for n, (_, raw) in factored.items()}, self.block)
        return draft

    def abort(self, messages: list[Prepared | None]) -> None:
        system, _ = open_file(self.path)
        _drop(system, self.work)


class Entries:
    """The entries of all parts in order of position and path."""

    def __init__(self, system: fs.FileSystem, parts: list[str]):
        opened = pa.memory_map if isinstance(system, fs.LocalFileSystem) else system.open_input_file
        self.system, self.parts = system, parts
        tables = [pa.ipc.open_file(opened(table_of(p))).read_all() for p in parts]
        self.table = pa.concat_tables([t.append_column("part", pa.chunked_array([pa.array(np.full(t.num_rows, k), pa.int32())])) for k, t in enumerate(tables)]) if tables else _entry_type(pa.int64()).append(pa.field("part", pa.int32())).empty_table()
        self.table = self.table.combine_chunks()
        keys = self.table.select(["position", "path"])
        try:
            self.order = pc.sort_indices(keys, [("position", "ascending"), ("path", "ascending")], null_placement="at_end")
        except (pa.ArrowNotImplementedError, pa.ArrowTypeError, pa.ArrowInvalid):  # a position that Arrow doesn't compare
            position, path = keys.column(0).to_pylist(), keys.column(1).to_pylist()
            place = lambda x: tuple(x.values()) if isinstance(x, dict) else x
            self.order = pa.array(sorted(range(len(path)), key=lambda k: (position[k] is None, place(position[k]) if position[k] is not None else 0, path[k])), pa.int64())

    def of(self, *kinds: str) -> Iterator[tuple[dict, pa.Table]]:
        """Portions of the entries of these kinds: their columns as lists, and as a table."""
        chosen = self.order.filter(pc.is_in(self.table.column("kind").combine_chunks().take(self.order), pa.array(kinds)))
        for k in range(0, len(chosen), ROWS):
            rows = self.table.take(chosen.slice(k, ROWS))
            yield {c: _listed(rows.column(c)) for c in rows.column_names if c != "places"}, rows

    def owners(self) -> dict[str, tuple[str, bytes]]:
        """The first file's owner as the archive's attributes."""
        out = {}
        for columns, _ in self.of("file", "chunked_file"):
            for names, raw in zip(columns["names"], columns["raw"], strict=True):
                for n, v in zip(names, raw, strict=True):
                    if n in ("unix.uid", "unix.gid") and n not in out:
                        out[n] = (STANDARD[n], v)
                if len(out) == 2:
                    return out
        return out


def _listed(column: pa.ChunkedArray) -> list:
    """The column as a list; one of lists is cut from the list of all values, which is quicker."""
    if not pa.types.is_list(column.type) or column.null_count:
        return column.to_pylist()
    values = [v for chunk in column.chunks for v in chunk.flatten().to_pylist()]
    ends = np.cumsum(pc.list_value_length(column).to_numpy(), dtype=np.int64).tolist()
    return [values[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _drop(system: fs.FileSystem, path: str) -> None:
    info = system.get_file_info(path)
    if info.type == fs.FileType.Directory:
        system.delete_dir(path)
    elif info.type == fs.FileType.File:
        system.delete_file(path)


def _pad(at: int, alignment: int) -> int:
    return -at % alignment if alignment else 0


def upserted(catalog: Catalog, attrs: dict[str, tuple[str, bytes]]) -> None:
    """Sets the archive's own attributes; a name keeps its type."""
    names = {n: (k, t) for k, (n, t) in enumerate(catalog.keys)}
    for name, (kind, raw) in attrs.items():
        if name in names and names[name][1] != kind:
            raise WriteError(f"attribute {name} has type {names[name][1]}, not {kind}")
        if name not in names:
            names[name] = len(catalog.keys), kind
            catalog.keys.append((name, kind))
        catalog.attrs[names[name][0]] = raw


def layout(out, system, existing: str | None, old: Catalog, entries: Entries, alignment: int, escapes: bool, external: bool, attrs: dict, factored: dict[str, bytes], block: int) -> None:
    """Writes a whole archive: header space, payloads in order, trailer; then its header as the last 32 bytes (see ``finish``).

    factored: attributes of the archive that entries with an equal one don't
    repeat; block: the block size of the entries.  Records are encoded as they
    are laid out; of an entry only its path and the places of its blocks stay.
    """
    catalog = Catalog(Header(1, old.header.external or external, old.header.escapes or escapes, alignment if not old.records else old.header.alignment), [], list(old.keys), dict(old.attrs), old.dictionary)
    alignment = catalog.header.alignment
    upserted(catalog, attrs)
    at = HEADER.size
    out.write(b"\0" * HEADER.size)
    if existing:
        end = max([HEADER.size, *(r.data + r.length for r in old.records if r.data)])
        with system.open_input_file(existing) as f:
            while at < end:
                piece = f.read_at(min(1 << 20, end - at), at)
                if not piece:
                    raise WriteError("existing payloads are cut off", path=existing)
                out.write(piece)
                at += len(piece)
    # positions of keys by name; a name keeps the type it got first
    number = {n: k for k, (n, _) in enumerate(catalog.keys)}

    def interned(names: list[str], raw: list[bytes]) -> dict[int, bytes]:
        done = {}
        for n, v in zip(names, raw, strict=True):
            if factored.get(n) == v:
                continue
            if n not in number:
                number[n] = len(catalog.keys)
                catalog.keys.append((n, STANDARD.get(n, "bytes")))
            done[number[n]] = v
        return done

    with tempfile.TemporaryFile() as records:
        #: paths and numbers of the entries in the index; folders: record numbers of the directories
        paths, numbers, folders, count = [], [], {}, len(old.records)
        for r in old.records:
            records.write(encode_record(r))
        for path, index in old.items():
            paths.append(path.encode())
            numbers.append(index)
            if old.records[index - 1].kind == "directory":
                folders[paths[-1]] = index
        implied: set[bytes] = set()

        def add(path: bytes, kind: str, attrs: dict[int, bytes], **more) -> None:
            nonlocal count
            head, _, name = path.rpartition(SEP.encode())
            if head and head not in folders:
                implied.add(head)
                add(head, "directory", {})
            records.write(encode_record(Record(kind, name.decode(), attrs, **more)))
            count += 1
            paths.append(path)
            numbers.append(count)
            if kind == "directory":
                folders[path] = count

        given = [(p, a, r) for columns, _ in entries.of("directory") for p, a, r in zip(columns["path"], columns["names"], columns["raw"], strict=True)]
        for p, a, r in sorted(given, key=lambda e: e[0].count(SEP.encode())):
            if p not in folders:
                add(p, "directory", interned(a, r))
        del given
        where = [np.stack(old.block_columns(), 1).astype(np.int64)]
        copy = Copier(system, entries.parts, out)
        for columns, rows in entries.of("file", "chunked_file"):
            began, mine = [], []
            for part, p, kind, codec, place, length, size, a, r in zip(*(columns[c] for c in ("part", "path", "kind", "codec", "at", "length", "size", "names", "raw")), strict=True):
                pad = _pad(at, alignment)
                at += pad
                add(p, kind, interned(a, r), compression=codec, length=length, decompressed_length=size, data=at, block_size=block if kind == "chunked_file" else None)
                copy.add(part, place, length, pad)
                began.append(at)
                mine.append(count)
                at += length
            places = rows.column("places").combine_chunks()
            n = pc.fill_null(pc.list_value_length(places), 0).to_numpy().astype(np.int64)
            logical = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * block
            where.append(np.stack([np.repeat(np.array(mine, np.int64), n), logical, np.repeat(np.array(began, np.int64), n) + places.flatten().to_numpy()], 1))
        copy.close()
        before = len(paths)
        linked = pa.array(paths, pa.binary()) if pc.any(pc.equal(entries.table.column("kind"), "link")).as_py() else None
        added: dict[bytes, int] = {}  # links, and directories above them, that links after them may lead to
        for columns, _ in entries.of("link", "external_link"):
            ids = pc.index_in(pa.array(columns["target"], pa.binary()), linked).to_pylist() if linked is not None else [None] * len(columns["path"])
            for p, kind, target, k, outside, a, r in zip(*(columns[c] for c in ("path", "kind", "target")), ids, *(columns[c] for c in ("external", "names", "raw")), strict=True):
                if kind == "external_link":
                    catalog.header.external = True
                    add(p, kind, interned(a, r), external_target=outside)
                    continue
                added |= zip(paths[before:], numbers[before:], strict=True)
                before = len(paths)
                to = numbers[k] if k is not None else added.get(target)
                if to is None:
                    raise WriteError(f"the link's target {(target or b'').decode()!r} isn't in the archive", path=p.decode())
                add(p, kind, interned(a, r), target=to)
        pad = _pad(at, alignment)
        out.write(b"\0" * pad)
        catalog.header.trailer = at + pad
        folders.clear()
        out.write(encode_front(catalog) + encode_vu64(count))
        records.seek(0)
        while piece := records.read(1 << 20):
            out.write(piece)
    entries.table = entries.order = None  # all that is left to write are the indexes
    found = pa.table({"path": pa.array(paths, pa.large_binary()), "number": pa.array(numbers, pa.uint64())})
    del paths, numbers
    found = found.take(pc.sort_indices(found, [("path", "ascending")])).combine_chunks()
    same = pc.equal(found.column(0).slice(1), found.column(0).slice(0, max(0, len(found) - 1)))
    if pc.any(same).as_py():
        path = found.column(0)[pc.index(same, True).as_py()].as_py()
        raise WriteError("the parent isn't a directory" if path in implied else "the path is there already", path=path.decode())
    key = pa.concat_arrays(found.column(0).chunks) if len(found) else pa.array([], pa.large_binary())
    _put_index(out, np.frombuffer(key.buffers()[2] or b"", np.uint8), np.frombuffer(key.buffers()[1], np.int64)[key.offset : key.offset + len(key) + 1] if len(key) else np.zeros(1, np.int64), found.column(1).to_numpy())
    del found, key, same
    blocks = np.concatenate(where)
    where.clear()
    numbers, places = blocks[:, :2].astype(">u8", order="C"), blocks[:, 2].astype(np.uint64)
    del blocks
    _put_index(out, numbers.view(np.uint8).reshape(-1), np.arange(len(places) + 1) * 16, places)
    out.write(catalog.header.encode())


def _put_index(out, keys: np.ndarray, starts: np.ndarray, values: np.ndarray) -> None:
    pieces = built(keys, starts, values) if len(values) else []
    out.write(sum(map(len, pieces)).to_bytes(8, "little"))
    for piece in pieces:
        out.write(piece)


class Copier:
    """Copies payloads from parts in order; neighbours in a part are one copy, and are read ahead where padding parts them."""

    def __init__(self, system: fs.FileSystem, parts: list[str], out):
        self.system, self.parts, self.out = system, parts, out
        self.part, self.start, self.stop, self.f, self.ahead, self.waiting, self.held = -1, 0, 0, {}, {}, [], 0

    def add(self, part: int, at: int, length: int, pad: int) -> None:
        if pad or part != self.part or at != self.stop:
            self.flush()
            self._put(b"\0" * pad)
            self.part, self.start, self.stop = part, at, at
        self.stop += length

    def _put(self, piece: bytes) -> None:
        self.waiting.append(piece)
        self.held += len(piece)
        if self.held >= 1 << 22:
            self.out.write(b"".join(self.waiting))
            self.waiting, self.held = [], 0

    def flush(self) -> None:
        for k in range(self.start, self.stop, 1 << 20):
            self._put(self._read(k, min(1 << 20, self.stop - k)))
        self.start = self.stop

    def _read(self, at: int, n: int) -> bytes:
        if self.part not in self.f:
            self.f[self.part] = self.system.open_input_file(self.parts[self.part])
        begin, ahead, next_at = self.ahead.get(self.part, (0, b"", 0))
        if not begin <= at <= at + n <= begin + len(ahead):
            # only what goes on where the last copy ended is worth reading ahead
            begin, ahead = at, self.f[self.part].read_at(1 << 20 if at == next_at else n, at)
        self.ahead[self.part] = begin, ahead, at + n
        piece = ahead[at - begin : at - begin + n]
        if len(piece) != n:
            raise WriteError("a part is cut off", path=self.parts[self.part])
        return piece

    def close(self) -> None:
        self.flush()
        self.out.write(b"".join(self.waiting))
        for f in self.f.values():
            f.close()


def finish(system: fs.FileSystem, draft: str, final: str) -> None:
    """Moves the draft's last 32 bytes to its front, and the draft to its place."""
    if isinstance(system, fs.LocalFileSystem):
        with open(draft, "r+b") as f:
            f.seek(-HEADER.size, os.SEEK_END)
            header = f.read()
            f.seek(0)
            f.write(header)
            f.truncate(os.path.getsize(draft) - HEADER.size)
        os.replace(draft, final)
        return
    staged = f"{draft}.staged"
    with system.open_input_file(draft) as f, system.open_output_stream(staged) as out:
        size = f.size() - HEADER.size
        out.write(f.read_at(HEADER.size, size))
        for k in range(HEADER.size, size, 1 << 20):
            out.write(f.read_at(min(1 << 20, size - k), k))
    system.move(staged, final)


def write(entries: DataFrame, path: str, append: bool = False, through: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None, **options) -> None:
    """Writes entries as an archive; through: what a task turns their batches into first, so that contents needn't be moved for it."""
    if "archive_attrs" in options:
        options["archive_attrs"] = json.dumps({n: (t, base64.b64encode(v).decode()) for n, (t, v) in options["archive_attrs"].items()})
    system, inner = open_file(path)
    work = f"{inner}.parts-{uuid.uuid4().hex}"
    try:
        writer = Writer({k: str(v) for k, v in options.items()} | {"path": path, "work": work}, entries.schema, not append)

        def put(batches):
            # a few rows at a time become Python's: their contents may be long
            r = writer.put(row for b in (through(batches) if through else batches) for k in range(0, b.num_rows, FEW) for row in b.slice(k, FEW).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([r.part]), pa.array([list(r.dictionaries)], pa.list_(pa.binary()))], names=["part", "dictionaries"])

        # a part of a task that failed, or ran twice, is in the folder and not in the plan
        parts = entries.mapInArrow(put, "part string, dictionaries array<binary>").collect()
        writer.commit([Prepared(p, set(map(bytes, d))) for p, d in parts])

        def run(batches):
            for b in batches:
                for _ in range(b.num_rows):
                    there, _ = open_file(path)
                    with there.open_input_stream(f"{work}/plan") as f:
                        writer, parts = pickle.loads(f.read())
                    yield pa.RecordBatch.from_arrays([pa.array([writer.lay(parts)])], names=["draft"])

        draft = entries.sparkSession.range(0, 1, 1, 1).mapInArrow(run, "draft string").first()[0]
        finish(system, draft, inner)
    finally:
        _drop(system, work)


def set_attributes(path: str, attrs: dict[str, tuple[str, bytes]], member: str | None = None) -> None:
    """Upserts attributes (name to type and raw bytes) of the archive, or of one member, by rewriting the trailer."""
    catalog, _ = open_archive(path)
    if member is None:
        upserted(catalog, attrs)
    else:
        index = catalog.find(member)
        if index is None:
            raise WriteError("no such member", path=member)
        catalog.records = list(catalog.records)  # one of them is changed
        own, catalog.attrs = catalog.attrs, catalog.records[index - 1].attrs
        upserted(catalog, attrs)
        catalog.attrs = own
    rewrite_trailer(path, catalog)


def rewrite_trailer(path: str, catalog: Catalog) -> None:
    system, inner = open_file(path)
    draft = f"{inner}.draft-{uuid.uuid4().hex}"
    blocks = {(i, a): b for i, a, b in catalog.block_items()}
    body = encode_trailer(catalog, dict(catalog.items()), blocks)
    with system.open_input_file(inner) as f, system.open_output_stream(draft) as out:
        for k in range(0, catalog.header.trailer, 1 << 20):
            out.write(f.read_at(min(1 << 20, catalog.header.trailer - k), k))
        out.write(body + catalog.header.encode())
    finish(system, draft, inner)


def validate(spark: SparkSession, path: str) -> DataFrame:
    """files_checked, files_without_checksum, checksum_failures of each archive; a payload that doesn't decode is an error."""
    from ..operators.summary import validation

    return validation(checksums(spark, path))


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """archive_id, record_index, expected (null: no usable one), actual."""
    attrs = scan(spark, path, "attrs").where("key = 'blake3' AND effective_type = 'u256' AND record_index IS NOT NULL").select("archive_id", "record_index", F.col("raw").alias("expected"))

    def hashed(batches):
        for b in batches:
            digests = blake3_many(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(digests, pa.binary())], names=["archive_id", "record_index", "actual"])

    # a payload is hashed where it is read, and goes nowhere
    actual = scan(spark, path, "contents", hashed, "archive_id long, record_index long, actual binary")
    return actual.join(attrs, ["archive_id", "record_index"], "left")


def _chosen(catalog: Catalog, members: list[str] | None, path: str) -> list[tuple[str, int]]:
    """The entries to extract, checked: valid paths that agree with their records, each record once."""
    items = catalog.items()
    if members is not None:
        there = {p for p, _ in items}
        for m in members:
            if m not in there:
                raise ExtractError("no such member", path=m)
        items = [(p, i) for p, i in items if any(p == m or p.startswith(m + SEP) for m in members)]
    seen: dict[int, str] = {}
    for p, i in items:
        try:
            check_extractable(p, catalog.header.escapes)
        except PathError as e:
            raise ExtractError(e.message, path=p) from None
        if not 1 <= i <= len(catalog.records) or catalog.records[i - 1].name != p.rpartition(SEP)[2]:
            raise ExtractError("path and record don't agree", path=p)
        if i in seen:
            raise ExtractError(f"the record is {seen[i]!r} too", path=p)
        seen[i] = p
    return items


def opens(mode: int) -> bool:
    """Whether an archive's mode can be that of its directories: their type, or none with the owner's search bit."""
    return stat.S_ISDIR(mode) or (not stat.S_IFMT(mode) and bool(mode & stat.S_IXUSR))


def extract(
    spark: SparkSession, path: str, to: str, members: list[str] | None = None, verify: bool = True, allow_escapes: bool = False, allow_external: bool = False, xattrs: bool = False
) -> dict[str, int]:
    """Writes an archive's entries below a shared folder: directories, then files in parallel, then links.

    members: archive paths, each with all below it; only their payloads are
    read.  Files and directories get their mode, the record's, else the
    archive's, else the default of their kind; an archive's mode that says it is
    a file's, or has no search bit, is none for a directory, which nobody but
    root could enter.  xattrs: extended attributes too, where the file system
    takes them.  A checksum that differs is counted and
    doesn't stop the extraction.
    """
    catalog, _ = open_archive(path)
    if catalog.header.escapes and not allow_escapes:
        raise ExtractError("the archive has escaped paths", path=path)
    if catalog.header.external and not allow_external:
        raise ExtractError("the archive has external links", path=path)
    items = _chosen(catalog, members, path)
    os.makedirs(to, exist_ok=True)
    stats = {"directories": 0, "files": 0, "links": 0, "bytes": 0, "checksum_failures": 0}
    where = lambda p: os.path.join(to, *p.split(SEP))
    names = {n: (k, t) for k, (n, t) in enumerate(catalog.keys)}

    def number(attrs: dict[int, bytes], name: str) -> int | None:
        key, kind = names.get(name, (None, ""))
        return decode_number(kind, attrs[key]) if key in attrs else None

    common = number(catalog.attrs, "unix.mode")

    def mode(index: int) -> int:
        record = catalog.records[index - 1]
        found = number(record.attrs, "unix.mode")
        if found is None and (record.kind != "directory" or common is not None and opens(common)):
            found = common
        return (DEFAULT_MODES[record.kind] if found is None else found) & 0o7777

    def extended(index: int) -> list[tuple[str, bytes]]:
        attrs = catalog.records[index - 1].attrs
        return [(n.removeprefix(XATTR), attrs[k]) for n, (k, _) in names.items() if n.startswith(XATTR) and k in attrs] if xattrs else []

    directories = [(p, i) for p, i in items if catalog.records[i - 1].kind == "directory"]
    for p, _ in directories:
        os.makedirs(where(p), exist_ok=True)
        stats["directories"] += 1
    key, kind = names.get("blake3", (None, ""))
    sums = verify and kind == "u256"
    files = [(i, where(p), mode(i), extended(i), w if sums and (w := catalog.records[i - 1].attrs.get(key)) and len(w) == 32 else None) for p, i in items if catalog.records[i - 1].kind in ("file", "chunked_file")]
    if files:
        wanted = spark.createDataFrame(files, "record_index long, file string, mode int, xattrs array<struct<name:string,value:binary>>, expected binary")

        def put(batches):
            import pyarrow as pa

            for b in batches:
                out, bodies, wants = [], b.column("content").to_pylist(), b.column("expected").to_pylist()
                digests = blake3_many([c for c, w in zip(bodies, wants, strict=True) if w is not None])[::-1]
                for body, file, bits, more, want in zip(bodies, *(b.column(c).to_pylist() for c in ("file", "mode", "xattrs")), wants, strict=True):
                    os.makedirs(os.path.dirname(file), exist_ok=True)
                    with open(file, "wb") as f:
                        f.write(body)
                    for x in more:
                        with contextlib.suppress(OSError):
                            os.setxattr(file, x["name"], x["value"])
                    os.chmod(file, bits)
                    out.append((len(body), int(want is not None and digests.pop() != want)))
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["bytes", "failed"])

        rows = load(spark, path, "contents")
        if members is not None:  # record numbers are pushed down, so that other payloads aren't read
            rows = rows.where(F.col("record_index").isin([i for i, *_ in files]))
        rows = rows.join(wanted, "record_index").select("content", "file", "mode", "xattrs", "expected")
        done = rows.mapInArrow(put, "bytes long, failed long").agg(F.count("*"), F.sum("bytes"), F.sum("failed")).first()
        stats |= {"files": done[0], "bytes": done[1] or 0, "checksum_failures": done[2] or 0}
    path_of = {i: p for p, i in reversed(catalog.items())}
    for p, i in items:
        r = catalog.records[i - 1]
        if r.kind in ("link", "external_link"):
            if r.kind == "link" and r.target not in path_of:
                raise ExtractError(f"link target {r.target} isn't in the archive", path=p)
            os.makedirs(os.path.dirname(where(p)), exist_ok=True)
            os.symlink(os.path.relpath(where(path_of[r.target]), os.path.dirname(where(p))) if r.kind == "link" else r.external_target, where(p))
            stats["links"] += 1
    # the deepest first, and after all else, as a directory may be closed to writing
    for p, i in sorted(directories, key=lambda x: -x[0].count(SEP)):
        for name, value in extended(i):
            with contextlib.suppress(OSError):
                os.setxattr(where(p), name, value)
        os.chmod(where(p), mode(i))
    return stats


def create(
    spark: SparkSession, folder: str, path: str, recursive: bool = True, include_hidden: bool = False, exclude: list[str] = (), allow_external: bool = False, force: bool = False,
    alignment: int = 8, timestamps: bool = False, ownership: bool = False, xattrs: bool = False, **options,
) -> None:
    """An archive of a folder that executors share: directories, files with their attributes, links.

    exclude: globs on the whole path below the folder.  The archive itself is
    never taken in.  Not recursive: directories below the folder get no entry
    of their own; files in them do, with the directories those need.
    """
    from ..operators.entries import collect
    from .files import capture_links, with_attributes

    system, inner = open_file(path)
    if not force and system.get_file_info(inner).type == fs.FileType.File:
        raise WriteError("the archive exists already", path=path)
    root = os.path.abspath(folder)
    own = os.path.relpath(os.path.abspath(path), root).replace(os.sep, SEP)
    names, folders = listing(folder)
    links = {r[0] for r in capture_links(spark, folder, [], allow_external=True).select("path").collect()}
    operands = spark.createDataFrame([(p, False) for p in names if p not in links] + [(p, True) for p in folders if p not in links], "path string, is_dir boolean")
    kept = collect(operands.withColumns({"position": F.lit(0), "root": F.lit("")}), include_hidden, exclude, recursive, own)
    # a file below a hidden or excluded directory is judged by its own path, as a walk that goes on below it does
    rows = with_attributes(contents_of(kept.where("NOT is_dir").select("path"), folder), folder, timestamps=timestamps, ownership=ownership, xattrs=xattrs)
    archived = [r[0] for r in kept.select("path").collect()]
    made = kept.where("is_dir").select("path", F.lit("directory").alias("record_type"))
    taken = collect(capture_links(spark, folder, archived, allow_external).withColumns({"position": F.lit(0), "root": F.lit(""), "is_dir": F.lit(False)}), include_hidden, exclude, True, own)
    entries = rows.unionByName(made, allowMissingColumns=True).unionByName(taken.drop("position", "root", "is_dir"), allowMissingColumns=True)
    write(entries, path, alignment=alignment, walked=True, factor_owners=ownership, allow_external_symlinks=allow_external, **options)


def refuse(error: OSError) -> None:
    """A folder that can't be listed is an error, never an empty one."""
    raise error


def listing(folder: str) -> tuple[list[str], list[str]]:
    """The paths below a folder of its files and of its folders, hidden ones too; links aren't followed."""
    system, inner = open_file(folder)
    files, folders = [], []
    if isinstance(system, fs.LocalFileSystem):
        for top, dirs, names in os.walk(inner, onerror=refuse):
            files += [os.path.relpath(os.path.join(top, n), inner) for n in names]
            folders += [os.path.relpath(os.path.join(top, n), inner) for n in dirs]
    else:
        for info in system.get_file_info(fs.FileSelector(inner, recursive=True)):
            (files if info.type == fs.FileType.File else folders).append(info.path[len(inner) :].strip("/"))
    return sorted(p.replace("/", SEP) for p in files), sorted(p.replace("/", SEP) for p in folders)


def contents_of(paths: DataFrame, folder: str) -> DataFrame:
    """paths(path) as rows to write, the files read by the tasks, one at a time."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for p in b.column(0).to_pylist():
                system, inner = open_file(folder)
                with system.open_input_stream(f"{inner}/{p.replace(SEP, '/')}") as f:
                    yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array(["file"]), pa.array([f.read()], pa.binary())], names=["path", "record_type", "content"])

    return paths.select("path").mapInArrow(run, "path string, record_type string, content binary")


def walk(spark: SparkSession, folder: str, include_hidden: bool = False, pattern: str | None = None) -> DataFrame:
    """Files below a folder as rows to write; pattern: a glob on the whole path below it, where * and ? also match a slash.

    Names are listed on the driver, and dealt out to the tasks that read them.
    """
    from ..functions.scalars import glob_regex

    paths = spark.createDataFrame([(p,) for p in listing(folder)[0]], "path string")
    if pattern:
        paths = paths.where(F.replace("path", F.lit(SEP), F.lit("/")).rlike(glob_regex(pattern)))
    if not include_hidden:
        paths = paths.where(~F.substring_index("path", SEP, -1).startswith("."))
    return contents_of(paths.repartition("path"), folder)
