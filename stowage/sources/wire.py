"""The archive's bytes: header, trailer (versions 0 and 1), records, attributes.

Every count and length is checked against the bytes that are left before
anything is allocated.
"""

from __future__ import annotations

import struct
from array import array
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np

from .codecs import NUMBERS, codec_name
from .errors import OpenError, ParseError, WriteError
from .pindex import Index, build
from .vint import decode_vi64, decode_vu64, encode_vi64, encode_vu64

# Fixed values of the format.
MAGIC = bytes([0xFF, 0x42, 0x4F, 0x58])
HEADER, PLACE = struct.Struct("<4sBBHIIQQ"), struct.Struct("<QQQ")
EXTERNAL, ESCAPES = 1, 2
TYPES = ["bytes", "string", "json", "u8", "vi32", "vu32", "vi64", "vu64", "u128", "u256", "datetime"]
KINDS = {0x01: "directory", 0x02: "file", 0x03: "link", 0x0A: "chunked_file", 0x0B: "external_link"}
KIND_NUMBERS = {v: k for k, v in KINDS.items()}
OLD_KINDS = {0: "file", 1: "directory", 2: "link", 3: "external_link"}
XATTR = "linux.xattr."
# Standard attributes and their types.
STANDARD = {
    "created": "datetime", "modified": "datetime", "accessed": "datetime",
    "created.seconds": "u8", "modified.seconds": "u8", "accessed.seconds": "u8",
    "created.nanoseconds": "vu64", "modified.nanoseconds": "vu64", "accessed.nanoseconds": "vu64",
    "unix.mode": "vu32", "unix.uid": "vu32", "unix.gid": "vu32", "blake3": "u256",
}


@dataclass
class Header:
    version: int = 1
    external: bool = False
    escapes: bool = False
    alignment: int = 0
    trailer: int = 0

    def encode(self) -> bytes:
        flags = (EXTERNAL if self.external else 0) | (ESCAPES if self.escapes else 0)
        return HEADER.pack(MAGIC, self.version, flags, 0, self.alignment, 0, self.trailer, 0)

    @classmethod
    def decode(cls, data: bytes) -> Header:
        if len(data) < HEADER.size:
            raise ParseError("header is cut off")
        magic, version, flags, _, alignment, _, trailer, _ = HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ParseError("not an archive", 0)
        return cls(version, bool(flags & EXTERNAL), bool(flags & ESCAPES), alignment, trailer)


@dataclass(slots=True)
class Record:
    kind: str
    name: str
    attrs: dict[int, bytes] = field(default_factory=dict)
    compression: str | None = None
    compression_id: int | None = None
    length: int | None = None
    decompressed_length: int | None = None
    data: int | None = None
    block_size: int | None = None
    target: int | None = None
    external_target: str | None = None
    entries: list[int] = field(default_factory=list)


@dataclass
class Catalog:
    header: Header
    records: Sequence[Record] = field(default_factory=list)
    keys: list[tuple[str, str]] = field(default_factory=list)
    attrs: dict[int, bytes] = field(default_factory=dict)
    dictionary: bytes | None = None
    root: list[int] = field(default_factory=list)
    paths: Index | None = None
    blocks: Index | None = None

    def items(self) -> list[tuple[str, int]]:
        """(path, record index) of all entries: from the stored tree if there is one, else from the index."""
        return list(self.walked())

    def walked(self) -> Iterator[tuple[str, int]]:
        """``items``, one at a time."""
        if self.root:
            yield from _tree(self)
        elif self.paths is not None:
            for k, v in self.paths.items():
                yield k.decode(), v

    def block_items(self) -> list[tuple[int, int, int]]:
        """(record index, logical offset, physical offset); keys of another length are passed over."""
        return list(zip(*(c.tolist() for c in self.block_columns()), strict=True))

    def block_columns(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``block_items`` as columns of unsigned numbers."""
        keys, physical = self.blocks.of_length(16) if self.blocks is not None else (np.empty((0, 16), np.uint8), np.empty(0, np.uint64))
        numbers = np.ascontiguousarray(keys).view(">u8").astype(np.uint64)
        return numbers[:, 0], numbers[:, 1], physical

    def blocks_of(self, index: int) -> list[tuple[int, int]]:
        """(logical offset, physical offset) of a record's blocks in order, by a prefix scan."""
        if self.blocks is None:
            return []
        return [(struct.unpack(">Q", k[8:])[0], v) for k, v in self.blocks.prefix(struct.pack(">Q", index)) if len(k) == 16]

    def find(self, path: str) -> int | None:
        if self.root or self.paths is None:
            return next((v for k, v in self.items() if k == path), None)
        return self.paths.get(path.encode())


def _tree(catalog: Catalog) -> list[tuple[str, int]]:
    """Paths of a stored tree in its order; an index met twice or out of range is an error."""
    out, seen = [], set()
    stack = [("", i) for i in reversed(catalog.root)]
    while stack:
        above, i = stack.pop()
        if not 1 <= i <= len(catalog.records):
            raise ParseError(f"the tree names record {i} of {len(catalog.records)}")
        if i in seen:
            raise ParseError(f"the tree names record {i} twice")
        seen.add(i)
        record = catalog.records[i - 1]
        path = f"{above}\x1f{record.name}" if above else record.name
        out.append((path, i))
        stack += [(path, k) for k in reversed(record.entries)]
    return out


class Reader:
    """A place in bytes, with checked reads."""

    def __init__(self, data: bytes, at: int = 0, end: int | None = None):
        self.data, self.at, self.end = data, at, len(data) if end is None else end

    def view(self, n: int, what: str) -> bytes | memoryview:
        """As ``take``, without a copy where the data are a view."""
        if n > self.end - self.at:
            raise ParseError(f"{what} is cut off", self.at)
        out = self.data[self.at : self.at + n]
        self.at += n
        return out

    def take(self, n: int, what: str) -> bytes:
        return bytes(self.view(n, what))

    def u8(self, what: str) -> int:
        return self.take(1, what)[0]

    def fixed(self, n: int, what: str) -> int:
        return int.from_bytes(self.take(n, what), "little")

    def vu(self, what: str) -> int:
        value, self.at = decode_vu64(self.data, self.at, self.end)
        return value

    def count(self, what: str) -> int:
        n = self.vu(what)
        if n > self.end - self.at:
            raise ParseError(f"{what} exceeds the bytes left", self.at)
        return n

    def bytes(self, what: str) -> bytes:
        return self.take(self.vu(what), what)

    def text(self, what: str) -> str:
        at = self.at
        try:
            return self.bytes(what).decode()
        except UnicodeDecodeError:
            raise ParseError(f"{what} is not UTF-8", at) from None

    def index(self, what: str) -> int:
        value = self.vu(what)
        if value == 0:
            raise ParseError(f"{what} is zero", self.at)
        return value

    def attrs(self) -> dict[int, bytes]:
        """An attribute map; its byte count may include the count field's own eight bytes."""
        size = self.fixed(8, "attribute map size")
        if size > self.end - self.at:
            raise ParseError("attribute map is cut off", self.at)
        inner = Reader(self.data, self.at, self.at + size)
        out = {}
        for _ in range(inner.count("attribute count")):
            key = inner.vu("attribute key")
            out[key] = inner.bytes("attribute value")
        if inner.end - inner.at not in (0, 8):
            raise ParseError("attribute map size doesn't match its entries", self.at)
        self.at = inner.at
        return out


def _record(r: Reader, version: int) -> Record:
    kind_at, byte = r.at, r.u8("record type")
    kind = OLD_KINDS.get(byte) if version == 0 else KINDS.get(byte & 0x0F)
    if kind is None:
        raise ParseError(f"unknown record type {byte:#04x}", kind_at)
    out = Record(kind, "")
    if kind in ("file", "chunked_file"):
        number = r.u8("codec") if version == 0 else byte & 0xF0
        out.compression, out.compression_id = codec_name(number), number
        if kind == "chunked_file":
            out.block_size = r.fixed(4, "block size")
        out.length, out.decompressed_length, out.data = (r.fixed(8, w) for w in ("length", "logical length", "data offset"))
        if out.data == 0:
            raise ParseError("data offset is zero", kind_at)
    out.name = r.text("record name")
    if kind == "directory" and version == 0:
        out.entries = [r.index("child") for _ in range(r.count("child count"))]
    elif kind == "link":
        out.target = r.index("link target")
    elif kind == "external_link":
        out.external_target = r.text("link target")
    out.attrs = r.attrs()
    return out


def _quick(data: bytes, at: int, end: int) -> tuple[Record, int] | None:
    """``_record`` of version 1 and the place after it, where all its integers are short and nothing is wrong; else None."""
    try:
        byte = data[at]
        kind = KINDS[byte & 0x0F]
        out, at = Record(kind, ""), at + 1
        if kind == "file" or kind == "chunked_file":
            out.compression, out.compression_id = codec_name(byte & 0xF0), byte & 0xF0
            if kind == "chunked_file":
                out.block_size = int.from_bytes(data[at : at + 4], "little")
                at += 4
            out.length, out.decompressed_length, out.data = PLACE.unpack_from(data, at)
            at += PLACE.size
            if not out.data:
                return None
        n, at = data[at] - 0x80, at + 1
        if n < 0 or at + n > end:
            return None
        out.name = str(data[at : at + n], "utf-8")
        at += n
        if kind == "link":
            out.target, at = decode_vu64(data, at, end)
            if not out.target:
                return None
        elif kind == "external_link":
            n, at = data[at] - 0x80, at + 1
            if n < 0 or at + n > end:
                return None
            out.external_target = str(data[at : at + n], "utf-8")
            at += n
        stop = at + 8 + int.from_bytes(data[at : at + 8], "little")
        if stop > end:
            return None
        n, at = data[at + 8] - 0x80, at + 9
        for _ in range(n):
            key, size = data[at] - 0x80, data[at + 1] - 0x80
            if key < 0 or size < 0:
                return None
            out.attrs[key] = bytes(data[at + 2 : at + 2 + size])
            at += 2 + size
        return (out, at) if n >= 0 and at == stop else None
    except (IndexError, KeyError, ValueError, struct.error, ParseError):
        return None


class Records(Sequence):
    """The records of a trailer of version 1, checked once, and made from their bytes whenever they are asked for.

    Of a record only its place is kept, so that a catalog takes little more than its bytes.
    """

    def __init__(self, data: bytes, at: int, end: int, count: int):
        self.data, self.end, self.places = data, end, array("q")
        for _ in range(count):
            self.places.append(at)
            at = self._made(at)[1]
        self.stop = at

    def _made(self, at: int) -> tuple[Record, int]:
        found = _quick(self.data, at, self.end)
        if found is None:
            r = Reader(self.data, at, self.end)
            found = _record(r, 1), r.at
        return found

    def __len__(self) -> int:
        return len(self.places)

    def __getitem__(self, k):
        return [self._made(at)[0] for at in self.places[k]] if isinstance(k, slice) else self._made(self.places[k])[0]

    def __iter__(self) -> Iterator[Record]:
        return (self._made(at)[0] for at in self.places)

    def __eq__(self, other) -> bool:
        return len(self) == len(other) and all(a == b for a, b in zip(self, other, strict=True))

    def between(self, low: int, high: int) -> list[int]:
        """The numbers, from 1, of the files whose payloads begin there."""
        data, at = np.frombuffer(self.data, np.uint8), np.array(self.places, np.int64)
        kind = data[at] & 0x0F
        numbers = np.flatnonzero((kind == KIND_NUMBERS["file"]) | (kind == KIND_NUMBERS["chunked_file"]))
        at = at[numbers] + np.where(kind[numbers] == KIND_NUMBERS["file"], 17, 21)
        begins = sum(data[at + k].astype(np.uint64) << np.uint64(8 * k) for k in range(8)) if len(at) else np.empty(0, np.uint64)
        return (numbers[(begins >= np.uint64(max(0, low))) & (begins < np.uint64(max(0, high)))] + 1).tolist()


def _key(r: Reader, version: int) -> tuple[str, str]:
    if version == 0:
        return r.text("attribute name"), "json"
    tag = r.u8("attribute type")
    if tag >= len(TYPES):
        raise ParseError(f"reserved attribute type {tag}", r.at - 1)
    return r.text("attribute name"), TYPES[tag]


def decode_trailer(data: bytes, header: Header, strict: bool = False) -> Catalog:
    """The catalog in a trailer's bytes. strict: version 1 only, and both index envelopes must be there."""
    if strict and header.version != 1:
        raise OpenError(f"version {header.version} isn't read in strict mode")
    r, out = Reader(data), Catalog(header)
    if header.version == 0:
        out.root = [r.index("root entry") for _ in range(r.count("root count"))]
        out.records = [_record(r, 0) for _ in range(r.count("record count"))]
        out.keys = [_key(r, 0) for _ in range(r.count("attribute key count"))]
        out.attrs = r.attrs()
        return out
    out.keys = [_key(r, 1) for _ in range(r.count("attribute key count"))]
    out.attrs = r.attrs()
    out.dictionary = r.bytes("dictionary") or None
    count = r.count("record count")
    out.records = Records(data, r.at, r.end, count)
    r.at = out.records.stop
    found = []
    for what in ("path index", "block index"):
        if r.at == r.end and what == "block index" and not strict:
            found.append(None)
            continue
        body = r.view(r.fixed(8, f"{what} size"), what)
        found.append(Index(body) if len(body) else None)
    out.paths, out.blocks = found
    return out


def encode_attrs(attrs: dict[int, bytes]) -> bytes:
    body = encode_vu64(len(attrs)) + b"".join(encode_vu64(k) + encode_vu64(len(v)) + v for k, v in sorted(attrs.items()))
    return len(body).to_bytes(8, "little") + body


def _text(value: str) -> bytes:
    raw = value.encode()
    return encode_vu64(len(raw)) + raw


def encode_record(r: Record) -> bytes:
    number = r.compression_id if r.compression_id is not None else NUMBERS.get(r.compression or "stored", 0)
    out = bytes([KIND_NUMBERS[r.kind] | (number if r.kind in ("file", "chunked_file") else 0)])
    if r.kind == "chunked_file":
        out += r.block_size.to_bytes(4, "little")
    if r.kind in ("file", "chunked_file"):
        out += struct.pack("<QQQ", r.length, r.decompressed_length, r.data)
    out += _text(r.name)
    if r.kind == "link":
        out += encode_vu64(r.target)
    elif r.kind == "external_link":
        out += _text(r.external_target)
    return out + encode_attrs(r.attrs)


def encode_front(catalog: Catalog) -> bytes:
    """What a trailer of version 1 begins with, up to its records."""
    out = encode_vu64(len(catalog.keys)) + b"".join(bytes([TYPES.index(t)]) + _text(n) for n, t in catalog.keys)
    return out + encode_attrs(catalog.attrs) + encode_vu64(len(catalog.dictionary or b"")) + (catalog.dictionary or b"")


def encode_trailer(catalog: Catalog, paths: dict[str, int], blocks: dict[tuple[int, int], int]) -> bytes:
    """Version 1 bytes; paths and blocks are sorted into their indexes."""
    out = encode_front(catalog) + encode_vu64(len(catalog.records)) + b"".join(map(encode_record, catalog.records))
    for rows in (sorted((p.encode(), i) for p, i in paths.items()), sorted((struct.pack(">QQ", *k), v) for k, v in blocks.items())):
        body = build(rows) if rows else b""
        out += len(body).to_bytes(8, "little") + body
    return out


def encode_old(catalog: Catalog, padded: bool = False) -> bytes:
    """Version 0 bytes: the stored tree, untyped keys; padded: the sizes of records' attribute maps count their own eight bytes."""

    def attrs(values: dict[int, bytes]) -> bytes:
        body = encode_attrs(values)[8:]
        return (len(body) + (8 if padded else 0)).to_bytes(8, "little") + body

    numbers = {v: k for k, v in OLD_KINDS.items()}
    listed = lambda xs: encode_vu64(len(xs)) + b"".join(map(encode_vu64, xs))
    out = listed(catalog.root) + encode_vu64(len(catalog.records))
    for r in catalog.records:
        out += bytes([numbers[r.kind]])
        if r.kind == "file":
            out += bytes([NUMBERS[r.compression]]) + struct.pack("<QQQ", r.length, r.decompressed_length, r.data)
        out += _text(r.name)
        if r.kind == "directory":
            out += listed(r.entries)
        elif r.kind == "link":
            out += encode_vu64(r.target)
        elif r.kind == "external_link":
            out += _text(r.external_target)
        out += attrs(r.attrs)
    return out + encode_vu64(len(catalog.keys)) + b"".join(_text(n) for n, _ in catalog.keys) + encode_attrs(catalog.attrs)


def encode_value(kind: str, value) -> bytes:
    """An attribute's raw bytes."""
    if kind in ("bytes", "u128", "u256"):
        raw = bytes(value)
        if kind != "bytes" and len(raw) != {"u128": 16, "u256": 32}[kind]:
            raise WriteError(f"{kind} of {len(raw)} bytes")
        return raw
    if kind in ("string", "json"):
        return value.encode()
    if kind == "u8":
        return bytes([value])
    if kind in ("vu32", "vu64"):
        return encode_vu64(value)
    return encode_vi64(value)


def decode_number(kind: str, raw: bytes) -> int | None:
    """The number in an attribute, or None where it doesn't use up the bytes or doesn't fit."""
    if kind == "u8":
        return raw[0] if len(raw) == 1 else None
    if kind not in ("vi32", "vu32", "vi64", "vu64", "datetime"):
        return None
    try:
        value, stop = (decode_vu64 if kind.startswith("vu") else decode_vi64)(raw)
    except ParseError:
        return None
    if stop != len(raw):
        return None
    low, high = {"vi32": (-(2**31), 2**31 - 1), "vu32": (0, 2**32 - 1)}.get(kind, (-(2**63), 2**64 - 1))
    return value if low <= value <= high else None
