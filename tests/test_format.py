"""Bytes: integers, index, records, codecs, digests, paths, hostile input."""

import random
import struct
import tracemalloc

import pytest
from hypothesis import given
from hypothesis import strategies as st

from stowage.functions.digest import blake3, blake3_many
from stowage.functions.paths import check_extractable, normalize
from stowage.sources import codecs, pindex, vint, wire
from stowage.sources.errors import ArchiveError, CodecError, ParseError, PathError, WriteError

VECTORS = {0: "80", 1: "81", 127: "ff", 128: "4000", 16511: "7fff", 16512: "200000", 2**64 - 1: "007fbfdfeff7fbfdfe"}


@pytest.mark.parametrize("value", VECTORS)
def test_integer_vectors(value):
    raw = bytes.fromhex(VECTORS[value])
    assert vint.encode_vu64(value) == raw
    assert vint.decode_vu64(raw) == (value, len(raw))


@given(st.integers(0, 2**64 - 1), st.integers(-(2**63), 2**63 - 1))
def test_integers_round_trip(u, i):
    assert vint.decode_vu64(vint.encode_vu64(u))[0] == u
    assert vint.decode_vi64(vint.encode_vi64(i))[0] == i


@given(st.dictionaries(st.binary(max_size=12), st.integers(0, 2**64 - 1), min_size=1, max_size=80), st.binary(max_size=3))
def test_index_round_trip(entries, prefix):
    rows = sorted(entries.items())
    index = pindex.Index(pindex.build(rows))
    assert list(index.items()) == rows and len(index) == len(rows)
    assert list(index.prefix(prefix)) == [r for r in rows if r[0].startswith(prefix)]
    assert all(index.get(k) == v for k, v in rows)
    assert (index.get(prefix) is not None) == (prefix in entries)


def test_index_of_many_edges_and_errors():
    rows = [(bytes([k]), k + 1) for k in range(256)]
    assert list(pindex.Index(pindex.build(rows)).items()) == rows
    for bad in ([(b"a", 1), (b"a", 2)], [(b"b", 1), (b"a", 2)], []):
        with pytest.raises(WriteError):
            pindex.build(bad)


def test_index_refuses_damage():
    good = pindex.build([(b"ab", 1), (b"ac", 2), (b"b", 3)])
    rng = random.Random(5)
    for k in range(len(good)):
        with pytest.raises(ParseError):
            list(pindex.Index(good[:k]).items())
    for _ in range(500):
        bad = bytearray(good)
        bad[rng.randrange(len(bad))] = rng.randrange(256)
        try:
            list(pindex.Index(bytes(bad)).items())
        except (ParseError, struct.error):
            pass


@pytest.mark.parametrize(
    "n,head", [(0, "af1349b9f5f9a1a6"), (1, "2d3adedff11b61f1"), (1024, "42214739f095a406"), (1025, "d00278ae47eb27b3"), (2049, "5f4d72f40d7a5f82"), (3073, "7124b49501012f81")]
)
def test_blake3_published_vectors(n, head):
    assert blake3(bytes(k % 251 for k in range(n))).hex().startswith(head)


def test_blake3_together_equals_alone():
    texts = [bytes(k % 251 for k in range(n)) for n in (0, 1, 64, 65, 1023, 1024, 1025, 2048, 3000, 5121, 9000, 16384, 20000)]
    assert blake3_many(texts) == [blake3(t) for t in texts] and blake3_many([]) == []


@pytest.mark.parametrize("codec", ["stored", "zstd", "xz"])
def test_codecs(codec):
    data = b"some content " * 100
    packed = codecs.compress(data, codec)
    assert codecs.decompress(packed, codec) == data
    if codec != "stored":
        with pytest.raises(CodecError):
            codecs.decompress(packed[:-3], codec)
    with pytest.raises(CodecError):
        codecs.decompress(data, "?30?")


def test_dictionary_training_gate():
    assert codecs.train([]) is None
    assert codecs.train([b"x" * 5000] * 3, 1024) is None
    samples = [bytes(f"record {k} of the same kind of text, number {k * 7}", "ascii") * 3 for k in range(2000)]
    d = codecs.train(samples, 1024)
    assert d and codecs.decompress(codecs.compress(samples[3], "zstd", dictionary=d), "zstd", d) == samples[3]


def make(records=(), keys=(), attrs=None, paths=None, blocks=None, dictionary=None):
    c = wire.Catalog(wire.Header(1, trailer=32), list(records), list(keys), attrs or {}, dictionary)
    return wire.encode_trailer(c, paths or {}, blocks or {})


def test_trailer_round_trip():
    records = [
        wire.Record("directory", "d", {0: b"v"}),
        wire.Record("file", "f", {}, "zstd", None, 10, 20, 32),
        wire.Record("chunked_file", "c", {}, "xz", None, 30, 200, 64, 100),
        wire.Record("link", "l", target=2),
        wire.Record("external_link", "e", external_target="../x"),
    ]
    raw = make(records, [("k", "string"), ("n", "vu64")], {1: b"\x81"}, {"d": 1, "d\x1ff": 2}, {(3, 0): 64, (3, 100): 80}, b"dict")
    c = wire.decode_trailer(raw, wire.Header(1, trailer=32), strict=True)
    assert [(r.kind, r.name) for r in c.records] == [(r.kind, r.name) for r in records]
    assert c.items() == [("d", 1), ("d\x1ff", 2)] and c.block_items() == [(3, 0, 64), (3, 100, 80)]
    assert c.dictionary == b"dict" and c.attrs == {1: b"\x81"} and c.records[2].block_size == 100


def test_trailer_refuses_damage():
    raw = make([wire.Record("file", "f", {0: b"v"}, "zstd", None, 10, 20, 32)], [("k", "string")], {}, {"f": 1})
    for k in range(len(raw) - 9):  # a missing block index is allowed
        with pytest.raises(ParseError):
            wire.decode_trailer(raw[:k], wire.Header(1))
    rng = random.Random(3)
    for _ in range(2000):
        bad = bytearray(raw)
        bad[rng.randrange(len(bad))] = rng.randrange(256)
        try:
            wire.decode_trailer(bytes(bad), wire.Header(1)).items()
        except (ArchiveError, UnicodeDecodeError):
            pass


def test_a_prefix_is_reached_edge_by_edge(monkeypatch):
    rows = sorted((bytes([a, b, c]), a) for a in range(40) for b in range(40) for c in range(3))
    index = pindex.Index(pindex.build(rows))
    read, node = [], pindex.Index._node
    monkeypatch.setattr(pindex.Index, "_node", lambda self, number: read.append(number) or node(self, number))
    for start in (b"\x05\x07", b"\x05\x07\x01"):
        read.clear()
        assert list(index.prefix(start)) == [x for x in rows if x[0].startswith(start)]
        assert len(read) <= 4  # the node itself and those below it, none above
    assert list(index.prefix(b"\x05\x07\x01\x00")) == list(index.prefix(b"\x50")) == []


class Counted(bytes):
    """Bytes that count how many of them slices copy."""

    copied = 0

    def __getitem__(self, k):
        out = super().__getitem__(k)
        if isinstance(k, slice):
            type(self).copied += len(out)
        return out


@pytest.mark.parametrize("name", ["n", "n" * 200])
def test_short_attribute_maps_copy_nothing_before_them(name):
    records = [wire.Record("file", f"{name}{k}", {}, "stored", None, 1, 1, 32 + k) for k in range(500)]
    raw = Counted(make(records))
    Counted.copied = 0
    c = wire.decode_trailer(raw, wire.Header(1, trailer=32))
    assert [r.name for r in c.records] == [r.name for r in records]
    assert Counted.copied < 8 * len(raw)


def test_a_catalog_holds_no_records():
    records = [wire.Record("file", f"f{k}", {0: b"v" * 40, 1: b""}, "stored", None, 1, 1, 32 + k) for k in range(5000)]
    raw = make(records, [("k", "bytes"), ("e", "bytes")])
    tracemalloc.start()
    try:
        c = wire.decode_trailer(raw, wire.Header(1, trailer=32))
        held = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert held < len(raw) / 2 and len(c.records) == 5000
    assert [(r.name, r.attrs, r.data) for r in c.records] == [(r.name, r.attrs, r.data) for r in records]
    assert c.records.between(40, 50) == [k + 1 for k in range(5000) if 40 <= 32 + k < 50]


def test_attribute_map_sizes():
    body = vint.encode_vu64(1) + vint.encode_vu64(0) + vint.encode_vu64(2) + b"hi"
    for extra, fine in ((0, True), (8, True), (3, False)):
        raw = (len(body) + extra).to_bytes(8, "little") + body + b"\0" * 8
        if fine:
            assert wire.Reader(raw).attrs() == {0: b"hi"}
        else:
            with pytest.raises(ParseError):
                wire.Reader(raw).attrs()


def test_version_0():
    def text(s):
        return vint.encode_vu64(len(s)) + s

    none = (1).to_bytes(8, "little") + vint.encode_vu64(0)
    raw = vint.encode_vu64(1) + b"\x81" + vint.encode_vu64(2)
    raw += b"\x01" + text(b"d") + vint.encode_vu64(1) + b"\x82" + none
    raw += b"\x00" + b"\x10" + struct.pack("<QQQ", 5, 6, 32) + text(b"f") + none
    raw += vint.encode_vu64(1) + text(b"key") + none
    c = wire.decode_trailer(raw, wire.Header(0))
    assert c.items() == [("d", 1), ("d\x1ff", 2)] and c.keys == [("key", "json")] and c.records[1].compression == "zstd"
    c.records[0].entries = [1]
    with pytest.raises(ParseError):
        c.items()


def test_numbers_need_all_bytes():
    assert wire.decode_number("vu32", vint.encode_vu64(2**32 - 1)) == 2**32 - 1
    assert wire.decode_number("vu32", vint.encode_vu64(2**32)) is None
    assert wire.decode_number("datetime", vint.encode_vi64(-5)) == -5
    assert wire.decode_number("vi64", b"\x81\x81") is None and wire.decode_number("u8", b"ab") is None


def test_paths():
    assert normalize("/a/./b/../c/") == "a\x1fc"
    assert normalize("é") == "é"
    assert normalize("x\\x2dy", escapes=True) == "x\\x2dy"
    for bad in ("", "..", "a\\b", "a\x01", "a b"):
        with pytest.raises(PathError):
            normalize(bad)
    check_extractable("a\x1fb c")
    for bad in ("", "a\x1f\x1fb", "..", "a/b", "C:x", "\x1fa"):
        with pytest.raises(PathError):
            check_extractable(bad)


@pytest.mark.parametrize("size", [16, None])
def test_large_indexes_are_built_and_read_in_portions(monkeypatch, size):
    """In any portions the same bytes, and the same rows as by the walk from node to node."""
    import random

    from stowage.sources import pindex

    draw = random.Random(5)
    keys = sorted({bytes(draw.choice(b"\x00ab\xff") for _ in range(size or draw.randint(1, 40))) for _ in range(500)} | {bytes([k]) * 16 for k in range(256)})
    rows = [(k, draw.choice([0, 127, 128, 2**40, 2**64 - 1])) for k in keys]
    whole = pindex.build(rows)
    for portion in (1, 7, 1 << 18):
        monkeypatch.setattr(pindex, "PORTION", portion)
        assert pindex.build(rows) == whole
        index = pindex.Index(whole)
        found, values = index.of_length(16)
        assert [(k.tobytes(), v) for k, v in zip(found, values.tolist(), strict=True)] == [(k, v) for k, v in index.items() if len(k) == 16]
    assert list(index.items()) == rows


def test_damaged_blocks_are_an_error():
    import struct

    from stowage.sources import pindex
    from stowage.sources.errors import ParseError

    raw = pindex.build([(struct.pack(">QQ", 1, k * 512), k) for k in range(100)])
    with pytest.raises(ParseError):
        pindex.Index(raw[:-2]).of_length(16)
