"""Texts as grey images: Netpbm and BMP, area-resized tiles and difference hashes.

A text's UTF-8 bytes, padded with 255 to a positive multiple of 576, are the
samples of a grey image 24 wide, stored as binary Netpbm (P5) or as an 8-bit
BMP.  The stored bytes are parsed again to a numpy array; features come from
that array alone.  An integral image (running sums over rows and columns)
gives the exact mean over any rectangle, also with fractional edges, so a tile
of any size is area-resized from it; a 9 x 8 tile's left-to-right comparisons
are the 64-bit difference hash.  Tiles are kept in NPY format.

Only the rows of the integral image that edges need are kept, so memory
follows the stored image and the tile.

Edge cases: null and empty texts are one block of 576 bytes of 255; null ids
and repeated rows are rows of their own; equal texts give equal values; a very
long text is one image of as many rows, its image held once a text; other
columns, whatever their names, are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import CRC_TABLE, crc_sql, read

UNIT, WIDTH, PAD = 576, 24, 255
TILE = (9, 8)


def payload(data: bytes) -> bytes:
    """data padded to a positive multiple of UNIT."""
    return data + bytes([PAD]) * ((-len(data)) % UNIT if data else UNIT)


def write_pgm(samples: np.ndarray) -> bytes:
    """Binary Netpbm: P5 for height x width, P6 for height x width x 3."""
    kind = b"P6" if samples.ndim == 3 else b"P5"
    return b"%s\n%d %d\n255\n" % (kind, samples.shape[1], samples.shape[0]) + samples.tobytes()


_PNM = re.compile(rb"P([1-6])" + rb"(?:\s+(?:#[^\n]*\n\s*)*)(\d+)" * 2)


def read_pnm(stored: bytes) -> np.ndarray:
    """Netpbm P1 to P6 with 8-bit samples; bitmaps give 0 (black) and 255."""
    head = _PNM.match(stored)
    if not head:
        raise ValueError("not a Netpbm image")
    kind, width, height = (int(x) for x in head.groups())
    at, top = head.end(), 1
    if kind not in (1, 4):
        more = re.compile(rb"(?:\s+(?:#[^\n]*\n\s*)*)(\d+)").match(stored, at)
        if not more:
            raise ValueError("Netpbm header without a largest value")
        top, at = int(more[1]), more.end()
        if not 0 < top < 256:
            raise ValueError("only 8-bit Netpbm samples are read")
    depth = 3 if kind in (3, 6) else 1
    n = width * height * depth
    if kind == 4:
        row = -(-width // 8)
        bits = np.frombuffer(stored, np.uint8, row * height, at + 1).reshape(height, row)
        return (1 - np.unpackbits(bits, axis=1)[:, :width]) * np.uint8(255)
    if kind == 1:
        digits = re.sub(rb"[^01]", b"", re.sub(rb"#[^\n]*", b"", stored[at:]))
        out = (1 - (np.frombuffer(digits, np.uint8, n) - 48)) * np.uint8(255)
    elif kind in (2, 3):
        out = np.array(re.sub(rb"#[^\n]*", b"", stored[at:]).split()[:n], dtype=np.uint8)
    else:
        out = np.frombuffer(stored, np.uint8, n, at + 1)
    if top != 255 and kind != 1:
        out = (out.astype(np.uint16) * 255 // top).astype(np.uint8)
    return out.reshape((height, width, 3) if depth == 3 else (height, width))


def write_bmp(samples: np.ndarray) -> bytes:
    """An 8-bit grey BMP with a palette, rows from the bottom, each padded to 4 bytes."""
    height, width = samples.shape
    row = -(-width // 4) * 4
    body = np.zeros((height, row), np.uint8)
    body[:, :width] = samples[::-1]
    start = 54 + 1024
    head = struct.pack("<2sIHHI", b"BM", start + body.size, 0, 0, start)
    info = struct.pack("<IiiHHIIiiII", 40, width, height, 1, 8, 0, body.size, 2835, 2835, 256, 0)
    grey = np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(256, 4).copy()
    grey[:, 3] = 0
    return head + info + grey.tobytes() + body.tobytes()


def read_bmp(stored: bytes) -> np.ndarray:
    """Uncompressed BMP of 8 bits with a palette (grey or colour) or 24 bits."""
    if stored[:2] != b"BM":
        raise ValueError("not a BMP image")
    start, size, width, height, _, depth, packed = struct.unpack_from("<IIiiHHI", stored, 10)
    if packed or depth not in (8, 24) or width <= 0 or not height:
        raise ValueError("only uncompressed BMP of 8 or 24 bits is read")
    row, rows = -(-width * depth // 32) * 4, abs(height)
    body = np.frombuffer(stored, np.uint8, row * rows, start).reshape(rows, row)
    body = body[::-1] if height > 0 else body
    if depth == 24:
        return body[:, : width * 3].reshape(rows, width, 3)[:, :, ::-1]
    used = struct.unpack_from("<I", stored, 46)[0] or 256
    palette = np.frombuffer(stored, np.uint8, used * 4, 14 + size).reshape(-1, 4)[:, 2::-1]
    out = palette[body[:, :width]]
    return out[:, :, 0] if (palette[:, :1] == palette).all() else out


def decode(stored: bytes) -> np.ndarray:
    return read_bmp(stored) if stored[:2] == b"BM" else read_pnm(stored)


def grey(image: np.ndarray) -> np.ndarray:
    """Luma of a colour image (weights 77, 150 and 29 of 256)."""
    if image.ndim == 2:
        return image
    return ((image.astype(np.uint32) @ np.array([77, 150, 29], np.uint32)) >> 8).astype(np.uint8)


def area_resize(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """The mean over each of width x height equal rectangles, rounded half up.

    The integral image holds sums from the corner; at fractional edges it is
    interpolated, which is exact as samples are constant inside a pixel.  Only
    its rows next to an edge are kept.  All sums are whole numbers in units of
    1 / (width * height) pixels.
    """
    h, w = image.shape

    def edges(n: int, cells: int) -> tuple[np.ndarray, np.ndarray]:
        x = np.arange(cells + 1) * n
        at = np.minimum(x // cells, n - 1)
        return at, x - at * cells

    y, fy = edges(h, height)
    x, fx = edges(w, width)
    needed, integral, done = np.unique(np.concatenate([y, y + 1])), [], 0
    run = np.zeros(w, np.int64)
    for k in needed.tolist():
        run = run + image[done:k].sum(axis=0, dtype=np.int64)
        integral.append(np.concatenate([[0], np.cumsum(run)]))
        done = k
    integral = np.array(integral)
    row = lambda k: integral[np.searchsorted(needed, k)]
    rows = row(y) * (height - fy)[:, None] + row(y + 1) * fy[:, None]
    sums = rows[:, x] * (width - fx) + rows[:, x + 1] * fx
    cells = sums[1:, 1:] - sums[:-1, 1:] - sums[1:, :-1] + sums[:-1, :-1]
    area = h * w
    return np.ascontiguousarray((2 * cells + area) // (2 * area), np.uint8)


def difference_hash(tile: np.ndarray) -> str:
    """16 hex digits: whether each sample of a 9 x 8 tile is over its left neighbour."""
    return np.packbits(tile[:, 1:] > tile[:, :-1]).tobytes().hex()


def npy(tile: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, tile, allow_pickle=False)
    return out.getvalue()


def encode(data: bytes, form: str = "pgm") -> bytes:
    samples = np.frombuffer(payload(data), np.uint8).reshape(-1, WIDTH)
    return write_pgm(samples) if form == "pgm" else write_bmp(samples)


def store(docs: DataFrame, form: str = "pgm", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each text as a stored image."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                texts = [t or b"" for t in part.column(1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([encode(t, form) for t in texts], pa.binary())], names=["doc_id", "n_bytes", "media"]
                )

    return docs.selectExpr(f"CAST(`{id_col}` AS LONG) AS doc_id", f"`{text_col}` AS text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def features(media: DataFrame) -> DataFrame:
    """What the stored bytes give when read back: digests, the tile as NPY, its difference hash."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "height", "width", "tile"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.binary()]
    schema = pa.schema(list(zip(names, kinds, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, n, stored in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                image = decode(stored)
                samples = image.tobytes()
                tile = area_resize(grey(image), *TILE)
                rows.append(
                    (i, n, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), difference_hash(tile), *image.shape[:2], npy(tile))
                )
            columns = zip(*rows, strict=True) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], schema=schema)

    ddl = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, height int, width int, tile binary"
    return media.mapInArrow(run, ddl)


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(store(read(spark, sf_dir, "documents")))


_HEAD = npy(np.zeros(TILE[::-1], np.uint8))[: -TILE[0] * TILE[1]].hex()
# the payload as hex; each of its bytes with the parts of the tile's cells it covers, in units of 1/72 of a pixel
ORACLE = f"""
WITH {CRC_TABLE},
raw AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents),
sized AS (SELECT *, CASE WHEN n = 0 THEN {UNIT} ELSE (n + {UNIT - 1}) // {UNIT} * {UNIT} END AS p FROM raw),
padded AS (SELECT doc_id, n, p, p // {WIDTH} AS rows, h || repeat('FF', CAST(p - n AS INT)) AS h FROM sized),
stored AS (SELECT *, unhex(hex(encode('P5' || chr(10) || '{WIDTH} ' || rows || chr(10) || '255' || chr(10))) || h) AS media FROM padded),
octets AS (
  SELECT doc_id, rows, i // {WIDTH} AS y, i % {WIDTH} AS x, ('0x' || substr(h, 2 * i + 1, 2))::BIGINT AS v FROM (SELECT doc_id, rows, h, unnest(range(0, p)) AS i FROM padded)),
sums AS (
  SELECT doc_id, rows, cy, x, sum(v * (least({TILE[1]} * y + {TILE[1]}, (cy + 1) * rows) - greatest({TILE[1]} * y, cy * rows))) AS s
  FROM octets, range(0, {TILE[1]}) r(cy) WHERE cy * rows < {TILE[1]} * y + {TILE[1]} AND {TILE[1]} * y < (cy + 1) * rows GROUP BY ALL),
cells AS (
  SELECT doc_id, cy, cx, any_value(rows) * {WIDTH} AS area, sum(s * (least({TILE[0]} * x + {TILE[0]}, (cx + 1) * {WIDTH}) - greatest({TILE[0]} * x, cx * {WIDTH}))) AS s
  FROM sums, range(0, {TILE[0]}) r(cx) WHERE cx * {WIDTH} < {TILE[0]} * x + {TILE[0]} AND {TILE[0]} * x < (cx + 1) * {WIDTH} GROUP BY doc_id, cy, cx),
means AS (SELECT doc_id, cy, cx, CAST((2 * s + area) // (2 * area) AS BIGINT) AS m FROM cells),
signs AS (SELECT doc_id, cy, cx, m, CASE WHEN m > lag(m) OVER (PARTITION BY doc_id, cy ORDER BY cx) THEN 1 << CAST(8 - cx AS INT) ELSE 0 END AS bit FROM means),
lines AS (SELECT doc_id, cy, printf('%02x', CAST(sum(bit) AS BIGINT)) AS b, string_agg(printf('%02x', m), '' ORDER BY cx) AS t FROM signs GROUP BY doc_id, cy),
tiles AS (SELECT doc_id, string_agg(b, '' ORDER BY cy) AS feature, unhex('{_HEAD}' || string_agg(t, '' ORDER BY cy)) AS tile FROM lines GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, CAST(p AS BIGINT) AS payload_bytes, sha256(unhex(h)) AS payload_sha256,
       CAST({crc_sql("list_transform(range(0, 32), lambda i: ('0x' || substr(h, CAST(2 * (p - 32 + i) + 1 AS BIGINT), 2))::BIGINT)")} AS BIGINT) AS tail_crc32,
       CAST(octet_length(media) AS BIGINT) AS media_bytes, sha256(media) AS media_sha256, feature, CAST(rows AS INT) AS height, {WIDTH} AS width, tile
FROM stored JOIN tiles USING (doc_id), crc
"""
