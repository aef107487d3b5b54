"""Removal of byte strings that an earlier document holds, by refined q-gram buckets.

A byte is removed if a string of ``LENGTH`` bytes covering it also starts in a
document of lesser id, judged on the input.  Sorting every suffix would move
many times the input, so only strings that can repeat are sorted:

1. Each string of LENGTH bytes has one anchor, the q-gram in it of least hash
   (leftmost on ties).  Equal strings have equal anchors at equal places.
   Anchors (one in about 15 positions) are dealt by q-gram; a q-gram found in
   one text only rules out all strings of its anchor.
2. For the anchors left, the bytes around each (all strings it anchors lie in
   80 bytes) are dealt by q-gram again, each distinct piece once for a part
   of the texts.
3. Bucket-pointer refinement sorts them.  Equal strings have their anchor, and
   so their start, at the same place of their pieces; a place's strings are
   bucketed by their first 8 bytes, then each bucket is refined by the bucket
   identifiers 8, 16 and 18 bytes on, each time reusing the identifiers just
   made, for 16, 32 and LENGTH bytes.  Positions alone in a bucket are left out
   of later steps, and a place's identifiers are dropped once no start needs
   them.  The least document of a final bucket decides for all its members.
4. What is covered goes back to the texts as one 64-bit mask an anchor.

Equal texts are dealt by a content hash, so all copies meet in one place with
the text sent once for a batch; copies of an earlier document are removed
whole.  What repeats inside a batch or a part is settled there, so a passage
that a third of all documents share crosses a shuffle once for each batch or
part, not once for each document.  Rows of a shuffle are compressed blocks of
many entries.

Edge cases: null texts are empty; texts under LENGTH bytes keep everything;
a null id is neither earlier nor later than another, so such rows keep
everything; rows of equal id don't remove each other; very long texts are cut
whole, as others; other columns, whatever their names, are ignored; an empty
table gives an empty result; matches never cross documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .common import read
from .kernels import blocks, gram_hashes, mix, span_hashes, text_bytes
from .packing import Deal, pack, planes, release, unpack, unplaned

LENGTH, Q = 50, 20
REACH = LENGTH - Q  # strings of an anchor start at most this far before it
AROUND = LENGTH + REACH

_U = np.uint64
_BLOCK = "kind int, part int, body binary"


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per anchor: its place, the first and last start of its strings, its q-gram's hash, its text's number."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none, none.astype(_U), none
    h = gram_hashes(data, Q)
    least = ((h >> _U(32)) << _U(32)) | np.arange(len(h), dtype=_U)
    width, span = REACH + 1, 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        rest = width - span
        least = np.minimum(least[:-rest], least[rest:])
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    start = np.flatnonzero(np.arange(len(least)) + LENGTH <= offsets[1:][text[: len(least)]])
    if not len(start):
        return none, none, none, none.astype(_U), none
    place = (least[start] & _U(0xFFFFFFFF)).astype(np.int64)
    new = np.empty(len(place), bool)
    new[0] = True
    np.not_equal(place[1:], place[:-1], out=new[1:])
    at = np.flatnonzero(new)
    ends = np.append(at[1:], len(place)) - 1
    place = place[at]
    return place, start[at], start[ends], h[place], text[place]


def content_ids(texts: list[bytes]) -> np.ndarray:
    """Two 64-bit words a text: the first tells its part, 56 bits of the second name it there."""
    return np.frombuffer(b"".join(hashlib.blake2b(t, digest_size=16).digest() for t in texts), _U).reshape(-1, 2)


def _name(content: np.ndarray) -> np.ndarray:
    return content[:, 1] >> _U(8)


#: Bytes of text worked on together before a shuffle, and pieces (of whole q-grams) sorted together after one.
PORTION, PIECES = 8 << 20, 8192


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most PORTION bytes (or one text)."""
    for b in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy().astype(np.int64))
        at = 0
        while at < b.num_rows:
            stop = int(np.searchsorted(size, (size[at - 1] if at else 0) + PORTION, "right"))
            stop = max(stop, at + 1)
            yield b.slice(at, stop - at)
            at = stop


def _distinct(batch: pa.RecordBatch) -> tuple[list[bytes], list[list]]:
    """The batch's distinct texts and the ids of each."""
    found: dict[bytes, list] = {}
    for i, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
        found.setdefault(t or b"", []).append(i)
    return list(found), list(found.values())


def _deal(part: np.ndarray, kind: int, columns: list[np.ndarray], encode) -> list[dict]:
    """The entries of each part as one row, their columns encoded."""
    if not len(part):
        return []
    order = np.argsort(part, kind="stable")
    part, columns = part[order], [c[order] for c in columns]
    cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    return [{"kind": kind, "part": int(part[a]), "body": encode(*(c[a:b] for c in columns))} for a, b in zip(cut, np.append(cut[1:], len(part)), strict=True)]


_BLOCK_SCHEMA = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("body", pa.binary())])


def _rows(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, _BLOCK_SCHEMA)


def _tabled(f, schema: pa.Schema):
    """f over batches as the function of tables that a cogroup takes."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(f(key, left.to_batches(), right.to_batches())), schema)

    return run


def _anchor_block(text, place, gram, shared, part_of_text, name) -> bytes:
    """Anchors in order of their q-gram: 32 bits of it (besides what the bucket tells) as steps, the texts as a table."""
    table, number = np.unique(text, return_inverse=True)
    step = np.diff(gram >> _U(32), prepend=_U(0))
    return pack(planes(part_of_text[table], 4), planes(name[table], 7), planes(number, 4), planes(place, 4), planes(step, 4), np.packbits(shared))


def _send_anchors(deal: Deal):
    """Kind 0: anchors by q-gram, each q-gram once for a portion. Kind 1: the others of q-grams that repeat in it, by content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _portions(batches):
            texts, ids = _distinct(b)
            texts = [t for t, i in zip(texts, ids, strict=True) if len(t) >= LENGTH and any(x is not None for x in i)]
            if not texts:
                continue
            content = content_ids(texts)
            dealt, name = deal.by_part(content[:, 0]), _name(content)
            data, offsets = text_bytes(pa.array(texts, pa.large_binary()))
            got = []
            for first, part, at in blocks(data, offsets):
                place, _, _, gram, text = anchors(part, at)
                got.append((gram, text + first, (place - at[text]).astype(np.int32)))
            gram, text, place = (np.concatenate(x) for x in zip(*got, strict=True))
            order = np.argsort(gram, kind="stable")
            gram, text, place = gram[order], text[order], place[order]
            new = np.r_[True, gram[1:] != gram[:-1]]
            edge = np.flatnonzero(new)
            last = np.append(edge[1:], len(gram)) - 1
            shared = (text[edge] != text[last])[np.cumsum(new) - 1]  # texts ascend inside a run
            send = new | ~shared
            k = np.flatnonzero(send)
            rows = _deal(deal.by_kind(gram[k]), 0, [text[k], place[k], gram[k], shared[k]], lambda *c: _anchor_block(*c, dealt, name))  # noqa: B023
            k = np.flatnonzero(~send)
            rows += _deal(dealt[text[k]], 1, [name[text[k]], place[k]], lambda n, p: pack(planes(n, 7), planes(p, 4)))
            yield _rows(rows)
        release()

    return run


def _shared_anchors():
    """Of a q-gram bucket, the anchors of q-grams in more than one text, by content."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key[0].as_py() == 1:
            for b in batches:
                yield b.select(["kind", "part", "body"])
            return
        tables, number, place, gram, flag, shift = [], [], [], [], [], 0
        for b in batches:
            for body in b.column("body").to_pylist():
                part, name, k, p, step, bits = unpack(body)
                tables.append((unplaned(part), unplaned(name)))
                number.append(unplaned(k).astype(np.int64) + shift)
                shift += part.shape[1]
                place.append(unplaned(p).astype(np.int32))
                gram.append(np.cumsum(unplaned(step), dtype=_U).astype(np.uint32))
                flag.append(np.unpackbits(bits, count=k.shape[1]).astype(bool))
        number, place, gram, flag = (np.concatenate(x) for x in (number, place, gram, flag))
        part, name = (np.concatenate(x) for x in zip(*tables, strict=True))
        # one number for each content
        order = np.lexsort((name, part))
        fresh = np.r_[True, (name[order][1:] != name[order][:-1]) | (part[order][1:] != part[order][:-1])]
        content = np.empty(len(order), np.int32)
        content[order] = np.cumsum(fresh) - 1
        owner = content[number]
        order = np.argsort(gram, kind="stable")
        edge = np.flatnonzero(np.r_[True, gram[order][1:] != gram[order][:-1]])
        shared = (np.minimum.reduceat(owner[order], edge) < np.maximum.reduceat(owner[order], edge)) | np.logical_or.reduceat(flag[order], edge)
        keep = order[np.repeat(shared, np.diff(np.append(edge, len(order))))]
        number = number[keep]
        yield _rows(_deal(part[number].astype(np.int32), 1, [name[number], place[keep]], lambda n, p: pack(planes(n, 7), planes(p, 4))))
        release()

    return run


def _send_texts(deal: Deal):
    """Each distinct text of a batch once, with its ids, by content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _portions(batches):
            texts, ids = _distinct(b)
            content = content_ids(texts)
            dealt = deal.by_part(content[:, 0])
            rows = []
            for p in np.unique(dealt):
                k = np.flatnonzero(dealt == p).tolist()
                rows.append({"kind": 1, "part": int(p), "body": pack(content[k], [texts[i] for i in k], [ids[i] for i in k])})
            yield _rows(rows)
        release()

    return run


def _contents(batches: list[pa.RecordBatch]) -> list[tuple[np.ndarray, tuple[bytes, list]]]:
    """Content id, (text, all ids) of a part's contents, in order of content id: a content's place there is its number."""
    found: dict[bytes, tuple[bytes, list]] = {}
    for b in batches:
        for body in b.column("body").to_pylist():
            content, texts, ids = unpack(body)
            for c, t, i in zip(content, texts, ids, strict=True):
                if (old := found.get(c.tobytes())) is not None:
                    old[1].extend(i)
                else:
                    found[c.tobytes()] = (t, list(i))
    return [(np.frombuffer(k, _U), found[k]) for k in sorted(found)]


def _first(ids: list) -> int | None:
    return min((i for i in ids if i is not None), default=None)


def _grouped(batches: list[pa.RecordBatch], decode) -> dict[int, list[np.ndarray]]:
    """First column's value to its entries of the other columns."""
    got = [decode(*unpack(body)) for b in batches for body in b.column("body").to_pylist()]
    if not got:
        return {}
    key, *columns = (np.concatenate(c) for c in zip(*got, strict=True))
    table, number = np.unique(key, return_inverse=True)
    order = np.argsort(number, kind="stable")
    at = np.searchsorted(number[order], np.arange(len(table) + 1))
    columns = [c[order] for c in columns]
    return {int(k): [c[at[i] : at[i + 1]] for c in columns] for i, k in enumerate(table)}


def _mask_block(number, place, a, mask) -> bytes:
    return pack(planes(number, 4), planes(place, 4), a, mask)


def _send_pieces(deal: Deal):
    """Kind 0: the bytes around shared anchors, each distinct piece once, by q-gram. Kind 1: masks of pieces that an earlier text of this part holds."""

    def run(key: tuple, left: Iterator[pa.RecordBatch], right: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = _grouped(list(right), lambda n, p: (unplaned(n), unplaned(p).astype(np.int64)))
        if not marked:
            return
        here = key[0].as_py()
        chosen = [(k, marked[name], text, ids) for k, (c, (text, ids)) in enumerate(_contents(list(left))) if (name := int(c[1] >> _U(8))) in marked]
        number = np.array([c[0] for c in chosen], np.int64)
        doc = np.array([_first(c[3]) for c in chosen], np.int64)
        data, offsets = text_bytes(pa.array([c[2] for c in chosen], pa.large_binary()))
        out: list[list[np.ndarray]] = []
        for first, part, at in blocks(data, offsets):
            place, lo, hi, gram, text = anchors(part, at)
            wanted = np.concatenate([chosen[first + i][1][0] + at[i] for i in range(len(at) - 1)])
            keep = np.isin(place, wanted)
            place, lo, hi, gram, text = (x[keep] for x in (place, lo, hi, gram, text))
            if not len(place):
                continue
            padded = np.concatenate([np.zeros(REACH, np.uint8), part, np.zeros(LENGTH, np.uint8)])
            piece = np.lib.stride_tricks.sliding_window_view(padded, AROUND)[place]
            col = np.arange(AROUND)
            a, e = lo - place + REACH, hi + LENGTH - place + REACH
            piece = np.where((col >= a[:, None]) & (col < e[:, None]), piece, 0).astype(np.uint8)
            same = mix(span_hashes(part, lo, hi + LENGTH) ^ mix(a.astype(_U) * _U(128) + (hi - lo).astype(_U)))
            out.append([gram, same, doc[text + first], number[text + first], (place - at[text]).astype(np.int32), a.astype(np.uint8), (hi - lo + 1).astype(np.uint8), piece])
        if not out:
            return
        gram, same, owner, text, place, a, n, piece = (np.concatenate(x) for x in zip(*out, strict=True))
        del out, data
        order = np.lexsort((owner, same))
        new = np.r_[True, same[order][1:] != same[order][:-1]]
        least = owner[order][np.flatnonzero(new)][np.cumsum(new) - 1]
        later = np.zeros(len(order), bool)
        later[order] = owner[order] > least
        rows = []
        k = np.flatnonzero(later)
        if len(k):
            rows.append({"kind": 1, "part": here, "body": _mask_block(text[k], place[k], a[k], _full(n[k]))})
        k = np.flatnonzero(~later)
        k = k[np.lexsort((same[k], gram[k]))]
        rows += _deal(deal.by_kind(gram[k]), 0, [text[k], place[k], owner[k], a[k], n[k], piece[k]], lambda t, p, o, a, n, x: pack(here, planes(t, 4), planes(p, 4), planes(o, 8), a, n, x))
        yield _rows(rows)
        release()

    return run


def _full(n: np.ndarray) -> np.ndarray:
    """The lowest n bits set."""
    return (_U(1) << n.astype(_U)) - _U(1)


class Refined:
    """Bucket identifiers of strings in pieces of AROUND bytes, place by place, by bucket-pointer refinement.

    Of one place and length, equal strings, and only those, have equal
    identifiers.  Places must be asked for in ascending order.
    """

    #: A length's identifiers come from those of the half (or nearest) length, this far apart.
    STEPS = {16: (8, 8), 32: (16, 16), LENGTH: (32, LENGTH - 32)}

    def __init__(self, piece: np.ndarray):
        self.piece = piece
        self.known: dict[tuple[int, int], np.ndarray] = {}

    def at(self, place: int, length: int = LENGTH) -> np.ndarray:
        out = self._bucket(place, length)
        for k in [k for k in self.known if k[0] <= place]:
            del self.known[k]
        return out

    def _bucket(self, place: int, length: int) -> np.ndarray:
        if (out := self.known.get((place, length))) is not None:
            return out
        if length == 8:
            words = np.ascontiguousarray(self.piece[:, place : place + 8]).view(_U).reshape(-1)
            out = np.unique(words, return_inverse=True)[1].astype(np.int32)
        else:
            half, step = self.STEPS[length]
            bucket = self._bucket(place, half)
            # a position alone in its bucket is told apart already
            live = np.flatnonzero(np.bincount(bucket)[bucket] > 1)
            pointer = self._bucket(place + step, half)[live]
            _, finer = np.unique((bucket[live].astype(_U) << _U(32)) | pointer.astype(_U), return_inverse=True)
            out = np.arange(len(bucket), dtype=np.int32)
            out[live] = len(bucket) + finer
            out = np.unique(out, return_inverse=True)[1].astype(np.int32)
        self.known[place, length] = out
        return out


def _share(which, edge, n, a, piece, least, kind, owner, mask) -> None:
    """Adds to the masks of the entries of distinct pieces ``which`` what they share with each other."""
    rows = edge[which]
    first, count = a[rows].astype(np.int64), n[rows].astype(np.int64)
    refined = Refined(piece[rows])
    lo, hi = int(edge[which[0]]), int(edge[which[-1] + 1]) if which[-1] + 1 < len(edge) else len(kind)
    for start in range(REACH + 1):
        bucket = refined.at(start)
        there = (first <= start) & (start < first + count)
        if not there.any():
            continue
        # entries compare their document with the least of each string; those that are covered whole are settled
        lowest = np.full(int(bucket.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(lowest, bucket[there], least[which][there])
        entry = lo + np.flatnonzero(mask[lo:hi] != _full(n[lo:hi]))
        back = np.minimum(np.searchsorted(which, kind[entry]), len(which) - 1)
        real = (which[back] == kind[entry]) & there[back]
        entry, back = entry[real], back[real]
        hit = entry[lowest[bucket[back]] < owner[entry]]
        mask[hit] |= _U(1) << (start - a[hit].astype(np.int64)).astype(_U)


def _settle():
    """Masks of the strings of each piece that an earlier text holds too, by content."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key[0].as_py() == 1:
            for b in batches:
                yield b.select(["kind", "part", "body"])
            return
        got = [unpack(body) for b in batches for body in b.column("body").to_pylist()]
        part = np.concatenate([np.full(g[4].shape, g[0], np.int32) for g in got])
        text, place = (np.concatenate([unplaned(g[k]) for g in got]).astype(np.int64) for k in (1, 2))
        owner = np.concatenate([unplaned(g[3]).view(np.int64) for g in got])
        a, n, piece = (np.concatenate([g[k] for g in got]) for k in (4, 5, 6))
        del got
        # the q-gram's hash, and the piece's, from its bytes
        flat, row = piece.reshape(-1), np.arange(len(piece)) * AROUND
        gram = np.empty(len(piece), _U)
        same = np.empty(len(piece), _U)
        for lo in range(0, len(piece), PIECES):
            k = slice(lo, lo + PIECES)
            block = flat[row[k][0] : row[k][-1] + AROUND]
            at = row[k] - row[k][0]
            gram[k] = span_hashes(block, at + REACH, at + REACH + Q)
            same[k] = mix(span_hashes(block, at + a[k], at + a[k] + n[k] - 1 + LENGTH) ^ mix(a[k].astype(_U) * _U(128) + (n[k].astype(_U) - _U(1))))
        order = np.lexsort((owner, same, gram))
        part, text, place, owner, gram, same, a, n = (x[order] for x in (part, text, place, owner, gram, same, a, n))
        piece = piece[order]
        new = np.r_[True, (same[1:] != same[:-1]) | (gram[1:] != gram[:-1])]
        edge, kind = np.flatnonzero(new), np.cumsum(new) - 1
        least = owner[edge]  # of each distinct piece
        mask = np.where(owner > least[kind], _full(n), _U(0))
        # q-grams with several distinct pieces: which strings do these share?
        grams = gram[edge]
        several = np.zeros(len(edge), bool)
        if len(edge) > 1:
            eq = grams[1:] == grams[:-1]
            several[1:] |= eq
            several[:-1] |= eq
        which = np.flatnonzero(several)
        # q-grams are independent of each other: sort a bounded number of pieces at a time, whole q-grams always
        heads = np.flatnonzero(np.r_[True, grams[which][1:] != grams[which][:-1]]) if len(which) else which
        at = 0
        while at < len(which):
            nxt = int(np.searchsorted(heads, at + PIECES, "right")) - 1
            stop = int(heads[nxt]) if nxt >= 0 and heads[nxt] > at else (int(heads[nxt + 1]) if nxt + 1 < len(heads) else len(which))
            if len(which) - at <= PIECES:
                stop = len(which)
            _share(which[at:stop], edge, n, a, piece, least, kind, owner, mask)
            at = stop
        keep = mask > 0
        yield _rows(_deal(part[keep], 1, [text[keep], place[keep], a[keep], mask[keep]], _mask_block))
        release()

    return run


_RESULT = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))]
)
_RESULT_DDL = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,stop:long>>"


def _cut(key: tuple, left: Iterator[pa.RecordBatch], right: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each row of the input."""
    marked = _grouped(list(right), lambda t, p, a, m: (unplaned(t), unplaned(p).astype(np.int64), a, m))
    rows = []

    def row(i, n: int, spans: list[tuple[int, int]], digest: str) -> dict:
        return {"doc_id": i, "n_bytes": n, "n_removed": sum(b - a for a, b in spans), "n_spans": len(spans), "kept_sha256": digest, "spans": [{"start": a, "stop": b} for a, b in spans]}

    nothing = hashlib.sha256(b"").hexdigest()
    for k, (_, (text, ids)) in enumerate(_contents(list(left))):
        first, spans, digest = _first(ids), [], hashlib.sha256(text).hexdigest()
        kept = digest
        if k in marked:
            place, a, mask = marked[k]
            hit = ((mask[:, None] >> np.arange(REACH + 1, dtype=_U)) & _U(1)).astype(bool)
            base = place - REACH + a.astype(np.int64)
            starts = np.sort((base[:, None] + np.arange(REACH + 1))[hit])
            edge = np.flatnonzero(np.r_[True, starts[1:] - starts[:-1] > LENGTH])
            spans = [(int(starts[x]), int(starts[y]) + LENGTH) for x, y in zip(edge, np.append(edge[1:], len(starts)) - 1, strict=True)]
            left_over, at = hashlib.sha256(), 0
            for x, y in spans:
                left_over.update(text[at:x])
                at = y
            left_over.update(text[at:])
            kept = left_over.hexdigest()
        for i in ids:
            if i is None:
                rows.append(row(i, len(text), [], digest))
            elif i > first and len(text) >= LENGTH:
                rows.append(row(i, len(text), [(0, len(text))], nothing))
            else:
                rows.append(row(i, len(text), spans, kept))
            if len(rows) >= 4096:
                yield pa.RecordBatch.from_pylist(rows, _RESULT)
                rows = []
    if rows:
        yield pa.RecordBatch.from_pylist(rows, _RESULT)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed spans of each row."""
    deal = Deal(max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    source = docs.selectExpr(f"CAST(`{id_col}` AS LONG) AS doc_id", f"`{text_col}` AS text")
    flagged = source.mapInArrow(_send_anchors(deal), _BLOCK).groupBy("kind", "part").applyInArrow(_shared_anchors(), _BLOCK)
    texts = source.mapInArrow(_send_texts(deal), _BLOCK)
    pieces = texts.groupBy("part").cogroup(flagged.groupBy("part")).applyInArrow(_tabled(_send_pieces(deal), _BLOCK_SCHEMA), _BLOCK)
    masks = pieces.groupBy("kind", "part").applyInArrow(_settle(), _BLOCK)
    return texts.groupBy("part").cogroup(masks.groupBy("part")).applyInArrow(_tabled(_cut, _RESULT), _RESULT_DDL)


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(read(spark, sf_dir, "documents")).drop("spans")


ORACLE = """
WITH raw AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents),
strings AS (SELECT doc_id, s, substr(h, 2 * s + 1, 100) AS w FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS s FROM raw WHERE n >= 50)),
firsts AS (SELECT w, min(doc_id) AS m FROM strings GROUP BY w HAVING count(DISTINCT doc_id) > 1),
hits AS (SELECT doc_id, s FROM strings JOIN firsts USING (w) WHERE m < doc_id),
marks AS (SELECT doc_id, s, CASE WHEN s > lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 50 OR lag(s) OVER (PARTITION BY doc_id ORDER BY s) IS NULL THEN 1 ELSE 0 END AS new FROM hits),
runs AS (SELECT doc_id, min(s) AS a, max(s) + 50 AS b FROM (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS k FROM marks) GROUP BY doc_id, k),
gaps AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS from_byte FROM runs),
cut AS (
  SELECT g.doc_id, sum(b - a) AS removed, count(*) AS spans,
         string_agg(substr(h, 2 * from_byte + 1, 2 * (a - from_byte)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept
  FROM gaps g JOIN raw r ON g.doc_id = r.doc_id GROUP BY g.doc_id)
SELECT doc_id, n AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM raw LEFT JOIN cut USING (doc_id)
"""
