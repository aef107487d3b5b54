"""Line dedup by an exact set-similarity join.

A line's tokens are its distinct words after lower-casing A-Z.  A line goes if
an earlier line, by document id and then line number, has a Jaccard similarity
of ``NEED`` % or more to it; both are judged on the input, so the order of
removals doesn't matter.  Lines without a word stay.

1. Lines of equal token sets are one class, stood for by its earliest line;
   the others go.
2. Tokens are ordered by rarity, how often they occur (hashed counters over
   all documents; any fixed order is exact).
3. Prefix filter: sets of sizes n <= m match only if one of the m - ceil(t m)
   + 1 rarest tokens of the larger is one of the n - ceil(2 t n / (1 + t)) + 1
   rarest of the smaller.  Length filter: n >= t m.  Positional filter: what is
   left after that token must reach the overlap needed.  Every set goes, as an
   entry in a block, to each of its prefix tokens that another line may have.
4. In a token's list, in order of size, entries meet those that the length
   filter allows.  Each carries 128 parity bits of its tokens; sets differ in
   at least as many tokens as they differ in parity bits, which rules most
   pairs out.  Of the rest, a later set names its nearest earlier one, so a
   group of thousands of like lines sends on a pair for each line.  Only where
   that one is so far that it may fail are the others noted, as numbers in a
   block of their part.
5. Named pairs are verified on full token sets, taken from the texts.  Sets
   without a verified one are held against what was noted for them, where it
   was noted; should a near one fail, its set is held against all documents in
   a query block.  So no candidate goes unseen.

Edge cases: a null text has no lines; an empty text is one empty line; null
ids come before all others; lines of rows of equal id stand at the same place
when their numbers are equal, and don't remove each other; very long texts
and lines are read whole; lines of equal similarity to several are removed by
any of them; other columns, whatever their names, are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, read
from .kernels import LOWER, blocks, mix, span_hashes, text_bytes, words
from .packing import Deal, pack, planes, release, unpack, unplaned
from .rarity import ADDERS, slot_counts, slot_of

NEED = 75
#: Pairs looked at together, and pairs noted before they are sifted.
SLICE, NOTED = 1 << 18, 1 << 21
#: Sets searched again at a time.
QUERY_BLOCK = 1 << 15
#: A filter of documents has two to this number of bits.
DOC_BITS = 25
NO_ID = -(2**63)

_U = np.uint64


def line_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text and number of each line, distinct tokens of all lines, offsets into them, a hash of each set (0: no word).

    Tokens of a line are in an order that depends on them alone.
    """
    filled = offsets[1:] > offsets[:-1]
    ends = np.union1d(np.flatnonzero(data == 0x0A) + 1, offsets[1:][filled])
    cut = np.concatenate([np.zeros(1, np.int64), ends])
    text = np.searchsorted(offsets, cut[:-1], "right") - 1
    number = np.arange(len(text)) - np.searchsorted(text, text)
    low = LOWER[data]
    starts, stops, _ = words(low, offsets)
    token = span_hashes(low, starts, stops)
    line = np.searchsorted(cut, starts, "right") - 1
    bits = max(20, len(text).bit_length())
    order = np.argsort((line.astype(_U) << _U(64 - bits)) | (token >> _U(bits)))
    token, line = token[order], line[order]
    keep = np.ones(len(token), bool)
    keep[1:] = (token[1:] != token[:-1]) | (line[1:] != line[:-1])
    token, line = token[keep], line[keep]
    at = np.searchsorted(line, np.arange(len(text) + 1))
    full = np.flatnonzero(at[1:] > at[:-1])
    digest = np.zeros(len(text), _U)
    if len(full):
        sums = np.bitwise_xor.reduceat(mix(token + _U(5)), at[full])
        digest[full] = mix(sums + np.add.reduceat(mix(token ^ _U(0x5555)), at[full])) | _U(1)
    return text, number, token, at, digest


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of x are in the sorted array."""
    if not len(known):
        return np.zeros(len(x), bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def _take(token: np.ndarray, at: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of the sets k, and offsets into them."""
    n = (at[1:] - at[:-1])[k]
    to = np.concatenate([np.zeros(1, np.int64), np.cumsum(n)])
    return token[np.repeat(at[:-1][k] - to[:-1], n) + np.arange(to[-1])], to


def _tokens(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """All words of the texts; a word that a line repeats counts again, which only makes a count too high."""
    data, offsets = text_bytes(batch.column(1))
    for _, part, at in blocks(data, offsets):
        low = LOWER[part]
        starts, stops, _ = words(low, at)
        yield span_hashes(low, starts, stops)


def parities(token: np.ndarray, at: np.ndarray) -> np.ndarray:
    """128 bits a set (no set is empty), each the parity of the tokens that hash to it."""
    out = np.empty((len(at) - 1, 2), _U)
    h = mix(token ^ _U(0x77))
    bit = _U(1) << (h & _U(63))
    side = (h >> _U(6)) & _U(1)
    for s in (0, 1):
        out[:, s] = np.bitwise_xor.reduceat(np.where(side == s, bit, _U(0)), at[:-1])
    return out


def overlap_needed(sizes: np.ndarray) -> np.ndarray:
    """The least overlap of two sets whose sizes sum to this."""
    return -(-NEED * sizes // (100 + NEED))


_ROW = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("body", pa.binary())])
_ROW_DDL = "kind int, part int, body binary"


def _rows(kind: int, part: np.ndarray, columns: list[np.ndarray], encode) -> pa.RecordBatch:
    """The entries of each part as one row."""
    order = np.argsort(part.astype(np.uint16) if len(part) and part.max() < 1 << 16 else part, kind="stable")  # radix for 16 bits
    part, columns = part[order], [c[order] for c in columns]
    cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(0, np.int64)
    bodies = [encode(*(c[a:e] for c in columns)) for a, e in zip(cut, np.append(cut[1:], len(part)), strict=True)] if len(cut) else []
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(cut), kind, np.int32)), pa.array(part[cut], pa.int32()), pa.array(bodies, pa.binary())], schema=_ROW)


def _entry_block(token, digest, doc, number, n, nth, parity) -> bytes:
    """Entries in order of their token, the numbers as byte planes."""
    return pack(planes(np.diff(token, prepend=_U(0)), 8), digest, planes(doc.view(_U), 8), planes(number, 4), planes(n, 4), planes(nth, 4), parity)


def _entry_columns(step, digest, doc, number, n, nth, parity) -> list[np.ndarray]:
    return [np.cumsum(unplaned(step), dtype=_U), digest, unplaned(doc).view(np.int64), *(unplaned(c).astype(np.int32) for c in (number, n, nth)), parity]


def _place_block(digest, doc, number) -> bytes:
    return pack(digest, planes(doc.view(_U), 8), planes(number, 4))


def _place_columns(digest, doc, number) -> list[np.ndarray]:
    return [digest, unplaned(doc).view(np.int64), unplaned(number).astype(np.int32)]


def _send(deal: Deal, counts):
    """Kind 0: entries of each distinct set of a batch, by prefix token. Kind 1: where every set stands, by its hash.

    An entry has token, digest, id and number of the earliest line, size,
    place of the token in order of rarity, parities.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = counts.value
        for b in batches:
            data, offsets = text_bytes(b.column(1))
            ids = b.column(0).fill_null(NO_ID).to_numpy()
            entries, places = [], []
            for first, part, at in blocks(data, offsets):
                text, number, token, to, digest = line_sets(part, at)
                k = np.flatnonzero(digest)
                if not len(k):
                    continue
                doc = ids[first + text[k]]
                places.append([digest[k], doc, number[k].astype(np.int32)])
                order = np.lexsort((number[k], doc, digest[k]))
                order = order[np.r_[True, digest[k][order][1:] != digest[k][order][:-1]]]
                k, doc = k[order], doc[order]
                t, to = _take(token, to, k)
                entries.append(_entries(t, to, digest[k], doc, number[k], often))
            if not entries:
                continue
            columns = [np.concatenate(c) for c in zip(*entries, strict=True)]
            keep = _earliest(*columns[:4])
            columns = [c[keep] for c in columns]
            yield _rows(0, deal.by_kind(mix(columns[0])), columns, _entry_block)
            columns = [np.concatenate(c) for c in zip(*places, strict=True)]
            yield _rows(1, deal.by_part(columns[0]), columns, _place_block)
        release()

    return run


def _earliest(token, digest, doc, number) -> np.ndarray:
    """One entry of each token and digest, that of the earliest line, in order of the tokens."""
    key = mix(token) ^ digest
    order = np.argsort(key)
    fresh = np.r_[True, key[order][1:] != key[order][:-1]] if len(order) else np.zeros(0, bool)
    head = order[fresh]
    if not fresh.all():
        # only groups of several need their lines compared
        group = np.cumsum(fresh) - 1
        several = np.flatnonzero(np.diff(np.append(np.flatnonzero(fresh), len(order))) > 1)
        k = np.flatnonzero(np.isin(group, several))
        ranked = k[np.lexsort((number[order[k]], doc[order[k]], group[k]))]
        first = np.r_[True, group[ranked][1:] != group[ranked][:-1]]
        head[group[ranked[first]]] = order[ranked[first]]
    return head[np.argsort(token[head])]


def _entries(token, to, digest, doc, number, often) -> list[np.ndarray]:
    n = to[1:] - to[:-1]
    owner = np.repeat(np.arange(len(n)), n)
    count = often[slot_of(token)]
    nth = np.arange(len(token)) - np.repeat(to[:-1], n)
    # equal counts stay in the order of the tokens, which is the same in every line
    if len(n) < 1 << 24 and n.max() < 1 << 16:
        order = np.argsort((owner.astype(_U) << _U(40)) | (np.minimum(count, (1 << 24) - 1).astype(_U) << _U(16)) | nth.astype(_U))
    else:
        order = np.lexsort((nth, np.minimum(count, (1 << 24) - 1), owner))
    use = (nth < (n - -(-NEED * n // 100) + 1)[owner]) & (count[order] > 1)
    k, at = order[use], owner[use]
    return [token[k], digest[at], doc[at], number[at].astype(np.int32), n[at].astype(np.int32), nth[use].astype(np.int32), parities(token, to)[at]]


def _meet(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a part's tokens (kind 0): each later set's nearest earlier set that no filter rules out, and (kind 3) all of them where the nearest is far.

    Kind 1 passes through.
    """
    if key[0].as_py() == 1:
        for b in batches:
            yield b.select(["kind", "part", "body"])
        return
    got = [_entry_columns(*unpack(body)) for b in batches for body in b.column("body").to_pylist()]
    columns = [np.concatenate(c) for c in zip(*got, strict=True)]
    del got
    keep = _earliest(*columns[:4])
    columns = [c[keep] for c in columns]
    order = np.lexsort((columns[4], columns[0]))
    token, digest, doc, number, n, nth, parity = (c[order] for c in columns)
    del columns
    number, n, nth = number.astype(np.int64), n.astype(np.int64), nth.astype(np.int64)
    fresh = np.r_[True, token[1:] != token[:-1]]
    rank = np.cumsum(fresh) * (np.int64(1) << 32)
    begin = np.maximum(np.flatnonzero(fresh)[np.cumsum(fresh) - 1], np.searchsorted(rank + n, rank + -(-NEED * n // 100)))
    many = np.arange(len(n)) - begin  # partners: smaller or equal sets before it in the list
    upto = np.cumsum(many)
    # of the smaller set, only the rarer tokens need to be met
    index = nth < n - overlap_needed(2 * n) + 1
    rest = n - nth
    # numbers of the sets here, and of each the nearest earlier one so far
    table, at_set = np.unique(digest, return_index=True)
    number_of = np.searchsorted(table, digest)
    far = np.iinfo(np.int64).max
    best = np.full(len(table), far)  # (apart, entry) of the nearest in one number
    allowed = 2 * (n[at_set] - overlap_needed(2 * n[at_set]))
    safe = np.where(allowed > 0, np.maximum(allowed // 4 - 2, 0), -1)  # so near that it hardly fails
    noted: list[np.ndarray] = []
    held = 0
    at, done = 0, 0

    def note(final: bool) -> Iterator[pa.RecordBatch]:
        nonlocal noted, held
        if not noted or not (final or held > NOTED):
            return
        x, y = np.concatenate(noted, axis=1)
        keep = (best[x] >> 40) > safe[x]
        x, y = x[keep], y[keep]
        one = np.unique((x << 32) | y)
        noted, held = ([np.stack([one >> 32, one & 0xFFFFFFFF])], 0) if not final and len(one) < NOTED else ([], 0)
        if len(one) and not noted:
            used, x = np.unique(one >> 32, return_inverse=True)
            met, y = np.unique(one & 0xFFFFFFFF, return_inverse=True)
            body = pack(table[used], planes(x, 4), table[met], planes(doc[at_set[met]].view(_U), 8), planes(y, 4), planes(doc[at_set[used]].view(_U), 8))
            yield pa.RecordBatch.from_arrays([pa.array([3], pa.int32()), pa.array([key[1].as_py()], pa.int32()), pa.array([body], pa.binary())], schema=_ROW)

    while at < len(n):
        stop = max(at + 1, int(np.searchsorted(upto, done + SLICE, "right")))
        m = many[at:stop]
        left = np.repeat(np.arange(at, stop), m)
        right = np.repeat(begin[at:stop] - (np.cumsum(m) - m), m) + np.arange(len(left))
        at, done = stop, int(upto[stop - 1])
        use = index[right]
        left, right = left[use], right[use]
        both = n[left] + n[right]
        need = overlap_needed(both)
        use = np.minimum(rest[left], rest[right]) >= need
        left, right, most = left[use], right[use], (both - 2 * need)[use]
        apart = np.bitwise_count(parity[left, 0] ^ parity[right, 0]).astype(np.int64) + np.bitwise_count(parity[left, 1] ^ parity[right, 1])
        use = apart <= most
        left, right, apart = left[use], right[use], apart[use]
        later = (doc[left] > doc[right]) | ((doc[left] == doc[right]) & (number[left] > number[right]))
        tie = (doc[left] == doc[right]) & (number[left] == number[right])
        x, y = number_of[np.where(later, left, right)[~tie]], number_of[np.where(later, right, left)[~tie]]
        np.minimum.at(best, x, (apart[~tie] << 40) | y)
        unsure = (best[x] >> 40) > safe[x]
        noted.append(np.stack([x[unsure], y[unsure]]))
        held += int(unsure.sum())
        yield from note(False)
    yield from note(True)
    if (best < far).any():
        x = np.flatnonzero(best < far)
        y = best[x] & ((1 << 40) - 1)
        body = pack(table[x], doc[at_set[x]], number[at_set[x]].astype(np.int32), table[y], doc[at_set[y]], (best[x] >> 40) > safe[x])
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([key[1].as_py()], pa.int32()), pa.array([body], pa.binary())], schema=_ROW)
    release()


_PAIR = "x long, x_doc long, x_line int, y long, y_doc long, noted boolean"


def _pairs(met: DataFrame) -> DataFrame:
    """Each set's nearest earlier set, and whether all its candidates were noted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for body in b.column("body").to_pylist():
                x, x_doc, x_line, y, y_doc, noted = unpack(body)
                columns = [x.view(np.int64), x_doc, x_line, y.view(np.int64), y_doc, noted]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["x", "x_doc", "x_line", "y", "y_doc", "noted"])

    return met.where("kind = 0").mapInArrow(run, _PAIR)


def _noted(body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    xs, x, ys, y_docs, y, x_docs = unpack(body)
    return xs, unplaned(x).astype(np.int64), ys, unplaned(y).astype(np.int64), unplaned(x_docs).view(np.int64), unplaned(y_docs).view(np.int64)


def _noted_ends(met: DataFrame) -> DataFrame:
    """digest and document of each set noted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for body in b.column("body").to_pylist():
                xs, _, ys, _, x_docs, y_docs = _noted(body)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([xs, ys]).view(np.int64)), pa.array(np.concatenate([x_docs, y_docs]))], names=["digest", "doc"])

    return met.where("kind = 3").mapInArrow(run, "digest long, doc long")


def _search_noted(met: DataFrame, asked: DataFrame, sets: DataFrame) -> DataFrame:
    """digest of the sets asked for (digest) that one noted for them verifies.

    Token sets are brought to the parts that note them, one row for each set
    and part; the pairs are worked off there.
    """
    lists = met.where("kind = 3").select("part", "body")

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, body in zip(b.column("part").to_pylist(), b.column("body").to_pylist(), strict=True):
                xs = _noted(body)[0].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(xs), part, np.int32)), pa.array(xs)], names=["part", "digest"])

    here = lists.mapInArrow(names, "part int, digest long").join(asked, "digest")

    def need(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        queries, found = right.column("digest").to_numpy().view(_U), [np.zeros(0, _U)]
        if len(queries):
            for body in left.column("body").to_pylist():
                xs, x, ys, y, _, _ = _noted(body)
                use = np.isin(xs, queries)[x]
                found += [xs[x[use]], ys[y[use]]]
        digests = np.unique(np.concatenate(found))
        return pa.table({"part": pa.array(np.full(len(digests), key[0].as_py(), np.int32)), "digest": pa.array(digests.view(np.int64)), "query": pa.array(np.isin(digests, queries))})

    needed = lists.groupBy("part").cogroup(here.groupBy("part")).applyInArrow(need, "part int, digest long, query boolean")
    rows = needed.join(sets, "digest").select("part", "digest", "query", "tokens")

    def verify(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        digest = right.column("digest").to_numpy().view(_U)
        order = np.argsort(digest)
        digest = digest[order]
        query = right.column("query").to_numpy()[order]
        tokens = [np.frombuffer(t, _U) for t in right.column("tokens").to_pylist()]
        tokens = [tokens[k] for k in order]
        size = np.array([len(t) for t in tokens], np.int64)
        begin = np.cumsum(size) - size
        token = np.concatenate([*tokens, np.zeros(0, _U)])
        done = np.zeros(len(digest), bool)
        for body in left.column("body").to_pylist() if len(digest) else ():
            xs, x, ys, y, _, _ = _noted(body)
            place = lambda d: np.minimum(np.searchsorted(digest, d), len(digest) - 1)
            px, py = place(xs), place(ys)
            use = (digest[px] == xs)[x] & query[px][x]
            x, y = px[x[use]], py[y[use]]
            for k in range(0, len(x), 4096):
                a, b = x[k : k + 4096], y[k : k + 4096]
                open_ = ~done[a]
                a, b = a[open_], b[open_]
                common = _overlap(token, begin, size, a, b)
                done[a[100 * common >= NEED * (size[a] + size[b] - common)]] = True
        return pa.table({"digest": pa.array(digest[done].view(np.int64))})

    return lists.groupBy("part").cogroup(rows.groupBy("part")).applyInArrow(verify, "digest long").distinct()


def _search_all(docs: DataFrame, queries: list[tuple]) -> DataFrame:
    """digest of the queries (digest, doc, line, tokens) that an earlier line of docs matches."""
    shared = docs.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = [(d, i, n, np.frombuffer(t, _U)) for d, i, n, t in shared.value]
        # a match holds one of any size - need + 1 tokens of the query
        first = [q[3][: len(q[3]) - -(-NEED * len(q[3]) // 100) + 1] for q in asked]
        prefix, owner = np.concatenate(first), np.repeat(np.arange(len(first)), [len(f) for f in first])
        order = np.argsort(prefix, kind="stable")
        prefix, owner = prefix[order], owner[order]
        done: set[int] = set()
        for b in batches:
            data, offsets = text_bytes(b.column(1))
            ids = b.column(0).fill_null(NO_ID).to_numpy()
            for lead, part, at in blocks(data, offsets):
                text, number, token, to, digest = line_sets(part, at)
                place = np.flatnonzero(np.isin(token, prefix))
                line = np.searchsorted(to, place, "right") - 1
                lo, hi = np.searchsorted(prefix, token[place]), np.searchsorted(prefix, token[place], "right")
                pairs = {(j, int(q)) for j, a, e in zip(line.tolist(), lo.tolist(), hi.tolist(), strict=True) for q in owner[a:e]}
                for j, q in sorted(pairs):
                    d, i, n, t = asked[q]
                    if d in done or digest[j].view(np.int64) == d or (int(ids[lead + text[j]]), int(number[j])) >= (i, n):
                        continue
                    mine = token[to[j] : to[j + 1]]
                    common = len(np.intersect1d(mine, t, assume_unique=True))
                    if 100 * common >= NEED * (len(mine) + len(t) - common):
                        done.add(d)
        yield pa.RecordBatch.from_arrays([pa.array(sorted(done), pa.int64())], names=["digest"])

    return docs.mapInArrow(run, "digest long").distinct()


def _overlap(token: np.ndarray, begin: np.ndarray, size: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many tokens each two sets share."""
    pair, value = [np.zeros(0, np.int64)], [np.zeros(0, _U)]
    for s in (x, y):
        n = size[s]
        pair.append(np.repeat(np.arange(len(s)), n))
        value.append(token[np.repeat(begin[s] - (np.cumsum(n) - n), n) + np.arange(n.sum())])
    pair, value = np.concatenate(pair), np.concatenate(value)
    order = np.lexsort((value, pair))
    same = (value[order][1:] == value[order][:-1]) & (pair[order][1:] == pair[order][:-1])
    return np.bincount(pair[order][1:][same], minlength=len(x))


def _part_of(ids: np.ndarray, deal: Deal) -> np.ndarray:
    return deal.by_part(mix(ids.view(_U)))


def _bit_of(ids: np.ndarray) -> np.ndarray:
    return (mix(np.ascontiguousarray(ids).view(_U)) >> _U(64 - DOC_BITS)).astype(np.int64)


def marked(ends: DataFrame) -> np.ndarray:
    """Bits, packed, of which those of the documents (doc) of ends are set; others may share them."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << DOC_BITS, bool)
        for b in batches:
            bits[_bit_of(b.column(0).to_numpy())] = True
        yield pa.RecordBatch.from_arrays([pa.array([pack(np.packbits(bits))], pa.binary())], names=["body"])

    def join(bodies: Iterator[bytes]) -> np.ndarray:
        bits = np.zeros(1 << (DOC_BITS - 3), np.uint8)
        for body in bodies:
            bits |= unpack(body)[0]
        return bits

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = join(body for b in batches for body in b.column("body").to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([pack(bits)], pa.binary())], names=["body"])

    return join(r["body"] for r in ends.select("doc").mapInArrow(mark, "body binary").repartition(ADDERS).mapInArrow(add, "body binary").toLocalIterator())


def send_texts(docs: DataFrame, deal: Deal, asked=None) -> DataFrame:
    """The texts of docs (doc_id, text), as blocks by id; asked: a broadcast of ``marked`` bits, other texts stay away."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if asked is not None:
                bit = _bit_of(b.column(0).fill_null(NO_ID).to_numpy())
                b = b.filter(pa.array((asked.value[bit >> 3] >> (7 - (bit & 7))) & 1 == 1))
            ids = b.column(0).fill_null(NO_ID).to_numpy()
            texts = b.column(1).cast(pa.binary()).to_pylist()
            part = _part_of(np.ascontiguousarray(ids), deal)
            order = np.argsort(part, kind="stable")
            cut = np.flatnonzero(np.r_[True, part[order][1:] != part[order][:-1]]) if len(order) else np.zeros(0, np.int64)
            runs = [order[a:e] for a, e in zip(cut, np.append(cut[1:], len(order)), strict=True)] if len(cut) else []
            bodies = [pack([texts[i] for i in k]) for k in runs]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part[order][cut] if len(cut) else [], pa.int32()), pa.array([ids[k].tobytes() for k in runs], pa.binary()), pa.array(bodies, pa.binary())], names=["part", "ids", "body"]
            )

    return docs.mapInArrow(run, "part int, ids binary, body binary")


def _by_part(rows: DataFrame, deal: Deal) -> DataFrame:
    """rows with the part of their column doc, as the texts are dealt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc = b.column(b.schema.get_field_index("doc")).to_numpy()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(_part_of(np.ascontiguousarray(doc), deal))], names=[*b.schema.names, "part"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("part", T.IntegerType())]))


def _texts(left: pa.Table) -> Iterator[tuple[np.ndarray, list]]:
    for ids, body in zip(left.column("ids").to_pylist(), left.column("body").to_pylist(), strict=True):
        yield np.frombuffer(ids, np.int64), unpack(body)[0]


def _fetch(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """Token sets of the lines asked for, by digest."""
    wanted = np.unique(right.column("digest").to_numpy().view(_U))
    asked = np.unique(right.column("doc").to_numpy())
    digests, bodies, seen = [], [], np.zeros(len(wanted), bool)
    for ids, texts in _texts(left):
        k = np.flatnonzero(_among(ids, asked))
        if not len(k):
            continue
        data, offsets = text_bytes(pa.array([texts[i] for i in k], pa.binary()))
        for _, part, at in blocks(data, offsets):
            _, _, token, to, digest = line_sets(part, at)
            hit = np.flatnonzero(_among(digest, wanted))
            which, one = np.unique(np.searchsorted(wanted, digest[hit]), return_index=True)
            new = ~seen[which]
            seen[which] = True
            for j in hit[one[new]].tolist():
                digests.append(digest[j])
                bodies.append(np.sort(token[to[j] : to[j + 1]]).tobytes())
    return pa.table({"digest": pa.array(np.array(digests, _U).view(np.int64)), "tokens": pa.array(bodies, pa.binary())})


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """digest of each x of the pairs (x, y) that reaches the similarity on full sets."""
    side = lambda c: sets.select(F.col("digest").alias(c), F.col("tokens").alias(f"{c}_tokens"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for p, q in zip(b.column(1), b.column(2), strict=True):
                p, q = np.frombuffer(p.as_buffer(), _U), np.frombuffer(q.as_buffer(), _U)
                both = np.sort(np.concatenate([p, q]))
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                ok.append(100 * common >= NEED * (len(p) + len(q) - common))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok, pa.bool_()))], names=["digest"])
        release()

    return pairs.select("x", "y").distinct().join(side("x"), "x").join(side("y"), "y").select("x", "x_tokens", "y_tokens").mapInArrow(run, "digest long").distinct()


def removals(docs: DataFrame, deal: Deal, scratch: Scratch) -> DataFrame:
    """part (of the document), body: doc, line, digest of the lines to remove; docs has doc_id and text."""
    spark = docs.sparkSession
    counts = spark.sparkContext.broadcast(slot_counts(docs, _tokens))
    sent = docs.mapInArrow(_send(deal, counts), _ROW_DDL)

    def token_sets(ends: DataFrame) -> DataFrame:
        ends = scratch.keep(ends.distinct())
        texts = send_texts(docs, deal, spark.sparkContext.broadcast(marked(ends)))
        return scratch.keep(texts.groupBy("part").cogroup(_by_part(ends, deal).groupBy("part")).applyInArrow(_fetch, "digest long, tokens binary"))

    met = scratch.keep(sent.groupBy("kind", "part").applyInArrow(_meet, _ROW_DDL))
    pairs = _pairs(met)
    ends = pairs.select(F.col("x").alias("digest"), F.col("x_doc").alias("doc")).unionAll(pairs.select("y", "y_doc")).unionAll(_noted_ends(met))
    sets = token_sets(ends)
    found = scratch.keep(_verified(pairs, sets))
    left = scratch.keep(pairs.groupBy(F.col("x").alias("digest")).agg(F.min("noted").alias("noted"), F.first("x_doc").alias("doc"), F.first("x_line").alias("line")).join(found, "digest", "left_anti"))
    found = found.unionAll(scratch.keep(_search_noted(met, left.select("digest"), sets)))
    # sets whose nearest looked near in some part and failed: each against all documents, in blocks
    left = left.where("NOT noted").join(found, "digest", "left_anti").join(sets, "digest")
    block: list[tuple] = []
    for r in left.select("digest", "doc", "line", "tokens").toLocalIterator():
        block.append(tuple(r))
        if len(block) == QUERY_BLOCK:
            found, block = found.unionAll(scratch.keep(_search_all(docs, block))), []
    if block:
        found = found.unionAll(scratch.keep(_search_all(docs, block)))
    later = found.withColumn("part", deal.column(F.pmod(F.col("digest").cast("decimal(20,0)") + F.when(F.col("digest") < 0, F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(0), F.lit(deal.parts)).cast("int")))

    def settle(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        """Of the lines of a part's sets: all but the earliest of each, and all of the sets that match an earlier one."""
        got = [_place_columns(*unpack(body)) for body in left.column("body").to_pylist()]
        if not got:
            return pa.table({"part": pa.array([], pa.int32()), "body": pa.array([], pa.binary())})
        digest, doc, number = (np.concatenate(c) for c in zip(*got, strict=True))
        order = np.lexsort((number, doc, digest))
        digest, doc, number = digest[order], doc[order], number[order]
        head = np.flatnonzero(np.r_[True, digest[1:] != digest[:-1]])
        of = np.cumsum(np.r_[True, digest[1:] != digest[:-1]]) - 1
        behind = (doc > doc[head][of]) | ((doc == doc[head][of]) & (number > number[head][of]))
        gone = behind | np.isin(digest, right.column("digest").to_numpy().view(_U))
        rows = _rows(2, _part_of(np.ascontiguousarray(doc[gone]), deal), [digest[gone], doc[gone], number[gone]], _place_block)
        return pa.Table.from_batches([rows.select(["part", "body"])])

    return met.where("kind = 1").groupBy("part").cogroup(later.groupBy("part")).applyInArrow(settle, "part int, body binary")


def _cut(key: tuple, left: pa.Table, right: pa.Table, texts_too: bool) -> pa.Table:
    """Each text without its removed lines."""
    got = [_place_columns(*unpack(body)) for body in right.column("body").to_pylist()]
    digest, doc, number = (np.concatenate(c) for c in zip(*got, strict=True)) if got else (np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int32))
    gone = np.unique(_line_key(digest, doc, number))
    order = np.argsort(doc, kind="stable")
    touched, number = doc[order], number[order]
    # the lines of rows that share an id are told apart by their hashes
    known, rows = np.unique(np.concatenate([np.frombuffer(i, np.int64) for i in left.column("ids").to_pylist()] or [np.zeros(0, np.int64)]), return_counts=True)
    known = known[rows > 1]
    out: list[list] = [[] for _ in range(5 if texts_too else 4)]
    for ids, texts in _texts(left):
        lo, hi = np.searchsorted(touched, ids), np.searchsorted(touched, ids, "right")
        shared = _among(ids, known)
        drop = {k: set(number[lo[k] : hi[k]].tolist()) for k in np.flatnonzero((hi > lo) & ~shared).tolist()}
        some = np.flatnonzero((hi > lo) & shared)
        data, offsets = text_bytes(pa.array([texts[k] for k in some], pa.binary()))
        for first, part, at in blocks(data, offsets):
            text, line, _, _, h = line_sets(part, at)
            hit = np.flatnonzero((h != 0) & _among(_line_key(h, ids[some[first + text]], line), gone))
            for t, n in zip(some[first + text[hit]].tolist(), line[hit].tolist(), strict=True):
                drop.setdefault(t, set()).add(n)
        for k, (i, t) in enumerate(zip(ids.tolist(), texts, strict=True)):
            kept, n, away = t, 0 if t is None else t.count(b"\n") + 1, drop.get(k, ())
            if away:
                kept = b"\n".join([x for j, x in enumerate(t.split(b"\n")) if j not in away])
            for column, v in zip(out, (None if i == NO_ID else i, n, len(away), hashlib.sha256(kept or b"").hexdigest(), kept)[: len(out)], strict=True):
                column.append(v)
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())[: len(out)]
    table = pa.table([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["doc_id", "n_lines", "n_removed", "kept_sha256", "kept"][: len(out)])
    release()
    return table


def _line_key(digest: np.ndarray, doc: np.ndarray, number: np.ndarray) -> np.ndarray:
    return mix(mix(digest + np.ascontiguousarray(doc).view(_U)) ^ number.astype(_U))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: bool = True) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 and, if asked for, the kept text (as UTF-8) of each row."""
    deal = Deal(max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    gone = removals(source, deal, Scratch(docs.sparkSession, "lines"))

    def cut(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        return _cut(key, left, right, texts)

    ddl = "doc_id long, n_lines long, n_removed long, kept_sha256 string" + (", kept binary" if texts else "")
    return send_texts(source, deal).groupBy("part").cogroup(gone.groupBy("part")).applyInArrow(cut, ddl)


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(read(spark, sf_dir, "documents"), texts=False)


ORACLE = """
WITH split AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
lines AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS n FROM split),
sets AS (
  SELECT doc_id, n, line, list_sort(list_distinct(regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\t\\n\\x0B\\f\\r]+'))) AS s FROM lines),
classes AS (SELECT s, len(s) AS m, min({'d': doc_id, 'n': n}) AS place, row_number() OVER () AS k FROM sets WHERE len(s) > 0 GROUP BY s),
words AS (SELECT k, m, place, unnest(s) AS t FROM classes),
often AS (SELECT t, count(*) AS f FROM words GROUP BY t),
ranked AS (SELECT k, m, place, t, row_number() OVER (PARTITION BY k ORDER BY f, t) AS r FROM words JOIN often USING (t)),
prefixes AS (SELECT * FROM ranked WHERE r <= m - (75 * m + 99) // 100 + 1),
pairs AS (
  SELECT DISTINCT a.k AS late, b.k AS early FROM prefixes a JOIN prefixes b ON a.t = b.t AND b.place < a.place
  WHERE 100 * least(a.m, b.m) >= 75 * greatest(a.m, b.m)),
near AS (
  SELECT DISTINCT late FROM (SELECT late, x.m + y.m AS m, len(list_intersect(x.s, y.s)) AS i FROM pairs JOIN classes x ON x.k = late JOIN classes y ON y.k = early)
  WHERE 100 * i >= 75 * (m - i)),
judged AS (
  SELECT sets.doc_id, sets.n, line, c.k IS NOT NULL AND ({'d': sets.doc_id, 'n': sets.n} > place OR near.late IS NOT NULL) AS gone
  FROM sets LEFT JOIN classes c ON c.s = sets.s LEFT JOIN near ON near.late = c.k),
kept AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, string_agg(line, chr(10) ORDER BY n) FILTER (NOT gone) AS t FROM judged GROUP BY doc_id)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM documents LEFT JOIN kept USING (doc_id)
"""
