"""The sorted index of an archive: bytes of a radix tree, read and written.

24 bytes of header, 8 bytes a node (offsets of its hot and cold parts), then
all hot parts (flags, edge count, first bytes or a 256-byte table, an offset
for each edge) and all cold parts (label, output and target of each edge, the
output of a final node).  A key's value is the sum of outputs on its way.
"""

from __future__ import annotations

import struct
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np

from .errors import ParseError, WriteError
from .vint import U64, decode_vu64, get_vu, put_vu, vu_sizes

# Fixed values of the format.
MAGIC, VERSION = b"BFST", 1
HEADER, ENTRY = struct.Struct("<4sBBHIQI"), struct.Struct("<II")
FINAL, INDEXED, FEW = 1, 2, 16
#: Nodes that are read at once.
PORTION = 1 << 18


class Index:
    """An index over bytes; every offset is checked as it is followed."""

    def __init__(self, data: bytes):
        if len(data) < HEADER.size:
            raise ParseError("index is shorter than its header")
        magic, version, _, _, self.nodes, self.entries, self.cold = HEADER.unpack_from(data)
        if magic != MAGIC or version != VERSION:
            raise ParseError("not an index of version 1")
        self.data, self.hot = data, HEADER.size + 8 * self.nodes
        if self.nodes == 0 or self.hot > len(data) or self.cold > len(data):
            raise ParseError("index sections lie outside the index")

    def __len__(self) -> int:
        return self.entries

    def _node(self, number: int) -> tuple[list[tuple[bytes, int, int]], int | None]:
        """The edges (label, output, target) of a node, and its final output."""
        if number >= self.nodes:
            raise ParseError(f"index node {number} of {self.nodes}")
        data = self.data
        hot, cold = ENTRY.unpack_from(data, HEADER.size + 8 * number)
        at, base = self.hot + hot, self.cold + cold
        if at >= len(data) or base > len(data):
            raise ParseError("index node lies outside the index")
        flags = data[at]
        count, at = decode_vu64(data, at + 1)
        if count > 256:
            raise ParseError("index node with over 256 edges")
        at += 256 if flags & INDEXED else count
        if at + 2 * count > len(data):
            raise ParseError("index node is cut off")
        edges, stop = [], base
        for (offset,) in struct.iter_unpack("<H", data[at : at + 2 * count]):
            n, p = decode_vu64(data, base + offset)
            if n == 0 or p + n > len(data):
                raise ParseError("index label is cut off", p)
            label = bytes(data[p : p + n])
            output, p = decode_vu64(data, p + n)
            if p + 4 > len(data):
                raise ParseError("index edge is cut off", p)
            edges.append((label, output, int.from_bytes(data[p : p + 4], "little")))
            stop = max(stop, p + 4)
        return edges, decode_vu64(data, stop)[0] if flags & FINAL else None

    def _edge(self, number: int, byte: int) -> tuple[bytes, int, int] | None:
        """The one edge of a node that starts with the byte, found by its table or its list of first bytes."""
        if number >= self.nodes:
            raise ParseError(f"index node {number} of {self.nodes}")
        data = self.data
        hot, cold = ENTRY.unpack_from(data, HEADER.size + 8 * number)
        at, base = self.hot + hot, self.cold + cold
        if at >= len(data) or base > len(data):
            raise ParseError("index node lies outside the index")
        indexed = data[at] & INDEXED
        count, at = decode_vu64(data, at + 1)
        wide = 256 if indexed else count
        if count > 256 or at + wide + 2 * count > len(data):
            raise ParseError("index node is cut off")
        nth = data[at + byte] if indexed else bytes(data[at : at + count]).find(byte)
        if nth < 0 or nth >= count or (indexed and nth == 255 and count < 256):
            return None
        p = base + int.from_bytes(data[at + wide + 2 * nth : at + wide + 2 * nth + 2], "little")
        n, p = decode_vu64(data, p)
        if n == 0 or p + n > len(data):
            raise ParseError("index label is cut off", p)
        label = bytes(data[p : p + n])
        output, p = decode_vu64(data, p + n)
        if p + 4 > len(data):
            raise ParseError("index edge is cut off", p)
        return label, output, int.from_bytes(data[p : p + 4], "little")

    def get(self, key: bytes) -> int | None:
        node, at, total = 0, 0, 0
        while at < len(key):
            step = self._edge(node, key[at])
            if step is None or not key.startswith(step[0], at):
                return None
            label, output, node = step
            at, total = at + len(label), total + output
        final = self._node(node)[1]
        return None if final is None else (total + final) & U64

    def __contains__(self, key: bytes) -> bool:
        return self.get(key) is not None

    def prefix(self, start: bytes = b"") -> Iterator[tuple[bytes, int]]:
        """All (key, value) below a prefix, which may end inside a label, in key order."""
        node, above, so_far = 0, b"", 0
        while len(above) < len(start):  # one edge a step leads there; the other edges of these nodes aren't read
            step = self._edge(node, start[len(above)])
            if step is None:
                return
            above, so_far, node = above + step[0], so_far + step[1], step[2]
            n = min(len(above), len(start))
            if above[:n] != start[:n]:
                return
        stack = [(node, above, so_far, 0)]
        while stack:
            number, key, total, depth = stack.pop()
            if depth > self.nodes:
                raise ParseError("index has a cycle")
            edges, final = self._node(number)
            if final is not None:
                yield key, (total + final) & U64
            stack += [(target, key + label, total + output, depth + 1) for label, output, target in reversed(edges)]

    def items(self) -> Iterator[tuple[bytes, int]]:
        return self.prefix()

    def of_length(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The keys of one length, a row of bytes each, in order, and their values; many nodes are read at once."""
        try:
            keys, values = self._of_length(size)
        except IndexError:  # something is wrong: walked node by node, it is told what
            rows = [(k, v) for k, v in self.items() if len(k) == size]
            keys, values = np.frombuffer(b"".join(k for k, _ in rows), np.uint8).reshape(-1, size), np.array([v for _, v in rows], np.uint64)
        order = np.lexsort(keys.T[::-1])
        return keys[order], values[order]

    def _of_length(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        data = np.frombuffer(self.data, np.uint8)
        places = np.frombuffer(self.data, "<u4", 2 * self.nodes, HEADER.size).reshape(-1, 2)
        found = [(np.empty((0, size), np.uint8), np.empty(0, np.uint64))]
        stack = [(np.zeros(1, np.int64), np.zeros((1, size), np.uint8), np.zeros(1, np.int64), np.zeros(1, np.uint64))]
        while stack:
            node, key, length, total = stack.pop()
            if len(node) > PORTION:
                stack += [(node[k : k + PORTION], key[k : k + PORTION], length[k : k + PORTION], total[k : k + PORTION]) for k in range(0, len(node), PORTION)]
                continue
            place = places[node].astype(np.int64)
            at, base = self.hot + place[:, 0], self.cold + place[:, 1]
            flags = data[at]
            count, at = get_vu(data, at + 1)
            if len(count) and count.max() > 256:
                raise IndexError("index node with over 256 edges")
            count = count.astype(np.int64)
            parent, nth = np.repeat(np.arange(len(node)), count), _runs(count)
            p = (at + np.where(flags & INDEXED, 256, count))[parent] + 2 * nth
            n, p = get_vu(data, base[parent] + (data[p] | data[p + 1].astype(np.int64) << 8))
            if len(n) and (n.min() == 0 or n.max() > len(data)):
                raise IndexError("index label is cut off")
            n = n.astype(np.int64)
            output, q = get_vu(data, p + n)
            target = sum(data[q + k].astype(np.int64) << (8 * k) for k in range(4))
            stop = base.copy()
            np.maximum.at(stop, parent, q + 4)
            ends = (flags & FINAL).astype(bool)
            value = get_vu(data, stop[ends])[0]
            whole = length[ends] == size
            found.append((key[ends][whole], (total[ends] + value)[whole]))
            if (length[parent] + n > size).any():
                raise IndexError("keys of other lengths are left to the walk")
            longer = key[parent]
            longer[np.repeat(np.arange(len(parent)), n), np.repeat(length[parent], n) + _runs(n)] = data[np.repeat(p, n) + _runs(n)]
            if len(parent):
                stack.append((target, longer, length[parent] + n, total[parent] + output))
        return np.concatenate([k for k, _ in found]), np.concatenate([v for _, v in found])


def ordered(keys: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each key the bytes it shares with the one before; checks that keys rise strictly, duplicates and disorder told apart.

    keys: all keys' bytes, one after another; starts: where each begins, and the end.
    """
    sizes = np.diff(starts)
    shared = np.zeros(len(sizes), np.int32)
    left, depth = np.arange(1, len(sizes)), 0
    while len(left):
        before, own = sizes[left - 1] > depth, sizes[left] > depth
        if (k := np.flatnonzero(~own)).size:
            key = keys[starts[left[k[0]]] : starts[left[k[0]] + 1]].tobytes()
            raise WriteError(f"key {key!r} is out of order" if before[k[0]] else f"duplicate key {key!r}")
        left = left[before]
        a, b = keys[starts[left - 1] + depth], keys[starts[left] + depth]
        if (k := np.flatnonzero(a > b)).size:
            raise WriteError(f"key {keys[starts[left[k[0]]] : starts[left[k[0]] + 1]].tobytes()!r} is out of order")
        left, depth = left[a == b], depth + 1
        shared[left] = depth
    if not len(sizes):
        raise WriteError("an index needs a key")
    return shared


def build(entries: Iterable[tuple[bytes, int]]) -> bytes:
    """The bytes of an index of entries in strict byte order."""
    rows = list(entries)
    starts = np.cumsum([0, *(len(k) for k, _ in rows)])
    return b"".join(built(np.frombuffer(b"".join(k for k, _ in rows), np.uint8), starts, np.array([v for _, v in rows], np.uint64)))


def _runs(sizes: np.ndarray) -> np.ndarray:
    """0, 1, .. size - 1 for each size."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def built(keys: np.ndarray, starts: np.ndarray, values: np.ndarray) -> list[bytes]:
    """``build`` for keys as in ``ordered``, in pieces.

    A node is a run of entries and the length its keys share so far.  Values
    are written at final nodes; edges add nothing.  Nodes are made level by
    level, many of a level at once.
    """
    shared = ordered(keys, starts)
    sizes = np.diff(starts)
    waiting = deque([(np.zeros(1, np.int64), np.array([len(sizes)]), np.zeros(1, np.int64))])
    places, hots, colds = [], [], []
    made, hot_at, cold_at = 1, 0, 0
    while waiting:
        low, high, depth = waiting.popleft()
        if len(low) > PORTION:
            waiting.extendleft([(low[k : k + PORTION], high[k : k + PORTION], depth[k : k + PORTION]) for k in range(0, len(low), PORTION)][::-1])
            continue
        final = sizes[low] == depth
        first = low + final
        n = high - first
        at = np.repeat(first, n) + _runs(n)
        node = np.repeat(np.arange(len(low)), n)
        cut = (at == first[node]) | (shared[at] == depth[node])
        begin = np.flatnonzero(cut)
        child, parent = at[begin], node[begin]
        # how deep each child goes: what all its keys share, or all of its only key
        within = np.where(cut, np.iinfo(np.int32).max, shared[at])
        deep = np.minimum.reduceat(within, begin) if len(begin) else within
        deep = np.where(deep == np.iinfo(np.int32).max, sizes[child], deep).astype(np.int64)
        stop = np.append(at[begin[1:] - 1] + 1, at[-1:] + 1) if len(begin) else child
        del at, node, cut, within
        label = deep - depth[parent]
        edges = np.bincount(parent, minlength=len(low))
        nth = _runs(edges)
        # cold parts: label, output and target of each edge, then the output of a final node
        edge_size = vu_sizes(label) + label + 5
        upto = np.cumsum(edge_size)
        base = np.concatenate(([0], upto))[np.cumsum(edges) - edges]
        offset = upto - edge_size - base[parent]
        if len(offset) and offset.max() > 0xFFFF:
            raise WriteError("labels of one index node exceed 65535 bytes")
        ends = np.bincount(parent, edge_size, len(low)).astype(np.int64)
        value = values[low]
        cold_size = ends + np.where(final, vu_sizes(value), 0)
        cold_from = np.cumsum(cold_size) - cold_size
        cold = np.zeros(int(cold_size.sum()), np.uint8)
        p = cold_from[parent] + offset
        put_vu(cold, p, label)
        p += vu_sizes(label)
        cold[np.repeat(p, label) + _runs(label)] = keys[np.repeat(starts[child] + depth[parent], label) + _runs(label)]
        p += label
        cold[p] = 0x80
        target = made + np.arange(len(child))
        for k in range(4):
            cold[p + 1 + k] = target >> (8 * k) & 0xFF
        put_vu(cold, (cold_from + ends)[final], value[final])
        # hot parts: flags, edge count, first bytes or a table, an offset for each edge
        many = edges > FEW
        head = 1 + vu_sizes(edges)
        wide = np.where(many, 256, edges)
        hot_size = head + wide + 2 * edges
        hot_from = np.cumsum(hot_size) - hot_size
        hot = np.zeros(int(hot_size.sum()), np.uint8)
        hot[hot_from] = final * FINAL + many * INDEXED
        put_vu(hot, hot_from + 1, edges)
        tables = (hot_from + head)[many]
        hot[np.repeat(tables, 256) + np.tile(np.arange(256), len(tables))] = 255
        byte = keys[starts[child] + depth[parent]].astype(np.int64)
        listed = (hot_from + head)[parent]
        hot[listed + np.where(many[parent], byte, nth)] = np.where(many[parent], nth, byte)
        p = listed + wide[parent] + 2 * nth
        hot[p], hot[p + 1] = offset & 0xFF, offset >> 8
        places.append(np.stack([hot_from + hot_at, cold_from + cold_at], 1).astype("<u4").tobytes())
        hots.append(hot.tobytes())
        colds.append(cold.tobytes())
        made, hot_at, cold_at = made + len(child), hot_at + len(hot), cold_at + len(cold)
        if HEADER.size + 8 * made + hot_at + cold_at > 0xFFFFFFFF:
            raise WriteError("index exceeds 4 GiB")
        if len(child):
            waiting.append((child, stop, deep))
    nodes = made
    return [HEADER.pack(MAGIC, VERSION, 0, 0, nodes, len(sizes), HEADER.size + 8 * nodes + hot_at), *places, *hots, *colds]
