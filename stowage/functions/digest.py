"""BLAKE3 with 256-bit output, from the published description.

Input is cut in chunks of 1024 bytes; a chunk is compressed block by block,
chunks are joined in a binary tree.  All chunks of an input, and all parents
of a level, are compressed together as NumPy columns.
"""

from __future__ import annotations

import numpy as np

# Fixed values of the algorithm: initial value, message permutation, flags.
IV = [0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19]
PERMUTATION = [2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8]
CHUNK_START, CHUNK_END, PARENT, ROOT = 1, 2, 4, 8
CHUNK, BLOCK = 1024, 64

_U = np.uint32


def _schedule() -> list[tuple[tuple[list[int], list[int]], tuple[list[int], list[int]]]]:
    """For each round, the message words that the two halves of its column step and of its diagonal step add."""
    out, words = [], list(range(16))
    for _ in range(7):
        out.append(((words[0:8:2], words[1:8:2]), (words[8:16:2], words[9:16:2])))
        words = [words[p] for p in PERMUTATION]
    return out


SCHEDULE = _schedule()
SHIFTS = [[(_U(n), _U(32 - n)) for n in pair] for pair in ((16, 12), (8, 7))]
#: Blocks compressed together.
LANES = 1 << 13


def _compress(chain: np.ndarray, words: np.ndarray, counter: np.ndarray, length: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """New chaining values (n x 8) of n blocks at once."""
    out = np.empty((len(chain), 8), _U)
    for k in range(0, len(chain), LANES):
        p = slice(k, k + LANES)
        _compress_lanes(chain[p], words[p], counter[p], length[p], flags[p], out[p])
    return out


def _compress_lanes(chain: np.ndarray, words: np.ndarray, counter: np.ndarray, length: np.ndarray, flags: np.ndarray, out: np.ndarray) -> None:
    n = len(chain)
    m = np.ascontiguousarray(words.T)
    # the state's four rows, a to d; rows further on hold copies, so that a diagonal step sees its words as neighbours
    a, b, c, d, s, t = (np.empty((k, n), _U) for k in (4, 5, 6, 5, 4, 4))
    a[:], b[:4], c[:4] = chain.T[:4], chain.T[4:], np.array(IV[:4], _U)[:, None]
    d[1], d[2], d[3], d[4] = counter & 0xFFFFFFFF, counter >> 32, length, flags

    def mix(b: np.ndarray, c: np.ndarray, d: np.ndarray, halves: tuple[list[int], list[int]]) -> None:
        for half, ((right1, left1), (right2, left2)) in zip(halves, SHIFTS, strict=True):
            np.add(a, b, out=a)
            np.add(a, m.take(half, axis=0, out=t, mode="clip"), out=a)
            np.bitwise_xor(d, a, out=d)
            np.right_shift(d, right1, out=s)
            np.left_shift(d, left1, out=d)
            np.bitwise_or(d, s, out=d)
            np.add(c, d, out=c)
            np.bitwise_xor(b, c, out=b)
            np.right_shift(b, right2, out=s)
            np.left_shift(b, left2, out=b)
            np.bitwise_or(b, s, out=b)

    for columns, diagonals in SCHEDULE:
        mix(b[:4], c[:4], d[1:], columns)
        b[4], c[4:], d[0] = b[0], c[:2], d[4]
        mix(b[1:], c[2:], d[:4], diagonals)
        b[0], c[:2], d[4] = b[4], c[4:], d[0]
    out[:, :4], out[:, 4:] = (a ^ c[:4]).T, (b[:4] ^ d[1:]).T


def _chunk_chains(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Chaining values of all chunks of all texts, and how many chunks each has; a text of one chunk gets its digest."""
    sizes = np.array([len(t) for t in texts], np.int64)
    counts = np.maximum(1, -(-sizes // CHUNK))
    first = np.cumsum(counts) - counts
    total = int(counts.sum())
    padded = np.zeros(total * CHUNK, np.uint8)
    for at, t in zip((first * CHUNK).tolist(), texts, strict=True):
        padded[at : at + len(t)] = np.frombuffer(t, np.uint8)
    words = padded.view("<u4").astype(_U).reshape(total, CHUNK // BLOCK, 16)
    owner = np.repeat(np.arange(len(texts)), counts)
    counter = np.arange(total) - first[owner]
    size = np.minimum(CHUNK, sizes[owner] - counter * CHUNK)
    blocks = np.maximum(1, -(-size // BLOCK))
    alone = counts[owner] == 1
    chain = np.tile(np.array(IV, _U), (total, 1))
    for b in range(int(blocks.max())):
        live = np.flatnonzero(blocks > b)
        last = blocks[live] == b + 1
        flags = (CHUNK_START if b == 0 else 0) | np.where(last, CHUNK_END | np.where(alone[live], ROOT, 0), 0)
        chain[live] = _compress(chain[live], words[live, b], counter[live], np.minimum(BLOCK, size[live] - b * BLOCK), flags)
    return chain, counts


#: Bytes hashed together.
PORTION = 4 << 20


def blake3_many(texts: list[bytes]) -> list[bytes]:
    """The digest of each text; texts are hashed together, so many small ones are as quick as a large one."""
    out: list[bytes] = []
    k = 0
    while k < len(texts):
        j, size = k, 0
        while j < len(texts) and (j == k or size + len(texts[j]) <= PORTION):
            size += len(texts[j])
            j += 1
        out += _digests(texts[k:j])
        k = j
    return out


def _digests(texts: list[bytes]) -> list[bytes]:
    level, counts = _chunk_chains(texts)
    owner = np.repeat(np.arange(len(texts)), counts)
    while len(level) > len(texts):
        # join neighbours level by level, an odd one carried up: the left-full tree
        first = np.cumsum(counts) - counts
        place = np.arange(len(level)) - first[owner]
        left = np.flatnonzero((place % 2 == 0) & (place + 1 < counts[owner]))
        chain = np.tile(np.array(IV, _U), (len(left), 1))
        pairs = np.concatenate([level[left], level[left + 1]], axis=1)
        flags = np.where(counts[owner[left]] == 2, PARENT | ROOT, PARENT)
        level[left] = _compress(chain, pairs, np.zeros(len(left), np.int64), np.full(len(left), BLOCK), flags)
        keep = place % 2 == 0
        level, owner = level[keep], owner[keep]
        counts = -(-counts // 2)
    raw = level.astype("<u4").tobytes()
    return [raw[32 * k : 32 * k + 32] for k in range(len(texts))]


def blake3(data: bytes) -> bytes:
    return blake3_many([data])[0]
