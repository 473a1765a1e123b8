"""Word shingles of whole texts, a batch at a time, and MinHash signatures of them."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

WORDS = 5
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
U = np.uint64
_random = np.random.default_rng(5)
BYTE = _random.integers(1, 1 << 63, 256, dtype=np.uint64)
BASE = U(0x9E3779B97F4A7C15)
PLACE = _random.integers(1, 1 << 63, 64, dtype=np.uint64) | U(1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(29))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


@lru_cache(maxsize=2)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = U(pow(int(BASE), -1, 1 << 64))
    one = np.ones(1 << bits, np.uint64)
    up, down = one * BASE, one * inverse
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls, and its n + 1 offsets."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data, offsets - offsets[0]


def pieces(column: pa.Array, most: int = 1 << 21):
    """Slices (start, stop) of a column with about `most` bytes each; a longer text is a slice of its own."""
    _, offsets = utf8(column)
    at = 0
    while at < len(column):
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, stop
        at = stop


def shingles(column: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes, n + 1 offsets): the shingles of each text in order, repeats included.

    Words are separated by ASCII white space and taken as they are. A text of fewer words than a
    shingle holds is one shingle; one without words has none.
    """
    data, offsets = utf8(column)
    n = len(column)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    word = ~SPACE[data]
    starts = np.flatnonzero(word & (edge[:-1] | np.concatenate([[True], ~word[:-1]])))
    ends = np.flatnonzero(word & (edge[1:] | np.concatenate([~word[1:], [True]]))) + 1
    up, down = _powers(max(12, int(len(data)).bit_length()))
    h = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE[data] * up[: len(data)], dtype=np.uint64)])
    w = mix((h[ends] - h[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    first = np.searchsorted(starts, offsets)
    each = np.diff(first)
    count = np.where(each >= words, each - words + 1, np.minimum(each, 1))
    out = np.concatenate([[0], np.cumsum(count)])
    begin = np.repeat(first[:-1] - out[:-1], count) + np.arange(out[-1])
    length = np.minimum(np.repeat(each, count), words)
    sums = length.astype(np.uint64)
    w = np.concatenate([w, np.zeros(words, np.uint64)])
    for k in range(words):
        sums = sums + np.where(length > k, w[begin + k] * PLACE[k], U(0))
    return mix(sums), out.astype(np.int64)


def signatures(hashes: np.ndarray, offsets: np.ndarray, n: int, seed: int = 11) -> np.ndarray:
    """MinHash values, uint32 [texts, n]; texts without shingles have the largest value throughout."""
    r = np.random.default_rng(seed)
    factor = r.integers(1, 1 << 63, n, dtype=np.uint64) | U(1)
    add = r.integers(0, 1 << 63, n, dtype=np.uint64)
    there = np.flatnonzero(np.diff(offsets))
    out = np.full((len(offsets) - 1, n), 0xFFFFFFFF, np.uint32)
    if there.size:
        at = offsets[there]
        for k in range(n):
            out[there, k] = np.minimum.reduceat(((hashes * factor[k] + add[k]) >> U(32)).astype(np.uint32), at)
    return out
