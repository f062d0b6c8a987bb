"""Hashed word shingles of whole Arrow batches of texts, vectorised over bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WIDTH = 5

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
#: Odd multipliers, one a place in the shingle.
_PLACES = np.array([pow(_BASE, 3 + 2 * k, 2**64) | 1 for k in range(WIDTH + 1)], dtype=np.uint64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _POWERS[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words in ``data`` (bytes) and where they start."""
    word = ~_SPACE[data]
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    if len(data) and word[0]:
        edge = np.concatenate(([0], edge))
    if len(edge) % 2:
        edge = np.concatenate((edge, [len(data)]))
    starts, ends = edge[0::2], edge[1::2]
    values = (_LOWER[data].astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(data))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(values, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _powers(_INVERSE, len(data) + 1)[starts]), starts


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes, each followed by a line end, and where each text starts (plus the end)."""
    large = lambda x: pa.scalar(x, pa.large_binary())
    joined = pc.binary_join_element_wise(pc.fill_null(column.cast(pa.large_binary()), large(b"")), large(b""), large(b"\n"))
    joined = joined.combine_chunks() if isinstance(joined, pa.ChunkedArray) else joined
    _, offsets, data = joined.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[joined.offset : joined.offset + len(joined) + 1]
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data else np.zeros(0, np.uint8), at - at[0]


#: Bytes hashed at once (some 60 bytes of temporaries each); a longer text is hashed alone.
STEP = 1 << 20


def shingle_sets(column: pa.Array):
    """Yields, per text, the sorted distinct 64-bit hashes of its shingles (uint64).

    Fewer than WIDTH words: the whole sequence is one shingle; no words: an empty set.
    """
    data, at = text_bytes(column)
    n, first = len(at) - 1, 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + STEP, "right")) - 1)
        last = min(last, n)
        part, bounds = data[at[first] : at[last]], at[first : last + 1] - at[first]
        words, starts = word_hashes(part)
        begin = np.searchsorted(starts, bounds)
        if len(words) >= WIDTH:
            rolled = words[: len(words) - WIDTH + 1] * _PLACES[0]
            for k in range(1, WIDTH):
                rolled += words[k : len(words) - WIDTH + 1 + k] * _PLACES[k]
            rolled = mix(rolled)
        for i in range(last - first):
            a, b = int(begin[i]), int(begin[i + 1])
            if b - a >= WIDTH:
                found = np.sort(rolled[a : b - WIDTH + 1])
                keep = np.empty(len(found), dtype=bool)
                keep[0] = True
                np.not_equal(found[1:], found[:-1], out=keep[1:])
                yield found[keep]
            elif b > a:
                count = np.array([b - a], dtype=np.uint64)
                yield mix((words[a:b] * _PLACES[: b - a]).sum(dtype=np.uint64, keepdims=True) + count * _PLACES[WIDTH])
            else:
                yield np.zeros(0, dtype=np.uint64)
        first = last
