"""Runs of bytes of one class (words) in whole texts, block by block, so that a text of any length needs bounded memory."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Lower-cases A-Z and nothing else.
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32


def byte_class(chars: bytes, high: bool, negated: bool = False) -> np.ndarray:
    """Which bytes belong to a class: those given, and all bytes of characters beyond ASCII if `high`."""
    inside = np.zeros(256, bool)
    inside[list(chars)] = True
    if negated:
        inside[:128] = ~inside[:128]
    inside[128:] = high
    return inside


def blocks(data: np.ndarray, inside: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Spans of about `limit` bytes that end behind a byte outside the class, so no run is cut; a longer run is whole."""
    lo, n = 0, len(data)
    while lo < n:
        hi = min(lo + limit, n)
        while hi < n:
            outside = np.flatnonzero(~inside[data[lo:hi]])
            if outside.size:
                hi = lo + int(outside[-1]) + 1
                break
            hi = min(hi + limit, n)
        yield lo, hi
        lo = hi


def runs(data: np.ndarray, offsets: np.ndarray, lo: int, hi: int, inside: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All maximal runs of the class between two positions, A-Z lower-cased, and where they start. The borders of texts
    (`offsets`) end runs."""
    part = data[lo:hi]
    mask = inside[part]
    begins = mask.copy()
    begins[1:] &= ~mask[:-1]
    texts = offsets[np.searchsorted(offsets, lo) : np.searchsorted(offsets, hi)] - lo
    begins[texts] = mask[texts]
    starts = np.flatnonzero(begins)
    body = LOWERED[part[mask]]
    ends = np.append(np.cumsum(mask)[starts] - 1, len(body)).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(body)), starts + lo


def text_of(offsets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The text in which each position lies."""
    return np.searchsorted(offsets, starts, side="right") - 1


_VALUE = np.random.default_rng(777).integers(0, 1 << 64, 257, np.uint64)


def string_hashes(strings: pa.Array) -> np.ndarray:
    """64-bit hashes of large strings without nulls."""
    offsets = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]
    sizes, out = np.diff(offsets), np.zeros(len(strings), np.uint64)
    some = np.flatnonzero(sizes)
    if some.size:
        data = np.frombuffer(strings.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        starts, powers = offsets[:-1][some] - offsets[0], np.full(int(sizes.max()), _VALUE[256] | np.uint64(1))
        powers[0] = 1
        powers = np.multiply.accumulate(powers)
        out[some] = np.add.reduceat(_VALUE[data] * powers[np.arange(len(data)) - np.repeat(starts, sizes[some])], starts)
    out = (out ^ (out >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return out ^ (out >> np.uint64(29))
