"""Vectorised byte-level text: Arrow string columns to words, word hashes and shingles.

Words are maximal runs of [0-9a-z] and non-ASCII characters after lower-casing A-Z; every byte of a
non-ASCII character is 0x80 or more, so working on UTF-8 bytes gives the same words as on code points.
"""

from __future__ import annotations

import ctypes
import functools
import gc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RNG = np.random.default_rng(20240229)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True
_TABLE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_POWERS = np.ones(1, np.uint64)
_INVERSE = np.ones(1, np.uint64)


def _grow(n: int) -> None:
    global _POWERS, _INVERSE
    if len(_POWERS) < n:
        size = max(n, 1 << 16)
        for base, name in ((_BASE, "_POWERS"), (pow(_BASE, -1, 2**64), "_INVERSE")):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            globals()[name] = np.cumprod(steps, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the word."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def slices(column: pa.Array, limit: int = 1 << 19):
    """Yield (lo, hi, bytes, offsets) of consecutive rows of about `limit` bytes, at least one row; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    raw = column.buffers()
    offsets = np.frombuffer(raw[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None and raw[2].size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of True that do not cross rows, and each row's first run."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    last = offsets[1:]
    after[last[last > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes, the same wherever the span stands."""
    _grow(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * _POWERS[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * _INVERSE[starts])


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and each row's first word."""
    low = LOWER[data]
    starts, ends, first = spans(WORD[low], offsets)
    return hash_spans(low, starts, ends), first


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of k words, and each row's first; a row of fewer words, but not none, has one of all its words."""
    counts = np.diff(first)
    per = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    begin = np.concatenate(([0], np.cumsum(per)))
    out = np.zeros(begin[-1], np.uint64)
    if len(hashes) >= k:
        full = np.zeros(len(hashes) - k + 1, np.uint64)
        for j in range(k):
            full += hashes[j : len(hashes) - k + 1 + j] * _ODD[j]
        position = np.arange(begin[-1]) - np.repeat(begin[:-1] - first[:-1], per)
        long = np.repeat(counts >= k, per)
        out[long] = full[position[long]]
    for n in range(1, k):
        rows = np.flatnonzero(counts == n)
        for j in range(n):
            out[begin[rows]] += hashes[first[rows] + j] * _ODD[j]
        out[begin[rows]] += _ODD[63:] * np.uint64(n)
    return mix(out), begin


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of all ranges [start, start + length), one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    return np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(total)


def release() -> None:
    """Give memory back to the system, also that of the powers: an idle Python worker stays alive between tasks, and there can be more than cores."""
    global _POWERS, _INVERSE
    _POWERS, _INVERSE = _POWERS[:1].copy(), _INVERSE[:1].copy()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def frugal(run):
    """A function over batches that releases memory when its partition ends."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped
