"""Whole batches of texts as numpy arrays: words, their hashes and shingles, without a loop over words."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer text is cut between words, never dropped. Arrays of some 30 times that stand
#: beside it.
CHUNK = 1 << 18

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = np.zeros(256, dtype=bool)
_GAP[[0x20, 9, 10, 11, 12, 13]] = True


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit integers in which every bit of ``x`` reaches every bit of the result (splitmix64)."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_BYTE = mix64(np.arange(256, dtype=np.uint64), 17) | np.uint64(1)
_BYTE[_GAP] = 0
_POWERS = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        with np.errstate(over="ignore"):
            _POWERS = np.cumprod(np.concatenate([[1], np.full(max(n, 4096) - 1, 0x100000001B3)]).astype(np.uint64), dtype=np.uint64)
    return _POWERS


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and where each row starts, then the end. A null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary() if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else pa.large_string())
    if texts.null_count:
        texts = texts.fill_null(b"" if pa.types.is_large_binary(texts.type) else "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def parts(at: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows with up to ``limit`` bytes, or one row."""
    first, n = 0, len(at) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, side="right")) - 1)
        yield first, last
        first = last


def lean(run: Callable) -> Callable:
    """``run`` over batches; afterwards the worker, which stays beside the tasks of later stages, gives back the memory that its
    allocators keep."""

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(AttributeError, OSError):  # glibc alone has it
                ctypes.CDLL(None).malloc_trim(0)

    return held


def _hash_chunk(raw: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of ``raw`` and where each starts; a word ends at a gap or at one of ``cuts``."""
    low = _LOWER[raw]
    word = ~_GAP[low]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    cuts = cuts[cuts < len(raw)]
    begins[cuts] = word[cuts]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    run = np.diff(np.append(starts, len(raw)))
    place = np.arange(starts[0], len(raw)) - np.repeat(starts, run)
    with np.errstate(over="ignore"):
        values = _BYTE[low[starts[0] :]] * _powers(int(run.max()))[place]
        return mix64(np.add.reduceat(values, starts - starts[0])), starts


def words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z in lower case) and where each row's words start, then the end."""
    hashes, starts, pos, end = [], [], 0, len(raw)
    while pos < end:
        stop = min(end, pos + CHUNK)
        while stop < end and not _GAP[raw[stop]] and at[min(np.searchsorted(at, stop), len(at) - 1)] != stop:
            gaps = np.flatnonzero(_GAP[raw[stop : stop + 65536]])
            nearest = at[np.searchsorted(at, stop)]
            stop = min(int(nearest), stop + int(gaps[0]) if len(gaps) else min(end, stop + 65536))
        low, high = np.searchsorted(at, [pos, stop])
        h, s = _hash_chunk(raw[pos:stop], at[low:high] - pos)
        hashes.append(h)
        starts.append(s + pos)
        pos = stop
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), at)


def shingles(hashes: np.ndarray, at: np.ndarray, size: int) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its shingles; a row with fewer words has its whole sequence as one."""
    n = len(hashes)
    out = []
    with np.errstate(over="ignore"):
        k = np.uint64(0xD6E8FEB86659FD93)
        rolled = np.zeros(max(0, n - size + 1), np.uint64)
        for j in range(size if len(rolled) else 0):
            rolled = rolled * k + hashes[j : j + len(rolled)]
        rolled = mix64(rolled, size)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a >= size:
                x = np.sort(rolled[a : b - size + 1])
                keep = np.empty(len(x), bool)
                keep[0] = True
                np.not_equal(x[1:], x[:-1], out=keep[1:])
                out.append(x[keep])
            elif b > a:
                x = np.zeros(1, np.uint64)
                for j in range(a, b):
                    x = x * k + hashes[j]
                out.append(mix64(x, b - a))
            else:
                out.append(np.zeros(0, np.uint64))
    return out
