"""Vectorised word and shingle hashes of whole texts, by numpy over Arrow buffers.

Words are runs of bytes other than 0x20 and 0x09-0x0D; A-Z count as a-z. A word's hash is a chain of a mixer over its bytes,
eight at a time, so that no sum of bytes or of their places decides it. A hash is a name, not a proof: who hands one word's
result to another compares their bytes with ``same_bytes``. Texts of any length are taken whole.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U = np.uint64
SHORT = 64
LANES = (0x2545F4914F6CDD1D, 0x8BB84B93962EACC9)


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing steps of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, nulls as empty, and where each row starts and the last ends."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    starts = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    return data[starts[0] : starts[-1]], starts - starts[0]


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all words; none crosses a row's end."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = (data != 32) & ((data < 9) | (data > 13))
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | edge[1:-1]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | edge[1:-1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def lower(data: np.ndarray) -> np.ndarray:
    return data + (((data >= 65) & (data <= 90)) * np.uint8(32))


def loads(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of ``data`` on as one number; zeros follow its end."""
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))


MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    """A 64-bit hash of each word; ``data`` is lower-cased already where case is not to count.

    Words of up to ``SHORT`` bytes go through the mixer eight bytes at a time; longer ones get their xxh3. Lanes are independent.
    """
    size = ends - starts
    out = mix(size.astype(np.uint64) * U(0xC2B2AE3D27D4EB4F) + U(LANES[lane]))
    eight = loads(data)
    own = np.flatnonzero((size > 0) & (size <= SHORT))
    at = 0
    while len(own):
        left = np.minimum(size[own] - at, 8)
        out[own] = mix((out[own] ^ (eight[starts[own] + at] & MASKS[left])) * U(0x9E3779B97F4A7C15) + U(LANES[lane]))
        at += 8
        own = own[size[own] > at]
    for k in np.flatnonzero(size > SHORT).tolist():
        out[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]].tobytes(), LANES[lane])
    return out


def same_bytes(one: np.ndarray, at: np.ndarray, two: np.ndarray, to: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether ``size`` bytes of ``one`` from ``at`` on equal those of ``two`` from ``to`` on, pair by pair."""
    a, b = loads(one), loads(two)
    out = np.ones(len(at), dtype=bool)
    own, k = np.flatnonzero(size > 0), 0
    while len(own):
        mask = MASKS[np.minimum(size[own] - k, 8)]
        out[own] = (a[at[own] + k] & mask) == (b[to[own] + k] & mask)
        k += 8
        own = own[out[own] & (size[own] > k)]
    return out


def text_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, word starts, word ends, word hashes, first word of each row and the end)."""
    data, offsets = buffers(column)
    data = lower(data)
    starts, ends = spans(data, offsets)
    return data, starts, ends, word_hashes(data, starts, ends), np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, first: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its runs of ``width`` words; shorter rows are one run."""
    n = len(hashes)
    full = np.zeros(0, np.uint64)
    if n >= width:
        full = np.zeros(n - width + 1, dtype=np.uint64)
        for k in range(width):
            full = full * U(0x9FB21C651E98DF25) + hashes[k : n - width + 1 + k]
            full ^= full >> U(29)
        full = mix(full)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            own = np.sort(full[a : b - width + 1])
            keep = np.ones(len(own), dtype=bool)
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            out.append(own[keep])
        elif b > a:
            own = np.full(1, (b - a) * 0x165667B19E3779F9 & (1 << 64) - 1, dtype=np.uint64)
            for k in range(a, b):
                own = mix((own ^ hashes[k : k + 1]) * U(0x9FB21C651E98DF25))
            out.append(own)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def release() -> None:
    """Give freed memory back to the system: a worker process lives on, and its next task may be another operator's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` over a task's batches, with its memory given back at the end."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return whole


def tidy_group(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """The same for a group."""

    def whole(table: pa.Table) -> pa.Table:
        out = run(table)
        del table
        release()
        return out

    return whole


def slices(batch: pa.RecordBatch, text: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about ``limit`` bytes of text, or one row."""
    column = batch.column(text)
    sizes = np.asarray(pc.binary_length(column.cast(pa.large_binary())).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    upto = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        base = upto[at] - sizes[at]
        to = max(at + 1, int(np.searchsorted(upto, base + limit, "right")))
        yield batch.slice(at, to - at)
        at = to
