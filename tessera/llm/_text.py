"""Vectorised text kernels over Arrow buffers, shared by the operators of this package.

A *word* is a maximal run of bytes outside space and TAB..CR; in UTF-8 that is the same as
``[^\\x20\\x09-\\x0D]+`` over code points, because no multi-byte sequence holds such a byte.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a kernel handles at once. Longer single rows are handled alone and whole.
PIECE_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_U = np.uint64
_BYTE_KEYS = np.random.default_rng(0x5EED).integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)
_STEP = 0x9E3779B97F4A7C15
_UNSTEP = pow(_STEP, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column and its row offsets, from 0; nulls count as empty."""
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batches: Iterable[pa.RecordBatch], column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold at most ``limit`` bytes of ``column``, or one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, start = np.cumsum(sizes), 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def release() -> None:
    """Gives freed memory back to the system: a Python worker outlives its tasks, and what they freed stays its own otherwise."""
    if len(_powers[0]) > 2 * PIECE_BYTES:
        _powers[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # other C libraries than glibc have none
        trim(0)


def lean(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, with a release() when a task ends."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return task


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and for each row the index of its first word (one entry more than rows)."""
    inside = ~SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    lo, hi = offsets[:-1], offsets[1:]
    full = hi > lo
    first[lo[full]] = inside[lo[full]]
    last[hi[full] - 1] = inside[hi[full] - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit integers."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_STEP, _UNSTEP)):
            grown = np.full(size, base, np.uint64)
            grown[0] = 1
            _powers[k] = np.multiply.accumulate(grown)
    return _powers[0], _powers[1]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte spans; equal spans have equal hashes wherever they stand."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _power(len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE_KEYS[data] * up[: len(data)], out=sums[1:])
    raw = (sums[ends] - sums[starts]) * down[starts]
    return mix(raw ^ ((ends - starts).astype(np.uint64) * _U(0xD6E8FEB86659FD93)) ^ _U(seed * 0xA24BAED4963EE407 & (2**64 - 1)))


_SHINGLE_KEYS = np.random.default_rng(0x51).integers(1, 1 << 63, 64, dtype=np.uint64) | _U(1)


def windows(hashes: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``width`` consecutive words inside a row, and their bounds by row."""
    counts = np.diff(bounds)
    if len(hashes) < width:
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    size = len(hashes) - width + 1
    total = np.zeros(size, np.uint64)
    for k in range(width):
        total += hashes[k : k + size] * _SHINGLE_KEYS[k]
    inside = np.zeros(len(hashes) + 1, np.int64)
    good = counts >= width
    np.add.at(inside, bounds[:-1][good], 1)
    np.add.at(inside, bounds[1:][good] - width + 1, -1)
    keep = np.cumsum(inside)[:size] > 0
    return mix(total[keep]), np.concatenate([[0], np.cumsum(np.maximum(counts - width + 1, 0))])


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its ``width``-word windows; a shorter row has its whole sequence as one, a row without words none."""
    data = LOWER[data]
    starts, ends, bounds = words(data, offsets)
    hashes = span_hashes(data, starts, ends)
    grams, at = windows(hashes, bounds, width)
    out = []
    for row in range(len(offsets) - 1):
        n = bounds[row + 1] - bounds[row]
        if n >= width:
            out.append(_distinct(grams[at[row] : at[row + 1]]))
        elif n:
            whole = (hashes[bounds[row] : bounds[row + 1]] * _SHINGLE_KEYS[32 : 32 + n]).sum(dtype=np.uint64) + _U(n)
            out.append(mix(np.array([whole], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    keep = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=keep[1:])
    return values[keep]


def ragged(offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Element positions of the given rows of a ragged array, one after another, and the new offsets."""
    lengths = offsets[rows + 1] - offsets[rows]
    ends = np.concatenate([[0], np.cumsum(lengths)])
    return np.repeat(offsets[rows] - ends[:-1], lengths) + np.arange(ends[-1]), ends


def pack48(values: np.ndarray) -> bytes:
    """The upper 48 bits of 64-bit hashes."""
    return np.ascontiguousarray(values.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes()


def unpack48(data: np.ndarray) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, 2:] = data.reshape(-1, 6)
    return out.reshape(-1).view("<u8")


def buckets(values: np.ndarray, n: int) -> np.ndarray:
    """A bucket below ``n`` from the 16 low bits, which pack48() leaves out (and the 16 next, where there are many buckets)."""
    low = values & _U(0xFFFFFFFF)
    spread = ((low & _U(0xFFFF)) << _U(16)) | (low >> _U(16))
    return ((spread * _U(n)) >> _U(32)).astype(np.int64)


_CODEC = pa.Codec("zstd", 1)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers as bytes: integers in the smallest type that holds them, whatever their size; byte by byte of all numbers, compressed."""
    out = [len(arrays).to_bytes(1, "little")]
    for a in arrays:
        if a.dtype.kind in "iu":
            low, high = (int(a.min()), int(a.max())) if len(a) else (0, 0)
            a = a.astype(np.promote_types(np.min_scalar_type(low), np.min_scalar_type(high)) if low < 0 else np.min_scalar_type(high))
        planes = np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes()
        body = _CODEC.compress(planes, asbytes=True) if planes else b""
        out += [a.dtype.str.encode(), len(a).to_bytes(8, "little"), len(body).to_bytes(8, "little"), body]
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    """Inverse of pack()."""
    out, at = [], 1
    for _ in range(data[0]):
        kind, count, size = np.dtype(data[at : at + 3].decode()), int.from_bytes(data[at + 3 : at + 11], "little"), int.from_bytes(data[at + 11 : at + 19], "little")
        at += 19
        planes = _CODEC.decompress(data[at : at + size], count * kind.itemsize, asbytes=True) if count else b""
        out.append(np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(kind.itemsize, -1).T).view(kind).reshape(-1))
        at += size
    return out
