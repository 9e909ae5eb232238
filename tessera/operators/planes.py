"""Operators over whole planes: pyramids, edges, sub-sample positions, motion, seams and estimates.

A plane is one array in one row. The kernels are NumPy over Arrow batches, map-only; where a plane meets its predecessor, a window over
its stream brings the two together, so only whole planes are shuffled, once. Integers are 64 bits wide here; shifts floor.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The taps of the quarter-sample filter of luma and of the eighth-sample filter of chroma, by fraction.
LUMA_TAPS = np.array([[0, 8, 0, 0], [-1, 7, 2, 0], [-1, 5, 5, -1], [0, 2, 7, -1]])
CHROMA_TAPS = np.array([[0, 8, 0, 0], [-1, 8, 2, -1], [-1, 7, 3, -1], [-1, 6, 4, -1], [-1, 5, 5, -1], [-1, 4, 6, -1], [-1, 3, 7, -1], [-1, 2, 8, -1]])
#: Rows of a batch that a kernel handles at once.
ROWS = 512


def array(column: pa.Array, *shape: int) -> np.ndarray:
    """A list column of equal lengths as (rows, *shape)."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), *shape)


def lists(values: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """(rows, ...) as a list column."""
    flat = values.reshape(len(values), -1)
    offsets = np.arange(len(values) + 1, dtype=np.int32) * flat.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.reshape(-1), kind or pa.int64()))


def mapped(df: DataFrame, schema: str, kernel: Callable[[pa.RecordBatch], list[pa.Array]]) -> DataFrame:
    """``kernel`` over slices of the rows; it returns the columns of ``schema``."""
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                yield pa.RecordBatch.from_arrays(kernel(batch.slice(lo, ROWS)), names)

    return df.mapInArrow(run, schema)


def assemble(blocks: DataFrame, across: int = 4, side: int = 8) -> DataFrame:
    """(plane, coef): every ``across`` squared blocks beside each other; missing ones are zero."""
    many = across * across
    parts = blocks.groupBy(F.expr(f"frame div {many}").alias("plane")).agg(F.collect_list(F.struct((F.col("frame") % many).cast("int").alias("k"), "coef")).alias("parts"))

    def kernel(batch: pa.RecordBatch) -> list[pa.Array]:
        out = np.zeros((batch.num_rows, across, side, across, side), np.int64)
        column = batch.column("parts")
        flat, lengths = column.flatten(), np.diff(column.offsets.to_numpy())
        where, k = np.repeat(np.arange(batch.num_rows), lengths), flat.field("k").to_numpy()
        out[where, k // across, :, k % across] = array(flat.field("coef"), side, side)
        return [batch.column("plane"), lists(out)]

    return mapped(parts, "plane long, coef array<long>", kernel)


def with_before(planes: DataFrame, stream: int = 8) -> DataFrame:
    """Adds the plane before, in streams of ``stream`` planes."""
    return planes.withColumn("before", F.lag("coef").over(W.partitionBy(F.expr(f"plane div {stream}")).orderBy("plane")))


# Transforms


def lift(a: np.ndarray) -> np.ndarray:
    """5/3 lifting of the last axis, with alternating rounding: the low band, then the high band."""
    even, odd = a[..., ::2], a[..., 1::2]
    at = np.arange(odd.shape[-1])
    high = odd - ((even + even[..., np.minimum(at + 1, len(at) - 1)] + at % 2) >> 1)
    return np.concatenate([even + ((high[..., np.maximum(at - 1, 0)] + high + 1 + at % 2) >> 2), high], -1)


def unlift(bands: np.ndarray) -> np.ndarray:
    half = bands.shape[-1] // 2
    low, high, at = bands[..., :half], bands[..., half:], np.arange(half)
    even = low - ((high[..., np.maximum(at - 1, 0)] + high + 1 + at % 2) >> 2)
    odd = high + ((even + even[..., np.minimum(at + 1, half - 1)] + at % 2) >> 1)
    return np.stack([even, odd], -1).reshape(bands.shape)


def forward(x: np.ndarray) -> np.ndarray:
    """Rows, then columns."""
    return lift(lift(x).swapaxes(-1, -2)).swapaxes(-1, -2)


def inverse(x: np.ndarray) -> np.ndarray:
    return unlift(unlift(x.swapaxes(-1, -2)).swapaxes(-1, -2))


def layers(planes: DataFrame, side: int = 32) -> DataFrame:
    """(plane, layer0, layer1, layer2): the low band of the low band, and the high bands of both transforms, with zeros for the low one."""

    def kernel(batch: pa.RecordBatch) -> list[pa.Array]:
        fine = forward(array(batch.column("coef"), side, side))
        middle = forward(fine[:, : side // 2, : side // 2])
        base = middle[:, : side // 4, : side // 4].copy()
        fine[:, : side // 2, : side // 2] = 0
        middle[:, : side // 4, : side // 4] = 0
        return [batch.column("plane"), lists(base), lists(middle), lists(fine)]

    return mapped(planes, "plane long, layer0 array<long>, layer1 array<long>, layer2 array<long>", kernel)


def rebuild(packets: DataFrame, side: int = 32) -> DataFrame:
    """(plane, side, coef) from (plane, highest, layer0, layer1, layer2): each next layer counts if ``highest`` allows it and it is there."""

    def kernel(batch: pa.RecordBatch) -> list[pa.Array]:
        sides, out = [], []
        for highest, *parts in zip(*(batch.column(c).to_pylist() for c in ("highest", "layer0", "layer1", "layer2")), strict=True):
            at, size = np.array(parts[0]).reshape(side // 4, side // 4), side // 4
            for n in (1, 2):
                if highest < n or parts[n] is None:
                    break
                size *= 2
                band = np.array(parts[n]).reshape(size, size)
                band[: size // 2, : size // 2] = at
                at = inverse(band)
            sides.append(size)
            out.append(at.reshape(-1).tolist())
        return [batch.column("plane"), pa.array(sides, pa.int32()), pa.array(out, pa.list_(pa.int64()))]

    return mapped(packets, "plane long, side int, coef array<long>", kernel)


# Edges


def replicated(at: np.ndarray, size: int) -> np.ndarray:
    """Coordinates beyond an edge are the edge's."""
    return np.clip(at, 0, size - 1)


def mirrored(at: np.ndarray, size: int) -> np.ndarray:
    """Coordinates beyond an edge are mirrored: the low edge's own sample counts once, the high edge's twice; what is still outside is the edge's."""
    return np.clip(np.where(at >= size, 2 * size - 1 - at, np.abs(at)), 0, size - 1)


def read_blocks(planes: DataFrame, starts: list[int], block: int = 8, side: int = 32, rule: Callable[[np.ndarray, int], np.ndarray] = replicated) -> DataFrame:
    """(plane, row, col, coef): blocks from every pair of starts, which may lie outside."""
    at = rule(np.array(starts)[:, None] + np.arange(block), side)

    def kernel(batch: pa.RecordBatch) -> list[pa.Array]:
        x = array(batch.column("coef"), side, side)
        found = x[:, at[:, None, :, None], at[None, :, None, :]]
        rows, cols = (np.tile(v.reshape(-1), len(x)) for v in np.meshgrid(starts, starts, indexing="ij"))
        return [pa.array(np.repeat(batch.column("plane").to_numpy(), len(starts) ** 2)), pa.array(rows, pa.int32()), pa.array(cols, pa.int32()), lists(found.reshape(-1, block * block))]

    return mapped(planes, "plane long, row int, col int, coef array<long>", kernel)


def write_blocks(blocks: DataFrame, width: int, height: int, block: int = 8) -> DataFrame:
    """(plane, coef) of blocks at (row, col); what lies outside is cropped."""
    parts = blocks.groupBy("plane").agg(F.collect_list(F.struct("row", "col", "coef")).alias("parts"))

    def kernel(batch: pa.RecordBatch) -> list[pa.Array]:
        out = np.zeros((batch.num_rows, height, width), np.int64)
        for k, placed in enumerate(batch.column("parts").to_pylist()):
            for p in placed:
                down, right = min(block, height - p["row"]), min(block, width - p["col"])
                if down > 0 and right > 0:
                    out[k, p["row"] : p["row"] + down, p["col"] : p["col"] + right] = np.array(p["coef"]).reshape(block, block)[:down, :right]
        return [batch.column("plane"), lists(out)]

    return mapped(parts, "plane long, coef array<long>", kernel)


# Positions between samples, and motion


def taken(x: np.ndarray, down: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Samples at the given rows and columns of each plane, by the edge's where these lie outside."""
    height, width = x.shape[1:]
    return x[np.arange(len(x)).reshape(-1, *[1] * (down.ndim - 1)), replicated(down, height), replicated(right, width)]


def half_samples(x: np.ndarray, fx: np.ndarray, fy: np.ndarray, rounding: np.ndarray) -> np.ndarray:
    """Means of neighbours, half a sample on where ``fx`` or ``fy`` is 1."""
    y, z = np.indices(x.shape[1:])
    fx, fy, rounding = (np.asarray(v).reshape(-1, 1, 1) for v in (fx, fy, rounding))
    a, b, c, d = taken(x, y + 0 * fy, z + 0 * fx), taken(x, y + 0 * fy, z + fx), taken(x, y + fy, z + 0 * fx), taken(x, y + fy, z + fx)
    one, four = (a + np.where(fy == 0, b, c) + rounding) >> 1, (a + b + c + d + 1 + rounding) >> 2
    return np.where((fx == 0) & (fy == 0), a, np.where((fx == 1) & (fy == 1), four, one))


def quarter_samples(x: np.ndarray, rx: np.ndarray, ry: np.ndarray, rounding: np.ndarray) -> np.ndarray:
    """Bilinear, ``rx`` and ``ry`` quarters of a sample on."""
    y, z = np.indices(x.shape[1:])
    rx, ry, rounding = (np.asarray(v).reshape(-1, 1, 1) for v in (rx, ry, rounding))
    at = lambda j, i: taken(x, y + j * (ry > 0), z + i * (rx > 0))
    whole = (4 - rx) * (4 - ry) * at(0, 0) + rx * (4 - ry) * at(0, 1) + (4 - rx) * ry * at(1, 0) + rx * ry * at(1, 1)
    return np.where((rx == 0) & (ry == 0), at(0, 0), (whole + 7 + rounding) >> 4)


def predicted(before: np.ndarray, dx: np.ndarray, dy: np.ndarray, rounding: np.ndarray, taps: np.ndarray) -> np.ndarray:
    """The motion-compensated plane: a separable filter of four taps at each sample's displacement, in fractions of a sample."""
    bits = int(len(taps)).bit_length() - 1
    y, x = np.indices(before.shape[1:])
    cx, cy = taps[dx & (len(taps) - 1)], taps[dy & (len(taps) - 1)]
    total = np.zeros(before.shape, np.int64)
    for j in range(4):
        for i in range(4):
            total += cy[..., j] * cx[..., i] * taken(before, y + (dy >> bits) + j - 1, x + (dx >> bits) + i - 1)
    return (total + 31 + rounding.reshape(-1, 1, 1)) >> 6


def spread(vectors: np.ndarray, side: int, block: int) -> np.ndarray:
    """Each sample's vector from those of its block; blocks beyond the last vector have that one."""
    across = side // block
    y, x = np.indices((side, side))
    return vectors[:, np.minimum(y // block * across + x // block, vectors.shape[1] - 1)]


def compensate(planes: DataFrame, block: int, side: int, taps: np.ndarray) -> DataFrame:
    """(plane, residual, back) of (plane, coef, before, dx, dy, rounding): what motion leaves over, and the plane from it again."""

    def kernel(batch: pa.RecordBatch) -> list[pa.Array]:
        now, before = array(batch.column("coef"), side, side), array(batch.column("before"), side, side)
        guess = predicted(before, spread(array(batch.column("dx"), -1), side, block), spread(array(batch.column("dy"), -1), side, block), batch.column("rounding").to_numpy(), taps)
        return [batch.column("plane"), lists(now - guess), lists(now - guess + guess)]

    return mapped(planes, "plane long, residual array<long>, back array<long>", kernel)


def sparse_difference(now: np.ndarray, before: np.ndarray, dx: np.ndarray, dy: np.ndarray) -> np.ndarray:
    """Sum of absolute differences at a displacement, of every eighth row and second column."""
    full = lambda v: np.broadcast_to(np.asarray(v).reshape(-1, 1, 1), now.shape)
    return np.abs(now - predicted(before, full(dx), full(dy), np.zeros(len(now), np.int64), LUMA_TAPS))[:, ::8, ::2].sum((1, 2))


def chroma_difference(now: list[np.ndarray], before: list[np.ndarray], row: np.ndarray, col: np.ndarray, dx: np.ndarray, dy: np.ndarray) -> np.ndarray:
    """Four times the difference of 4x4 blocks of both chroma planes at half a whole displacement; 1000 where a block lies outside."""
    height, width = now[0].shape[1:]
    y, x = np.indices((4, 4))
    top, left = (v.reshape(-1, 1, 1) for v in (row, col))
    down, right = top + (dy.reshape(-1, 1, 1) >> 1), left + (dx.reshape(-1, 1, 1) >> 1)
    inside = lambda a, b: ((a >= 0) & (b >= 0) & (a + 4 <= height) & (b + 4 <= width)).reshape(-1)
    total = sum(np.abs(taken(a, top + y, left + x) - taken(b, down + y, right + x)).sum((1, 2)) for a, b in zip(now, before, strict=True))
    return np.where(inside(top, left) & inside(down, right), total * 4, 1000)


def probe_difference(now: np.ndarray, before: np.ndarray, block: int) -> np.ndarray:
    """Mean difference of eight blocks, in the corners and in the middles of the edges."""
    far = now.shape[1] - block
    places = [(y, x) for y in (0, far // 2, far) for x in (0, far // 2, far) if (y, x) != (far // 2, far // 2)]
    error = np.abs(now - before)
    return sum(error[:, y : y + block, x : x + block].sum((1, 2)) for y, x in places) // (8 * block * block)


def best_vectors(now: np.ndarray, before: np.ndarray, block: int, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(dx, dy, difference) of each block, out of a whole window; the first of equal offsets, row by row."""
    n, side = len(now), now.shape[1]
    y, x = np.indices((side, side))
    sums = []
    for dy in range(-reach, reach + 1):
        for dx in range(-reach, reach + 1):
            error = np.abs(now - taken(before, np.broadcast_to(y + dy, now.shape), np.broadcast_to(x + dx, now.shape)))
            sums.append(error.reshape(n, side // block, block, side // block, block).sum((2, 4)).reshape(n, -1))
    sums = np.stack(sums)
    best = sums.argmin(0)
    return best % (2 * reach + 1) - reach, best // (2 * reach + 1) - reach, sums.min(0)


def contrast(x: np.ndarray, block: int) -> np.ndarray:
    tiles = x.reshape(len(x), x.shape[1] // block, block, -1, block)
    return (tiles.max((2, 4)) - tiles.min((2, 4))).reshape(len(x), -1)


def motion_field(now: np.ndarray, before: np.ndarray, block: int, reach: int, floor: int = 1024, weight: int = 48) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors in quarters of a sample and their differences; a block whose difference is beyond its contrast's limit, or ``floor``, stands still."""
    dx, dy, error = best_vectors(now, before, block, reach)
    still = error > np.maximum(floor, contrast(now, block) * weight)
    return np.where(still, 0, dx * 4), np.where(still, 0, dy * 4), error


def two_way_field(now: np.ndarray, before: np.ndarray, first: np.ndarray, position: np.ndarray, block: int, reach: int) -> tuple[np.ndarray, ...]:
    """(dx, dy, backward, difference): vectors into the plane before, or into the group's first plane where that is cheaper by more than its penalties, for motion, distance in the group and another contrast. ``position`` counts from the group's first plane."""
    px, py, error = best_vectors(now, before, block, reach)
    nx, ny, other = best_vectors(now, first, block, reach)
    position = position.reshape(-1, 1)
    base = (np.abs(nx) + np.abs(ny)) * 8 + 32 + np.where(other < 384, 0, np.minimum(1024, position * 16))
    odd = np.abs(contrast(now, block) - contrast(first, block))
    cost = other + base + odd * odd // 4
    tried = (np.minimum(1536, 512 + position * 16) <= error) & (other + base < error)
    back = tried & ((cost < error) | ((cost == error) & (nx * nx + ny * ny < px * px + py * py)))
    return np.where(back, nx, px), np.where(back, ny, py), back, error


# Seams


def smooth_seams(x: np.ndarray, intra: np.ndarray, block: int, limits: tuple[int, int], intra_limits: tuple[int, int]) -> np.ndarray:
    """Moves the samples beside the seams of blocks together where the step is small and both sides are flat: upright seams first, then level ones on the result. ``intra`` marks blocks whose seams have the wider limits."""
    out, across = x.copy(), x.shape[2] // block
    marks = intra.reshape(len(x), -1, across)
    for turn in range(2):
        view, flags = (out, marks) if turn == 0 else (out.swapaxes(1, 2), marks.swapaxes(1, 2))
        for k in range(1, view.shape[2] // block):
            at = k * block
            p1, p0, q0, q1 = (view[:, :, at + j].copy() for j in (-2, -1, 0, 1))
            wide = np.repeat(flags[:, :, k - 1] | flags[:, :, k], block, axis=1)
            most, limit = (np.where(wide, b, a) for a, b in zip(limits, intra_limits, strict=True))
            soft = (np.abs(q0 - p0) < limit) & (np.abs(p1 - p0) * 2 < limit) & (np.abs(q1 - q0) * 2 < limit)
            move = np.clip((q0 - p0 + 1) >> 1, -most, most) * soft
            view[:, :, at - 1] = p0 + move
            view[:, :, at] = q0 - move
    return out


def blend_seams(x: np.ndarray, intra: np.ndarray, block: int) -> np.ndarray:
    """Blends the four samples on each side of the seams between an intra block and others with the nearest sample beyond: 7:1, 6:2, 5:3, 4:4. Block by block: its left, right, upper and lower seam."""
    out, across = x.copy(), x.shape[2] // block
    weights = np.array([4, 5, 6, 7])
    for b in range(intra.shape[1]):
        row, col = divmod(b, across)
        for at, other, level in ((col, b - 1, False), (col + 1, b + 1, False), (row, b - across, True), (row + 1, b + across, True)):
            if not 0 < at < across:
                continue
            some = np.flatnonzero(intra[:, b] & ~intra[:, other])
            view = out.swapaxes(1, 2) if level else out
            lines = slice((col if level else row) * block, ((col if level else row) + 1) * block)
            seam = at * block
            low, high = view[some, lines, seam - 4 : seam][..., ::-1], view[some, lines, seam : seam + 4]
            p0, q0 = low[..., :1].copy(), high[..., :1].copy()
            view[some, lines, seam - 4 : seam] = ((low * weights + q0 * (8 - weights)) >> 3)[..., ::-1]
            view[some, lines, seam : seam + 4] = (high * weights + p0 * (8 - weights)) >> 3
    return out


# Estimates


def quantised(x: np.ndarray, steps: tuple[int, int, int], biases: tuple[int, int, int] = (32768, 16384, 8192)) -> np.ndarray:
    """Signed levels of transformed squares: steps and biases of the low, the middle and the high band."""
    half = x.shape[-1] // 2
    down, right = np.indices(x.shape[-2:]) >= half
    kind = down.astype(int) + right
    step, bias = np.array(steps)[kind], np.array(biases)[kind]
    return np.sign(x) * np.maximum(0, (np.abs(x) * (65536 // step) + bias) >> 16)


def median_residuals(x: np.ndarray, carried: np.ndarray | int = 0) -> np.ndarray:
    """Median edge prediction: the first sample from ``carried``, the first row from the left, the first column from above."""
    left, up = np.zeros_like(x), np.zeros_like(x)
    left[..., 1:], up[..., 1:, :] = x[..., :-1], x[..., :-1, :]
    corner = np.zeros_like(x)
    corner[..., 1:, 1:] = x[..., :-1, :-1]
    low, high = np.minimum(left, up), np.maximum(left, up)
    guess = np.where(corner >= high, low, np.where(corner <= low, high, left + up - corner))
    guess[..., 0, :], guess[..., :, 0] = left[..., 0, :], up[..., :, 0]
    guess[..., 0, 0] = carried
    return x - guess


def from_median_residuals(d: np.ndarray, carried: np.ndarray | int = 0) -> np.ndarray:
    """Inverse of median_residuals(), sample by sample over all squares at once."""
    out = np.zeros_like(d)
    for y in range(d.shape[-2]):
        for x in range(d.shape[-1]):
            left, up = (out[..., y, x - 1] if x else 0), (out[..., y - 1, x] if y else 0)
            if y and x:
                corner = out[..., y - 1, x - 1]
                low, high = np.minimum(left, up), np.maximum(left, up)
                guess = np.where(corner >= high, low, np.where(corner <= low, high, left + up - corner))
            else:
                guess = left if x else up if y else carried
            out[..., y, x] = d[..., y, x] + guess
    return out


def rice_bits(values: np.ndarray) -> np.ndarray:
    """Bits of a Rice-like code of 4x4 values: its parameter is the floor of the mean's binary logarithm."""
    total, many = np.abs(values).sum((-1, -2)), values.shape[-1] * values.shape[-2]
    k = np.maximum(0, np.frexp((total // many).astype(float))[1] - 1)
    return (total >> np.maximum(0, k - 1)) + many * (1 + k)


def block_bits(x: np.ndarray, steps: tuple[int, int, int]) -> np.ndarray:
    """Estimated bits of each 8x8 square; 1 where nothing is left."""
    q = quantised(forward(x), steps)
    low, high = q[..., :4, :4], (q[..., :4, 4:], q[..., 4:, :4], q[..., 4:, 4:])
    return np.where((q == 0).all((-1, -2)), 1, 1 + rice_bits(median_residuals(low)) + sum(map(rice_bits, high)))


def initial_step(bits: int, samples: int, of: int, target: int, probe: int = 64, scale: int = 78) -> int:
    """The first step, from the bits of ``samples`` of ``of`` samples at the probing step."""
    return max(1, min(256, probe * (bits * of // samples) * scale // (target * 100)))


# Searched motion

#: Differences below which a search ends: standing still, and after the wide steps; above the third the field before is asked too.
STILL, NEAR, ASK_BEFORE = 32, 64, 512
#: What a half and a quarter of a sample cost, since they blur.
HALF_COST, QUARTER_COST = 16, 4
_WIDE = ((-2, 0), (-1, -1), (-1, 1), (0, -2), (0, 2), (1, -1), (1, 1), (2, 0))
_CLOSE = ((-1, 0), (0, -1), (0, 1), (1, 0))


class _Search:
    """Search of one block's displacement; coordinates beyond an edge are the edge's."""

    def __init__(self, now: np.ndarray, before: np.ndarray, row: int, col: int, block: int, reach: int):
        self.tile, self.before, self.reach = now[row : row + block, col : col + block], before, reach
        self.y, self.x = np.arange(row, row + block)[:, None], np.arange(col, col + block)
        self.known: dict[tuple[int, int], int] = {}

    def error(self, dy: int, dx: int) -> int:
        if (dy, dx) not in self.known:
            height, width = self.before.shape
            self.known[dy, dx] = int(np.abs(self.tile - self.before[np.clip(self.y + dy, 0, height - 1), np.clip(self.x + dx, 0, width - 1)]).sum())
        return self.known[dy, dx]

    def best(self, guess: tuple[int, int]) -> tuple[int, int, int]:
        """(dy, dx, error): from the guess, or from where it stands, two wide steps and as many close ones as help; a displacement costs its distance from the guess."""
        if self.error(0, 0) < STILL:
            return 0, 0, self.error(0, 0)
        bound = lambda v: max(-self.reach, min(self.reach, v))
        guess = bound(guess[0]), bound(guess[1])
        cost = lambda at: self.error(*at) + abs(at[0] - guess[0]) + abs(at[1] - guess[1])
        here = min(((0, 0), guess), key=cost)
        for steps, turns in ((_WIDE, 2), (_CLOSE, 2 * self.reach)):
            if steps is _CLOSE and self.error(*here) < NEAR:
                break
            for _ in range(turns):
                there = min([here, *((bound(here[0] + a), bound(here[1] + b)) for a, b in steps)], key=cost)
                if there == here:
                    break
                here = there
        return *here, self.error(*here)


def between(search: _Search, dy: int, dx: int, error: int) -> tuple[int, int, int]:
    """(dy, dx, error) in quarters of a sample: halves, then quarters around the best one, where they are better by more than they cost."""
    if error < NEAR:
        return 4 * dy, 4 * dx, error
    block = search.tile.shape[0]

    def cost(qy: int, qx: int) -> int:
        height, width = search.before.shape
        y, x = search.y + (qy >> 2), search.x + (qx >> 2)
        ry, rx = qy & 3, qx & 3
        at = lambda j, i: search.before[np.clip(y + j, 0, height - 1), np.clip(x + i, 0, width - 1)]
        whole = (4 - rx) * (4 - ry) * at(0, 0) + rx * (4 - ry) * at(0, 1) + (4 - rx) * ry * at(1, 0) + rx * ry * at(1, 1)
        return int(np.abs(search.tile - ((whole + 7 >> 4) if rx or ry else at(0, 0))).sum())

    here = (4 * dy, 4 * dx, error)
    for size, more in ((2, HALF_COST), (1, QUARTER_COST)):
        around = [(here[0] + a * size, here[1] + b * size) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]
        best = min(((cost(*q) + more * block * block // 64, q) for q in around), key=lambda c: c[0])
        if best[0] < here[2]:
            here = (*best[1], best[0])
    return here


def searched_field(now: np.ndarray, before: np.ndarray, block: int, reach: int, last: np.ndarray | None = None, median: bool = False) -> np.ndarray:
    """(blocks, 3) of dy, dx and error in quarters of a sample, block by block: each search starts from the vector to the left, or with ``median`` from the median of those to the left, above and above to the right; where the error stays large, also from the block's vector in the field before."""
    across = now.shape[1] // block
    out = np.zeros((now.shape[0] // block * across, 3), np.int64)
    for k in range(len(out)):
        row, col = divmod(k, across)
        vector = lambda r, c: out[r * across + c, :2] if 0 <= c < across and r >= 0 else np.zeros(2, np.int64)
        near = [vector(row, col - 1)] + ([vector(row - 1, col), vector(row - 1, col + 1)] if median else [])
        guess = np.median(near, axis=0).astype(np.int64) >> 2
        search = _Search(now, before, row * block, col * block, block, reach)
        found = search.best((int(guess[0]), int(guess[1])))
        if last is not None and found[2] > ASK_BEFORE:
            found = min(found, search.best((int(last[k, 0]) >> 2, int(last[k, 1]) >> 2)), key=lambda f: f[2])
        out[k] = between(search, *found)
    return out


def searched_fields(planes: DataFrame, side: int, block: int, reach: int, stream: int = 8, median: bool = False) -> DataFrame:
    """(plane, vectors): the searched field of each plane after the first of its stream; the field before goes from plane to plane, a stream a task."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = last = None
        for plane, coef in sorted((r for b in batches for r in zip(b.column("plane").to_pylist(), b.column("coef").to_pylist(), strict=True)), key=lambda r: r[0]):
            now = np.array(coef, np.int64).reshape(side, side)
            if before is not None:
                last = searched_field(now, before, block, reach, last, median)
                yield pa.RecordBatch.from_arrays([pa.array([plane], pa.int64()), pa.array([last.reshape(-1).tolist()], pa.list_(pa.int64()))], ["plane", "vectors"])
            before = now

    return planes.withColumn("stream", F.expr(f"plane div {stream}")).select("stream", "plane", "coef").groupBy("stream").applyInArrow(run, "plane long, vectors array<long>")
