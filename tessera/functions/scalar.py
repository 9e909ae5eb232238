"""Integer column functions: everything here is a Catalyst expression and stays in generated code or array lambdas.

Integer division truncates, right shifts floor, and results are widened to long where a product could overflow.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

INT16_MAX = 32767


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluates ``value`` once and gives it a name inside ``body``."""
    return F.transform(F.array(value), body)[0]


def div(a: Column, b: Column | int) -> Column:
    """Integer division that truncates toward zero, as a long."""
    a, b = a.cast("long"), (b if isinstance(b, Column) else F.lit(b)).cast("long")
    # both as exact: the remainder has the dividend's sign
    return ((a - a % b) / b).cast("long")


def clamp16(v: Column) -> Column:
    return F.greatest(F.lit(-INT16_MAX - 1).cast("long"), F.least(F.lit(INT16_MAX).cast("long"), v.cast("long")))


def quantise(v: Column, step: int, bias: int = 32768) -> Column:
    """Division by a Q16 reciprocal; 32768 rounds to nearest, smaller and negative biases widen the dead zone."""
    scaled = F.shiftright(F.abs(v.cast("long")) * (65536 // step) + bias, 16)
    size = F.greatest(F.lit(0).cast("long"), scaled)
    return clamp16(F.when(v < 0, -size).otherwise(size))


def zigzag(v: Column) -> Column:
    return F.when(v >= 0, v * 2).otherwise(v * -2 - 1)


def unzigzag(v: Column) -> Column:
    return F.when(v % 2 == 0, F.shiftright(v, 1)).otherwise(-F.shiftright(v + 1, 1))


def dequantise(v: Column, step: int) -> Column:
    return clamp16(v.cast("long") * step)


def median_edge(left: Column, up: Column, corner: Column) -> Column:
    """The smaller neighbour if the corner is above both, the larger if below both, else their plane."""
    low, high = F.least(left, up), F.greatest(left, up)
    return F.when(corner >= high, low).when(corner <= low, high).otherwise(left + up - corner)


def bit_length(v: Column) -> Column:
    """Bits of a non-negative number; 0 has none."""
    return F.when(v == 0, 0).otherwise(F.length(F.bin(v)))


def signed_token(v: Column) -> tuple[Column, Column, Column]:
    """Token, bypass bits and their length: small values have tokens of their own, larger ones their magnitude's bit length."""
    size, sign = F.abs(v), F.when(v < 0, 1).otherwise(0)
    rest = F.greatest(size - 16, F.lit(0))
    bits = bit_length(rest)
    low = F.when(rest == 0, 0).otherwise(rest - F.pow(F.lit(2.0), bits - 1).cast("long"))
    small = size <= 15
    token = F.when(v == 0, 0).when(small, size * 2 - 1 + sign).otherwise(32 + bits)
    return token.cast("int"), F.when(small, 0).otherwise(low * 2 + sign).cast("long"), F.when(small, 0).otherwise(F.greatest(bits, F.lit(1))).cast("int")


def signed_value(token: Column, bypass: Column) -> Column:
    """Inverse of signed_token()."""
    sub = token - 32
    rest = F.when(sub <= 0, 0).otherwise(F.pow(F.lit(2.0), sub - 1).cast("long") + F.shiftright(bypass, 1))
    small = div(token - 1, 2) + 1
    return F.when(token == 0, 0).when(token < 32, F.when((token - 1) % 2 == 1, -small).otherwise(small)).otherwise(F.when(bypass % 2 == 1, -(rest + 16)).otherwise(rest + 16)).cast("long")


def unsigned_token(v: Column) -> tuple[Column, Column, Column]:
    rest = F.greatest(v - 32, F.lit(0))
    bits = bit_length(rest)
    low = F.when(rest == 0, 0).otherwise(rest - F.pow(F.lit(2.0), bits - 1).cast("long"))
    return F.when(v < 32, v).otherwise(32 + bits).cast("int"), low.cast("long"), F.greatest(bits - 1, F.lit(0)).cast("int")


def unsigned_value(token: Column, bypass: Column) -> Column:
    return F.when(token < 32, token).when(token == 32, 32).otherwise(F.pow(F.lit(2.0), token - 33).cast("long") + bypass + 32).cast("long")


def log2_q8(v: Column) -> Column:
    """256 times the binary logarithm: floor, and a linear fraction."""
    floor = bit_length(v) - 1
    base = F.pow(F.lit(2.0), floor).cast("long")
    return F.when(v < 1, 0).otherwise(floor * 256 + div((v - base) * 256, base)).cast("long")


def isqrt(v: Column) -> Column:
    """Floor of the square root; exact below 2^52."""
    return F.when(v <= 0, 0).otherwise(F.floor(F.sqrt(v.cast("double")))).cast("long")


def spatial_weight(col: Column, row: Column, cols: int, rows: int, edge: int = 1536) -> Column:
    """1024 in the middle of a grid, rising with the distance to ``edge`` in its corners."""
    if cols <= 1 or rows <= 1:
        return F.lit(1024).cast("long")
    x, y = div(col * 2048, cols - 1) - 1024, div(row * 2048, rows - 1) - 1024
    # 1448 is the square root of two in 1/1024
    far = F.least(F.lit(1024).cast("long"), div(isqrt(x * x + y * y) * 1024, 1448))
    return 1024 + div(far * (edge - 1024), 1024)


def edge_strength(step: Column) -> tuple[Column, Column]:
    """Largest shift and activity limit of the deblocking filter: none up to a step of 3, a ramp up to 15, then capped."""
    shift, limit = div(step, 2) + 3, step + 6
    ramp = lambda full, cap: F.when(step <= 3, 0).when(step <= 15, div(full * (step - 3), 12)).otherwise(F.least(F.lit(cap), full))
    return ramp(shift, 15).cast("long"), ramp(limit, 50).cast("long")


def scale_vector(v: Column, shift: int, missing: int = INT16_MAX) -> Column:
    """Halves a motion component ``shift`` times, rounding half up; the mark of a missing one stays."""
    return F.when(v == missing, v).otherwise(F.shiftright(v + ((1 << shift) >> 1), shift))


def luma_chroma(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Full-range YCbCr in Q16."""
    byte = lambda v: F.greatest(F.lit(0), F.least(F.lit(255), v))
    return (
        byte(F.shiftright(r * 19595 + g * 38470 + b * 7471 + 32768, 16)),
        byte(F.shiftright(r * -11059 + g * -21709 + b * 32768 + 32768, 16) + 128),
        byte(F.shiftright(r * 32768 + g * -27439 + b * -5329 + 32768, 16) + 128),
    )


def red_green_blue(y: Column, cb: Column, cr: Column) -> tuple[Column, Column, Column]:
    """Back, in Q10."""
    byte = lambda v: F.greatest(F.lit(0), F.least(F.lit(255), v))
    u, v = cb - 128, cr - 128
    return byte(F.shiftright(y * 1024 + v * 1436 + 512, 10)), byte(F.shiftright(y * 1024 - u * 352 - v * 731 + 512, 10)), byte(F.shiftright(y * 1024 + u * 1815 + 512, 10))


def aq_level(energy: Column, average: Column, sad: Column, col: Column, row: Column, cols: int, rows: int) -> Column:
    """Quantiser level 0..4 of a block from its energy against the frame's, its place and its motion."""
    ratio = div(energy * 10, F.greatest(F.lit(1), average))
    far = div((F.abs(col - cols // 2) + F.abs(row - rows // 2)) * 10, max(1, cols // 2 + rows // 2))
    place = F.when(far >= 7, 2).when(far <= 4, -3).otherwise(0)
    motion = F.when(sad == -1, 0).when(sad < 128, 2).when(sad > 256, F.when(ratio <= 10, -3).otherwise(2)).otherwise(0)
    total = ratio + place + motion
    return F.when(total <= 6, 0).when(total <= 8, 1).when(total <= 12, 2).when(total <= 15, 3).otherwise(4)
