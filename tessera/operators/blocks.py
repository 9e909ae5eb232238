"""Block operators: lifting transform, quantisation, predicates and energies. All map over one array a row; nothing shuffles."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import scalar as S
from tessera.operators import planes as P


def lift(samples: Column, half: int) -> Column:
    """5/3 lifting of 2 * half samples with alternating rounding: the low band, then the high band."""
    at = F.sequence(F.lit(0), F.lit(half - 1))
    high = lambda a: F.transform(at, lambda i: a[i * 2 + 1] - F.shiftright(a[i * 2] + a[F.least(i + 1, F.lit(half - 1)) * 2] + i % 2, 1))
    low = lambda a, h: F.transform(at, lambda i: a[i * 2] + F.shiftright(h[F.greatest(i - 1, F.lit(0))] + h[i] + 1 + i % 2, 2))
    return S.let(samples, lambda a: S.let(high(a), lambda h: F.concat(low(a, h), h)))


def unlift(bands: Column, half: int) -> Column:
    """Inverse of lift()."""
    at = F.sequence(F.lit(0), F.lit(half - 1))
    even = lambda b: F.transform(at, lambda i: b[i] - F.shiftright(b[half + F.greatest(i - 1, F.lit(0))] + b[half + i] + 1 + i % 2, 2))
    odd = lambda b, e: F.transform(at, lambda i: b[half + i] + F.shiftright(e[i] + e[F.least(i + 1, F.lit(half - 1))] + i % 2, 1))
    return S.let(bands, lambda b: S.let(even(b), lambda e: S.let(odd(b, e), lambda o: F.flatten(F.transform(at, lambda i: F.array(e[i], o[i]))))))


def _rows(coef: Column, side: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(side - 1)), lambda y: F.slice(coef, y * side + 1, F.lit(side)))


def _turned(rows: Column, side: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(side - 1)), lambda x: F.transform(rows, lambda r: r[x]))


def _both_ways(coef: Column, side: int, step) -> Column:
    first = F.transform(_rows(coef, side), lambda r: step(r, side // 2))
    return S.let(first, lambda r: S.let(F.transform(_turned(r, side), lambda c: step(c, side // 2)), lambda c: F.flatten(_turned(c, side))))


def forward(coef: Column, side: int = 8) -> Column:
    """2-D transform of a square, rows then columns."""
    return _both_ways(coef, side, lift)


def inverse(coef: Column, side: int = 8) -> Column:
    """Columns then rows."""
    turned = S.let(_rows(coef, side), lambda r: F.transform(_turned(r, side), lambda c: unlift(c, side // 2)))
    return S.let(turned, lambda c: F.flatten(F.transform(_turned(c, side), lambda r: unlift(r, side // 2))))


def band(position: Column, side: int = 8) -> Column:
    """LL, HL, LH or HH of a coefficient's place in its block."""
    down, right = F.expr(f"{side // 2}") <= S.div(position, side), F.expr(f"{side // 2}") <= position % side
    return F.when(down & right, "HH").when(down, "LH").when(right, "HL").otherwise("LL")


def transform_blocks(blocks: DataFrame, side: int = 8) -> DataFrame:
    """forward() of every block, by a kernel over batches."""
    return P.mapped(blocks.select("frame", "coef"), "frame long, coef array<int>", lambda b: [b.column("frame"), P.lists(P.forward(P.array(b.column("coef"), side, side)).astype("int32"), pa.int32())])


def untransform_blocks(blocks: DataFrame, side: int = 8) -> DataFrame:
    """inverse() of every block."""
    return P.mapped(blocks.select("frame", "coef"), "frame long, coef array<int>", lambda b: [b.column("frame"), P.lists(P.inverse(P.array(b.column("coef"), side, side)).astype("int32"), pa.int32())])


def quantise_blocks(blocks: DataFrame, low: int, middle: int, high: int, biases: tuple[int, int] = (16384, 8192)) -> DataFrame:
    """The low band rounded and signed; the others with their dead zones, zig-zagged."""

    def one(v: Column, p: Column) -> Column:
        where = band(p)
        return F.when(where == "LL", S.quantise(v, low)).when(where == "HH", S.zigzag(S.quantise(v, high, biases[1]))).otherwise(S.zigzag(S.quantise(v, middle, biases[0])))

    return blocks.withColumn("coef", F.transform("coef", one))


def dequantise_blocks(blocks: DataFrame, low: int, middle: int, high: int) -> DataFrame:
    def one(v: Column, p: Column) -> Column:
        where = band(p)
        return F.when(where == "LL", S.dequantise(v, low)).when(where == "HH", S.dequantise(S.unzigzag(v), high)).otherwise(S.dequantise(S.unzigzag(v), middle))

    return blocks.withColumn("coef", F.transform("coef", one))


def _where(coef: Column, bands: tuple[str, ...], side: int = 8) -> Column:
    return F.filter(coef, lambda v, p: band(p, side).isin(*bands))


def zero_blocks(blocks: DataFrame, limit: int) -> DataFrame:
    """is_zero: no coefficient beyond the limit, and a low band of zeros; is_split: some quadrant of all three high bands is zero. Zero blocks are cleared."""
    high = _where(F.col("coef"), ("HL", "LH", "HH"))
    zero = ~F.exists(high, lambda v: F.abs(v) > limit) & ~F.exists(_where(F.col("coef"), ("LL",)), lambda v: v != 0)
    half = lambda v: S.div(v, 2)
    inside = lambda q: F.filter(F.col("coef"), lambda v, p: (band(p) != "LL") & (half(S.div(p, 8) % 4) * 2 + half(p % 4) == q))
    split = ~F.exists(inside(0), lambda v: v != 0) | ~F.exists(inside(1), lambda v: v != 0) | ~F.exists(inside(2), lambda v: v != 0) | ~F.exists(inside(3), lambda v: v != 0)
    return blocks.select("frame", zero.alias("is_zero"), split.alias("is_split"), F.when(zero, F.transform("coef", lambda v: v * 0)).otherwise(F.col("coef")).alias("coef"))


def band_energy(blocks: DataFrame) -> DataFrame:
    """Sum of magnitudes in each high band and in all, by block."""
    total = lambda *bands: F.aggregate(_where(F.col("coef"), bands), F.lit(0).cast("long"), lambda s, v: s + F.abs(v))
    return blocks.select("frame", total("HL").alias("hl"), total("LH").alias("lh"), total("HH").alias("hh"), total("HL", "LH", "HH").alias("energy"))


def mean_energy(energy: Column) -> Column:
    """Mean of the measured energies, 1 at least; -1 marks those that are not."""
    known = F.when(energy != -1, energy)
    return F.greatest(F.lit(1).cast("long"), S.div(F.coalesce(F.sum(known), F.lit(0)), F.greatest(F.lit(1).cast("long"), F.count(known))))


def step_table(bases: DataFrame) -> DataFrame:
    """(base, layer, chroma) -> steps and dead zones of the low, middle and high bands. Finer layers have coarser steps; chroma's are capped lower, and its dead zones are wider."""
    base, layer, chroma = F.col("base"), F.col("layer"), F.col("chroma")
    bound = lambda v, cap: F.least(F.lit(cap).cast("long"), F.greatest(F.lit(1).cast("long"), v))
    middle = F.when(layer == 2, base).otherwise(S.div(base, 2))
    high = F.when(layer == 2, S.div(base * 5, 4)).when(layer == 1, base).otherwise(S.div(base * 3, 4))
    low = F.when(layer == 2, base).when(layer == 1, S.div(base, 6)).otherwise(S.div(base, 8))
    pick = lambda a, b, c: F.when(layer == 0, a).when(layer == 1, b).otherwise(c)
    return bases.select(
        "base", "layer", "chroma",
        F.when(chroma, bound(S.div(base, 8), 16)).otherwise(bound(low, 16)).alias("low"),
        F.when(chroma, bound(middle, 24)).otherwise(bound(middle, 48)).alias("middle"),
        F.when(chroma, bound(high, 48)).otherwise(bound(high, 64)).alias("high"),
        F.when(chroma, pick(-8000, -16000, -32000)).otherwise(pick(16384, 8192, 0)).alias("middle_zone"),
        F.when(chroma, pick(-16000, -32000, -64000)).otherwise(pick(8192, 0, -8000)).alias("high_zone"),
    )


def decimate(coef: Column, side: int = 8) -> Column:
    """The samples at even rows and columns, signed around 128: full chroma to a quarter."""
    return F.transform(F.filter(coef, lambda v, p: (p % 2 == 0) & (S.div(p, side) % 2 == 0)), lambda v: v - 128)


def skip_limits(rows: DataFrame, step: int, cols: int, grid: int, limit: int) -> DataFrame:
    """Adds the zero limit by place, halved in moving or uncovered blocks, and whether a block's change is too small to code."""
    weight = S.spatial_weight(F.col("col"), F.col("row"), cols, grid)
    moving = (F.col("sad") >= 1500) | (F.col("occlusion") >= 2)
    near = S.div(weight * limit, 1024)
    return rows.withColumn("limit", F.when(moving, F.greatest(F.lit(1).cast("long"), S.div(near, 2))).otherwise(near)).withColumn("skipped", F.col("sad") < S.div(weight * (150 * min(step, 256) // 48), 1024))
