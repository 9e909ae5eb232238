"""Distortion and similarity of frames, and their summary."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators import planes as P


def psnr(pairs: DataFrame, peak: int = 255) -> DataFrame:
    """(frame, psnr) of arrays a and b; equal ones have 100."""
    n = F.size("a")
    error = F.aggregate(F.zip_with("a", "b", lambda x, y: ((x - y) * (x - y)).cast("long")), F.lit(0).cast("long"), lambda s, v: s + v)
    return pairs.select("frame", F.when(error == 0, 100.0).otherwise(F.log10(F.lit(float(peak * peak)) / (error / n)) * 10).alias("psnr"))


def ssim(pairs: DataFrame) -> DataFrame:
    """(frame, ssim) of one 8x8 tile a row, with population moments."""
    total = lambda v: F.aggregate(v, F.lit(0).cast("long"), lambda s, x: s + x)
    sums = pairs.select("frame", F.size("a").cast("double").alias("n"), total(F.col("a")).alias("sa"), total(F.col("b")).alias("sb"), total(F.transform("a", lambda x: (x * x).cast("long"))).alias("saa"), total(F.transform("b", lambda x: (x * x).cast("long"))).alias("sbb"), total(F.zip_with("a", "b", lambda x, y: (x * y).cast("long"))).alias("sab"))
    m = sums.select("frame", (F.col("sa") / F.col("n")).alias("ma"), (F.col("sb") / F.col("n")).alias("mb"), (F.col("saa") / F.col("n")).alias("qa"), (F.col("sbb") / F.col("n")).alias("qb"), (F.col("sab") / F.col("n")).alias("qab"))
    return m.selectExpr("frame", "(2 * ma * mb + 6.5025D) * (2 * (qab - ma * mb) + 58.5225D) / ((ma * ma + mb * mb + 6.5025D) * ((qa - ma * ma) + (qb - mb * mb) + 58.5225D)) AS ssim")


def errors(pairs: DataFrame) -> DataFrame:
    """Mean and largest absolute error, and the shares above 10, 20 and 30, in thousandths."""
    return pairs.select("frame", F.zip_with("a", "b", lambda x, y: F.abs(x - y)).alias("d")).select(
        "frame", F.aggregate("d", F.lit(0).cast("long"), lambda s, v: s + v).alias("absolute"), F.array_max("d").cast("long").alias("largest"), *(F.expr(f"size(filter(d, v -> v > {k})) * 1000L div size(d)").alias(f"above_{k}") for k in (10, 20, 30))
    )


#: Buckets that ranks are counted in; a value falls into one by its own bits.
BUCKETS = 1 << 16


def ranked(values: DataFrame, column: str) -> DataFrame:
    """(v, first, last): each distinct value with the ranks, from 0, that its rows have. Equal values are counted before they meet; the buckets, of equal width between the extremes, are summed up by a window of one row a bucket."""
    counts = values.groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    ends = counts.agg(F.min("v").alias("low"), F.max("v").alias("high"))  # one row
    width = F.greatest(F.col("high") - F.col("low"), F.lit(5e-324))
    placed = counts.join(F.broadcast(ends)).select("v", "n", F.least(F.floor((F.col("v") - F.col("low")) / width * BUCKETS), F.lit(BUCKETS - 1).cast("long")).alias("bucket"))
    before = F.coalesce(F.sum("n").over(W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = placed.groupBy("bucket").agg(F.sum("n").alias("n")).select("bucket", before.alias("ahead"))  # BUCKETS rows at most
    inside = W.partitionBy("bucket").orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    return placed.join(F.broadcast(offsets), "bucket").withColumn("last", F.sum("n").over(inside) + F.col("ahead") - 1).select("v", (F.col("last") - F.col("n") + 1).alias("first"), "last")


def summary(values: DataFrame, column: str) -> DataFrame:
    """Count, mean, extremes, population deviation, and the values at rank floor(n * p)."""
    found = values.agg(F.count(column).alias("n"), F.round(F.avg(column), 6).alias("mean"), F.round(F.min(column), 6).alias("least"), F.round(F.max(column), 6).alias("most"), F.round(F.stddev_pop(column), 6).alias("deviation"))
    wanted = lambda p: F.least(F.col("n") - 1, F.floor(F.col("n") * p))
    holds = lambda p: (F.col("first") <= wanted(p)) & (wanted(p) <= F.col("last"))
    picks = ranked(values, column).join(F.broadcast(found.select("n")))  # one row
    at = picks.agg(*(F.round(F.max(F.when(holds(p), F.col("v"))), 6).alias(name) for p, name in ((0.5, "p50"), (0.9, "p90"))))
    return found.join(F.broadcast(at))  # one row each


def worst(values: DataFrame, column: str) -> DataFrame:
    """The frame with the smallest value; the first of equals."""
    return values.agg(F.min(F.struct(F.col(column), F.col("frame"))).alias("b")).select(F.col("b.frame").alias("frame"))


def combined(pairs: DataFrame) -> DataFrame:
    """(frame, psnr, ssim) of (frame, plane, a, b) with planes 0 to 2: luma counts four times, each chroma plane once; frames without all three are left out."""
    keyed = pairs.select(F.struct("frame", "plane").alias("frame"), "a", "b")
    one = psnr(keyed).join(ssim(keyed), "frame").select("frame.frame", "frame.plane", "psnr", "ssim")
    weight = F.when(F.col("plane") == 0, 4).otherwise(1)
    return one.groupBy("frame").agg(F.count("*").alias("planes"), (F.sum(weight * F.col("psnr")) / 6).alias("psnr"), (F.sum(weight * F.col("ssim")) / 6).alias("ssim")).where("planes = 3").drop("planes")


def ghosts(frames: DataFrame, group: str) -> DataFrame:
    """Of the samples of ``b`` that miss ``a`` by more than 10, how many are nearer to the group's first frame, or else to the one before."""
    w = W.partitionBy(group).orderBy("frame")
    near = frames.withColumn("before", F.lag("a").over(w)).withColumn("first", F.first("a").over(w)).where("before is not null")

    def kernel(batch: pa.RecordBatch) -> list[pa.Array]:
        a, b, before, first = (P.array(batch.column(c), -1) for c in ("a", "b", "before", "first"))
        error = np.abs(b - a)
        wrong = error > 10
        of_first = wrong & (np.abs(b - first) < error)
        trailing = wrong & (np.abs(b - before) < error) & ~of_first
        counts = [m.sum(1).astype(np.int64) for m in (wrong, of_first, trailing)]
        score = np.where(counts[0] > 0, (counts[1] + counts[2]) * 100.0 / np.maximum(counts[0], 1), 0.0)
        return [batch.column("frame"), *map(pa.array, counts), pa.array(score.round(6))]

    return P.mapped(near.select("frame", "a", "b", "before", "first"), "frame long, wrong long, first_ghosts long, trailing_ghosts long, score double", kernel)


def colour_statistics(planes: DataFrame, side: int = 8) -> DataFrame:
    """(frame, mean_u, mean_v, saturated, energy, rough) of (frame, plane, a) with planes 0 and 1: means, the share near the ends in per cent, the distance from grey, and the mean Laplacian inside."""

    def kernel(batch: pa.RecordBatch) -> list[pa.Array]:
        x = P.array(batch.column("a"), side, side)
        inner = np.abs(4 * x[:, 1:-1, 1:-1] - x[:, :-2, 1:-1] - x[:, 2:, 1:-1] - x[:, 1:-1, :-2] - x[:, 1:-1, 2:])
        clipped = ((x >= 250) | (x <= 5)).sum((1, 2)) * 100.0 / (side * side)
        return [batch.column("frame"), batch.column("plane"), *(pa.array(v) for v in (x.mean((1, 2)), clipped, np.abs(x - 128).mean((1, 2)), inner.mean((1, 2))))]

    one = P.mapped(planes.select("frame", "plane", "a"), "frame long, plane int, mean double, clipped double, energy double, rough double", kernel)
    pick = lambda k, c: F.max(F.when(F.col("plane") == k, F.col(c)))
    both = one.groupBy("frame").agg(F.count("*").alias("n"), pick(0, "mean").alias("mean_u"), pick(1, "mean").alias("mean_v"), F.avg("clipped").alias("saturated"), F.sum("energy").alias("energy"), F.avg("rough").alias("rough"))
    return both.where("n = 2").drop("n")


def drift(statistics: DataFrame, group: int, *columns: str) -> DataFrame:
    """Averages by the frame's place in groups of ``group`` frames."""
    return statistics.groupBy((F.col("frame") % group).cast("int").alias("position")).agg(F.count("*").alias("frames"), *(F.round(F.avg(c), 9).alias(c) for c in columns))
