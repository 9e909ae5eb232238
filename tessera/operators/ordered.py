"""Operators over ordered samples: prediction, runs, tokens, lanes, segments, smoothing, edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import scalar as S
from tessera.operators import planes as P


def residuals(blocks: DataFrame, side: int = 8) -> DataFrame:
    """Median edge prediction: first row from the left, first column from above, the first sample as it is."""
    return P.mapped(blocks.select("frame", "coef"), "frame long, coef array<long>", lambda b: [b.column("frame"), P.lists(P.median_residuals(P.array(b.column("coef"), side, side)))])


def from_residuals(blocks: DataFrame, side: int = 8) -> DataFrame:
    """Inverse of residuals(): each sample needs those before it, so all blocks of a batch go sample by sample together."""
    return P.mapped(blocks.select("frame", "coef"), "frame long, coef array<long>", lambda b: [b.column("frame"), P.lists(P.from_median_residuals(P.array(b.column("coef"), side, side)))])


def zero_runs(rows: DataFrame, key: str, place: str, value: str) -> DataFrame:
    """(key, place, run, value, context) of each nonzero value: the zeros before it, and whether a value came before it in its group."""
    w = W.partitionBy(key).orderBy(place)
    at = rows.withColumn("__at", F.row_number().over(w) - 1).where(F.col(value) != 0)
    before = F.lag("__at").over(w)
    return at.select(key, place, (F.col("__at") - F.coalesce(before, F.lit(-1)) - 1).cast("int").alias("run"), F.col(value).alias("value"), F.when(before.isNull(), 0).otherwise(1).alias("context"))


def expand_runs(pairs: DataFrame, groups: DataFrame, key: str, place: str, length: int) -> DataFrame:
    """Inverse of zero_runs() for groups of a known length: (key, position, value), zeros too; ``groups`` names all groups, those without a value as well."""
    w = W.partitionBy(key).orderBy(place).rowsBetween(W.unboundedPreceding, 0)
    put = pairs.select(key, (F.sum(F.col("run") + 1).over(w) - 1).alias("at"), "value")
    every = put.unionByName(groups.select(key, F.lit(-1).cast("long").alias("at"), F.lit(None).cast(put.schema["value"].dataType).alias("value")))
    packed = every.groupBy(key).agg(F.map_from_entries(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("at", "value")))).alias("m"))
    return packed.select(key, F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.coalesce(F.element_at("m", i.cast("long")), F.lit(0)))).alias("position", "value"))


def lanes(rows: DataFrame, key: str, order: str, n: int = 4) -> DataFrame:
    """Contiguous lanes; the first ones take what is left over."""
    return rows.withColumn("lane", F.ntile(n).over(W.partitionBy(key).orderBy(order)) - 1)


def segments(rows: DataFrame, key: str, order: str, value: str, threshold: int, interval: int) -> DataFrame:
    """Groups of frames: a new one at a scene cut, and every ``interval`` rows; position, parity of rounding, and the group's first value beside each row."""
    w = W.partitionBy(key).orderBy(order)
    change = F.abs(F.col(value) - F.lag(value).over(w))
    marked = rows.withColumn("same", F.coalesce(F.lag(value).over(w) == F.col(value), F.lit(False))).withColumn("cut", F.coalesce(change > threshold, F.lit(False)).cast("int"))
    scene = marked.withColumn("scene", F.sum("cut").over(w.rowsBetween(W.unboundedPreceding, 0)))
    inside = W.partitionBy(key, "scene").orderBy(order)
    placed = scene.withColumn("n", F.row_number().over(inside) - 1).withColumn("position", (F.col("n") % interval).cast("int"))
    group = placed.withColumn("gop", F.sum((F.col("position") == 0).cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    first = F.first(value).over(W.partitionBy(key, "gop").orderBy(order))
    return group.select(key, order, F.col("same").alias("is_copy"), (F.col("position") == 0).alias("is_key"), F.col("scene").cast("long").alias("scene"), F.col("gop").cast("long").alias("gop"), "position", (F.col("position") % 2).cast("int").alias("parity"), first.alias("reference"))


def level_runs(rows: DataFrame, key: str, order: str, level: str) -> DataFrame:
    """(key, start, level, length): runs of equal levels."""
    w = W.partitionBy(key).orderBy(order)
    marked = rows.withColumn("__n", F.row_number().over(w)).withColumn("__island", F.col("__n") - F.row_number().over(W.partitionBy(key, level).orderBy(order)))
    return marked.groupBy(key, level, "__island").agg(F.min("__n").alias("start"), F.count("*").alias("length")).select(key, F.col("start").cast("int").alias("start"), F.col(level).alias("level"), "length")


def deblock_row(samples: Column, edge: int, shift: Column, limit: Column) -> Column:
    """Smooths the two samples beside each ``edge``-th place of a row, where the step is small and both sides are flat."""

    def one(v: Column, p: Column) -> Column:
        a = samples
        right, left = (p % edge == 0) & (p > 0), (p % edge == edge - 1) & (p < F.size(a) - 1)
        q = F.when(right, p).otherwise(p + 1)
        p1, p0, q0, q1 = (F.get(a, q + k) for k in (-2, -1, 0, 1))
        soft = (F.abs(q0 - p0) < limit) & (F.abs(p1 - p0) * 2 < limit) & (F.abs(q1 - q0) * 2 < limit)
        delta = F.greatest(-shift, F.least(shift, F.shiftright(q0 - p0 + 1, 1)))
        return F.when(right & soft, v - delta).when(left & soft, v + delta).otherwise(v).cast("long")

    return F.transform(samples, one)
