"""Neighbouring frames: differences, displacement search and contrast. A frame's pixels stay one array; only frames are joined."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import scalar as S
from tessera.operators import planes as P


def with_previous(blocks: DataFrame, span: int = 1000) -> DataFrame:
    """Adds the previous frame's samples as ``before``. Frames are dealt by runs of ``span``, the last of a run to the next one too, so samples are shuffled once."""
    run = F.expr(f"frame div {span}")
    dealt = blocks.withColumn("run", F.explode(F.when(F.col("frame") % span == span - 1, F.array(run, run + 1)).otherwise(F.array(run))))
    w = W.partitionBy("run").orderBy("frame")
    near = dealt.withColumn("before", F.when(F.lag("frame").over(w) == F.col("frame") - 1, F.lag("coef").over(w)))
    return near.where(F.col("run") == run).drop("run")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda s, v: s + v)


def sad(a: Column, b: Column, every: int = 1) -> Column:
    """Sum of absolute differences, of every ``every``-th sample."""
    return _sum(F.filter(F.zip_with(a, b, lambda x, y: F.abs(x - y)), lambda v, i: i % every == 0))


def frame_differences(blocks: DataFrame) -> DataFrame:
    """Difference to the previous frame: full, by every fourth sample, contrast, and column-sum occlusion."""
    both = with_previous(blocks).where("before is not null")
    columns = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda x: F.abs(_sum(F.zip_with(F.filter("coef", lambda v, p: p % 8 == x), F.filter("before", lambda v, p: p % 8 == x), lambda a, b: a - b))))
    return both.select("frame", sad(F.col("coef"), F.col("before")).alias("sad"), S.div(sad(F.col("coef"), F.col("before"), 4) * 4, 64).alias("fast"), (F.array_max("coef") - F.array_min("coef")).cast("long").alias("contrast"), S.div(_sum(columns), 64).alias("occlusion"))


def best_offset(blocks: DataFrame, reach: int = 2, side: int = 8) -> DataFrame:
    """(frame, dx, dy, cost): the displacement of the previous frame that fits best, out of a small window; coordinates are clamped and earlier offsets win ties."""

    def kernel(batch: pa.RecordBatch) -> list[pa.Array]:
        found = P.best_vectors(P.array(batch.column("coef"), side, side), P.array(batch.column("before"), side, side), side, reach)
        return [batch.column("frame"), *(pa.array(v[:, 0].astype("int64")) for v in found)]

    return P.mapped(with_previous(blocks).where("before is not null").select("frame", "coef", "before"), "frame long, dx long, dy long, cost long", kernel)


def predicted_vectors(offsets: DataFrame) -> DataFrame:
    """Difference of each displacement to its predecessor's, and its magnitude as a penalty."""
    w = W.orderBy("frame").partitionBy(F.expr("frame div 50"))
    mx, my = F.col("dx") - F.coalesce(F.lag("dx").over(w), F.lit(0)), F.col("dy") - F.coalesce(F.lag("dy").over(w), F.lit(0))
    return offsets.select("frame", mx.alias("mx"), my.alias("my"), (F.abs(mx) + F.abs(my)).alias("penalty"))


def with_cells(blocks: DataFrame) -> DataFrame:
    """Adds cell_sad and cell_occlusion of the cell of two by two blocks that holds a block (row, col, sad, occlusion): sums and the largest, by a window over the cell."""
    w = W.partitionBy(F.expr("row div 2"), F.expr("col div 2"))
    return blocks.withColumn("cell_sad", F.sum("sad").over(w)).withColumn("cell_occlusion", F.max("occlusion").over(w))
