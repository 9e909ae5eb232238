"""Signals from the supplied tables: 8x8 blocks, per-user series, byte streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame, coef): one 8x8 block a vector, in thousandths."""
    value = F.transform("embedding", lambda e: F.round(e.cast("double") * 1000).cast("int"))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame"), value.alias("coef"))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, event_id, v): each user's values in hundredths."""
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.round(F.col("value") * 100).cast("int").alias("v"))


def pixels(blocks: DataFrame) -> DataFrame:
    """(frame, y, x, v) from blocks."""
    return blocks.select("frame", F.posexplode("coef").alias("p", "v")).select("frame", F.expr("p div 8").alias("y"), F.expr("p % 8").alias("x"), F.col("v").cast("long").alias("v"))
