"""Command line, for spark-submit or ``python -m tessera``: run a query, split streams, turn Y4M into frames and back, compare two tables of frames."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera.operators import fidelity
from tessera.plans import registry
from tessera.sources import container, y4m


def _query(spark: SparkSession, a: argparse.Namespace) -> None:
    registry.QUERIES[a.name](spark, a.tables).write.mode("overwrite").parquet(a.out)


def _split(spark: SparkSession, a: argparse.Namespace) -> None:
    """Keeps the layers up to the highest of a table of packets."""
    packets = spark.read.parquet(a.packets)
    container.keep_layers(packets, a.highest).write.mode("overwrite").parquet(a.out)
    print(*container.dropped_bytes(packets, a.highest).first())


def _frames(spark: SparkSession, a: argparse.Namespace) -> None:
    spark.dataSource.register(y4m.Y4M)
    spark.read.format("y4m").load(a.file).write.mode("overwrite").parquet(a.out)


def _y4m(spark: SparkSession, a: argparse.Namespace) -> None:
    spark.dataSource.register(y4m.Y4M)
    spark.read.parquet(a.frames).repartitionByRange("frame_no").sortWithinPartitions("frame_no").write.format("y4m").mode("append").save(a.out)


def _compare(spark: SparkSession, a: argparse.Namespace) -> None:
    """Fidelity of two tables (frame, coef), frames that both have."""
    pairs = spark.read.parquet(a.left).select("frame", F.col("coef").alias("a")).join(spark.read.parquet(a.right).select("frame", F.col("coef").alias("b")), "frame")
    print(fidelity.summary(fidelity.psnr(pairs), "psnr").first().asDict())


COMMANDS = {"query": (_query, ("name", "tables", "out")), "split": (_split, ("packets", "out")), "frames": (_frames, ("file", "out")), "y4m": (_y4m, ("frames", "out")), "compare": (_compare, ("left", "right"))}


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tessera", description=__doc__)
    commands = parser.add_subparsers(required=True)
    for name, (run, fields) in COMMANDS.items():
        sub = commands.add_parser(name, help=run.__doc__)
        sub.set_defaults(run=run)
        for field in fields:
            sub.add_argument(field)
        if name == "split":
            sub.add_argument("--highest", type=int, choices=(0, 1, 2), default=0)
    found = parser.parse_args(arguments)
    found.run(spark or SparkSession.builder.getOrCreate(), found)


if __name__ == "__main__":
    main()
