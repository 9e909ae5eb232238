"""Session helpers: checkpoints in the shared folder, partition counts from the input's size."""

from __future__ import annotations

import atexit
import math
import shutil
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that one reduce task should get; partition counts follow from it.
TASK_BYTES = 64 << 20


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; only where none is set and all runs on this machine, as in tests, a temporary one."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not where:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = getattr(sc, "_tessera_checkpoint_dir", None)
        if where is None:
            where = sc._tessera_checkpoint_dir = tempfile.mkdtemp(prefix="tessera-checkpoint-")
            atexit.register(shutil.rmtree, where, ignore_errors=True)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """``df`` as written to the shared folder; its lineage ends there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's URI in the shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Removes a folder that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def tasks(df: DataFrame, expansion: float = 1.0) -> int:
    """Reduce tasks for ``expansion`` times the input's bytes, never fewer than the session's shuffle partitions."""
    spark = df.sparkSession
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    asked = int(spark.conf.get("spark.sql.shuffle.partitions"))
    known = size < 1 << 55  # Spark gives an immense size where it knows none
    return max(asked, min(200_000, math.ceil(size * expansion / TASK_BYTES))) if known else asked


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each made longer until no column of ``df`` has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def documents(df: DataFrame) -> DataFrame:
    """doc_id and text alone, whatever other columns there are."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def labels(n: int) -> list[int]:
    """n integers that Spark's hash partitioning into n partitions deals to a partition each, where it can."""
    x = np.arange(24 * n + 64, dtype=np.uint32)
    with np.errstate(over="ignore"):
        turn = lambda v, k: (v << np.uint32(k)) | (v >> np.uint32(32 - k))
        # 32-bit Murmur3 of an int with seed 42
        h = turn(turn(x * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593) ^ np.uint32(42), 13) * np.uint32(5) + np.uint32(0xE6546B64)
        h ^= np.uint32(4)
        for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
            h = (h ^ (h >> np.uint32(shift))) * np.uint32(factor)
        h ^= h >> np.uint32(16)
    places = h.view(np.int32).astype(np.int64) % n
    found, first = np.unique(places, return_index=True)
    spare = iter(np.setdiff1d(np.arange(len(x)), first).tolist())
    out = dict(zip(found.tolist(), first.tolist(), strict=True))
    return [out[p] if p in out else next(spare) for p in range(n)]
