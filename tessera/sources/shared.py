"""Folders that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's name in that of ``spark.checkpoint.dir``; where none is set and all runs on this machine, as in tests, in a temporary one that is removed at the end."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not where:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = getattr(sc, "_tessera_shared_dir", None)
        if where is None:
            where = sc._tessera_shared_dir = tempfile.mkdtemp(prefix="tessera-shared-")
            atexit.register(shutil.rmtree, where, ignore_errors=True)
    return f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex}"
