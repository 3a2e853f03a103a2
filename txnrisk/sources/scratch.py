"""Intermediate tables that cut lineage.

They live in the shared folder named by ``spark.checkpoint.dir``. Only a
``local`` master may fall back to a temporary folder of this machine.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_folder: tempfile.TemporaryDirectory | None = None


def scratch_root(spark: SparkSession) -> str:
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    global _local_folder
    if _local_folder is None:
        _local_folder = tempfile.TemporaryDirectory(prefix="txnrisk-")
    return _local_folder.name


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once and return a scan of the written table.

    Unlike a cache it survives lost executors, and unlike an unfinished plan
    it gives every later reader the same rows in the same blocks.
    """
    path = f"{scratch_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
