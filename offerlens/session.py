"""Session helpers."""
from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names, or a fresh local one where none is set (tests)."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        current = tempfile.mkdtemp(prefix="spark-ckpt-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(current)
    return current


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to reliable storage, so several consumers read it instead of recomputing."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
