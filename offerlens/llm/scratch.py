"""Tables written once to the shared folder, so that a lost executor costs a reread and not a recomputation."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from offerlens.session import checkpoint_dir

BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


class Scratch:
    """A folder of Parquet tables under ``spark.checkpoint.dir``."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
        self.count = 0

    def keep(self, df: DataFrame, batch_rows: int | None = None) -> DataFrame:
        """Write ``df`` and return it as read back. ``batch_rows`` bounds the Arrow batches of wide rows meanwhile."""
        self.count += 1
        path = f"{self.root}/t{self.count}"
        before = self.spark.conf.get(BATCH_ROWS)
        try:
            if batch_rows:
                self.spark.conf.set(BATCH_ROWS, batch_rows)
            df.write.parquet(path)
        finally:
            self.spark.conf.set(BATCH_ROWS, before)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept._scratch_path = path
        return kept

    def drop(self, kept: DataFrame) -> None:
        """Delete a table that nothing later reads."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(kept._scratch_path)
        path.getFileSystem(conf).delete(path, True)


def small_side(df: DataFrame, rows: int, most: int) -> DataFrame:
    """Mark ``df`` for broadcast only when its counted ``rows`` are at most ``most``; else Spark shuffles it."""
    return df.hint("broadcast") if rows <= most else df
