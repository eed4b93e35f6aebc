"""Tables that are kept up to date: rows are filed by a hash of their key, and a merge reads and rewrites only the
buckets that hold touched keys.

The write is Spark's dynamic partition overwrite. Tasks write beside the table and the driver moves the new buckets in when all
are done, so a job that fails before leaves the table as it was, and a repeated merge gives the same table. A driver that dies while
it moves buckets can leave one of them missing: merge the appends since the last good copy again, or ``rebuild`` from the
history, which is only ever appended to. One writer at a time; readers that listed a bucket before it was replaced fail and read again.
"""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from offerlens.operators import compare as A
from offerlens.operators import state as S
from offerlens.schemas import COLS, Cols

BUCKET = "_bucket"
BUCKETS = 64


@dataclass(frozen=True)
class KeptTable:
    """A table of rows keyed by ``key`` under ``path``. The number of buckets is fixed when the first rows are written."""

    spark: SparkSession
    path: str
    key: list[str]
    buckets: int = BUCKETS

    def _filed(self, df: DataFrame) -> DataFrame:
        return df.withColumn(BUCKET, F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int"))

    def exists(self) -> bool:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder)

    def read(self) -> DataFrame:
        """All rows. A filter on the key's bucket is not needed: merges find it themselves."""
        return self.spark.read.parquet(self.path).drop(BUCKET)

    def near(self, keys: DataFrame, schema: StructType) -> DataFrame:
        """The rows of the buckets that hold ``keys``; other buckets are not read. ``schema`` is that of a table not yet written."""
        if not self.exists():
            return self.spark.createDataFrame([], schema)
        touched = [r[0] for r in self._filed(keys).select(BUCKET).distinct().collect()]  # at most ``buckets``
        return self.spark.read.parquet(self.path).filter(F.col(BUCKET).isin(touched)).drop(BUCKET)

    def _write(self, df: DataFrame) -> None:
        filed = self._filed(df).hint("rebalance", BUCKET)
        filed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)

    def rebuild(self, df: DataFrame) -> None:
        """Write the whole table anew."""
        self._filed(df).hint("rebalance", BUCKET).write.mode("overwrite").option(
            "partitionOverwriteMode", "static").partitionBy(BUCKET).parquet(self.path)

    def merge(self, new: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Replace the touched buckets by ``combine(their rows, new)`` and return their numbers.

        ``combine`` must keep a row of every key in ``new`` and leave keys that ``new`` doesn't hold as they are.
        """
        touched = [r[0] for r in self._filed(new).select(BUCKET).distinct().collect()]  # at most ``buckets``
        if not touched:
            return []
        if not self.exists():
            self._write(combine(new.limit(0), new))
            return sorted(touched)
        old = self.spark.read.parquet(self.path).filter(F.col(BUCKET).isin(touched)).drop(BUCKET)
        self._write(combine(old, new))
        return sorted(touched)


def replace_keys(table: KeptTable, new: DataFrame) -> list[int]:
    """Snapshot merge: all rows of the keys in ``new`` are replaced, others stay."""
    return table.merge(new, lambda old, new: S.replace_by_key(old, new.select(*old.columns), table.key))


def upsert_values(table: KeptTable, new: DataFrame) -> list[int]:
    """One row per key; the new row wins, and unknown keys are created. ``new`` holds a key once."""
    return replace_keys(table, new)


def merge_latest(table: KeptTable, append: DataFrame, order: list[str]) -> list[int]:
    """The last record of each key, from the kept ones and one append. An older record that comes late changes nothing,
    and neither does a repeated append."""
    once = A.latest_per_key(append, table.key, order)
    return table.merge(once, lambda old, new: A.latest_per_key(old.unionByName(new), table.key, order))


@dataclass(frozen=True)
class KeptHistory:
    """Price history kept by day: the price of the last record of each (entity, seller, day), and each entity's first
    and last record. Both only grow by maxima and minima, so late and repeated appends are harmless."""

    spark: SparkSession
    path: str
    buckets: int = BUCKETS
    keys: Cols = COLS

    @property
    def days(self) -> KeptTable:
        return KeptTable(self.spark, f"{self.path}/days", [self.keys.entity, self.keys.seller, self.keys.date], self.buckets)

    @property
    def records(self) -> KeptTable:
        return KeptTable(self.spark, f"{self.path}/records", [self.keys.entity], self.buckets)

    def merge(self, append: DataFrame) -> tuple[list[int], list[int]]:
        """Add one append of offers; returns the buckets rewritten in both tables. Every entity is in the second one; only
        those with a usable price are in the first."""
        k = self.keys
        best = F.max(F.struct(F.col("ord"), F.col("less"))).alias("m")
        priced = append.filter(F.col(k.price) > 0).select(*self.days.key, F.col(k.ord).alias("ord"), (-F.col(k.price)).alias("less"))
        fold = lambda rows: rows.groupBy(*self.days.key).agg(best).select(*self.days.key, "m.*")
        seen = append.groupBy(k.entity).agg(F.min(k.ord).alias("first"), F.max(k.ord).alias("last"))
        span = lambda rows: rows.groupBy(k.entity).agg(F.min("first").alias("first"), F.max("last").alias("last"))
        return (
            self.days.merge(fold(priced), lambda old, new: fold(old.unionByName(new))),
            self.records.merge(seen, lambda old, new: span(old.unionByName(new))),
        )

    def price_history(self, active_sellers: DataFrame | None = None) -> DataFrame:
        """What ``history.price_history`` gives for all appends together."""
        k = self.keys
        rows = self.days.read()
        if active_sellers is not None:
            rows = rows.join(active_sellers.select(k.seller).distinct(), k.seller, "left_semi")
        series = self.records.read().filter(F.col("first") != F.col("last")).select(k.entity)
        return rows.join(series, k.entity, "left_semi").select(k.entity, k.date, k.seller, (-F.col("less")).alias(k.price))
