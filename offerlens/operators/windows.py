"""Rank, top-k and previous-row helpers that hold up when one key owns a large share of the rows."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(
    df: DataFrame, keys: list[str], order: list[Column], k: int = 1, rank_name: str | None = None
) -> DataFrame:
    """First ``k`` rows per key. Spark cuts every map task to ``k`` rows per key before the
    shuffle (window group limit), so a hot key sends ``k`` rows per task."""
    rank = rank_name or "_rank"
    w = Window.partitionBy(*keys).orderBy(*order)
    top = df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)
    return top if rank_name else top.drop(rank)


def split_rank(
    df: DataFrame, keys: list[str], coarse: Column, order: list[Column], name: str
) -> DataFrame:
    """Exact row number per key, without sorting a whole key in one task.

    ``coarse`` has to follow ``order`` (a lower bucket sorts entirely before a higher one). Rows
    are numbered inside (key, bucket); the sizes of lower buckets, a small table, are added.
    """
    bucketed = df.withColumn("_bucket", coarse)
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        bucketed.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    return (
        bucketed.withColumn("_inside", F.row_number().over(inside))
        .join(offsets, [*keys, "_bucket"])
        .withColumn(name, (F.col("_inside") + F.col("_offset")).cast("int"))
        .drop("_bucket", "_inside", "_offset")
    )


def magnitude(c: Column, steps: int = 16) -> Column:
    """Bucket of a positive number that grows with it (logarithmic steps)."""
    return F.floor(F.log2(c) * steps)


def with_previous(
    df: DataFrame, keys: list[str], order: Column, bucket: str, values: list[str], prefix: str
) -> DataFrame:
    """Value(s) of the row before, per key, in ``order``.

    ``bucket`` is a column that follows ``order`` (such as the day). The lag runs inside
    (key, bucket); the first row of a bucket takes the last row of the bucket before, which comes
    from a table of one row per (key, bucket). A long history is thus never sorted in one task.
    """
    row = F.struct(*values)
    inside = Window.partitionBy(*keys, bucket).orderBy(order)
    tails = df.groupBy(*keys, bucket).agg(F.max_by(row, order).alias("_tail"))
    carried = tails.withColumn(
        "_carry", F.lag("_tail").over(Window.partitionBy(*keys).orderBy(bucket))
    ).drop("_tail")
    joined = df.withColumn("_prev", F.lag(row).over(inside)).join(carried, [*keys, bucket])
    prev = F.coalesce("_prev", "_carry")
    out = joined.withColumn("_p", prev)
    for v in values:
        out = out.withColumn(f"{prefix}{v}", F.col(f"_p.{v}"))
    return out.drop("_prev", "_carry", "_p")
