"""Sharding by weighted rendezvous hashing of record keys.

Every (key, shard) pair has its own pseudo-random draw and a record goes to the shard with the best one. A new
shard takes exactly the records for which its draw beats all others, and no record moves between old shards; a
shard's share follows its weight. Nulls are a key of their own. Rows that share a key go to one shard.

Slots number a shard's rows without gaps. A shard is not sorted in one task: rows are numbered in small buckets of
a shard and the bucket sizes before are added. The order is by (bucket, key, checksum, size), so reruns agree.
"""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from offerlens.llm.scratch import Scratch

HASH_BITS = 52
BUCKETS = 4096  # of a shard, for numbering


def draw(key: Column, shard: int) -> Column:
    """A uniform number in (0, 1) for a key and a shard."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f"|{shard}")))
    return (F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long") + F.lit(0.5)) / float(2**HASH_BITS)


def _cost(key: Column, shard: int, weight: float) -> Column:
    return -F.ln(draw(key, shard)) / F.lit(float(weight))


def assign(docs: DataFrame, weights: Sequence[float], *, key_col: str = "doc_id", grown_weight: float | None = None) -> DataFrame:
    """Add ``shard`` and, with ``grown_weight``, ``grown_shard``: the shard once one more of that weight is there."""
    if len(weights) < 2 or min(weights) <= 0 or not all(map(math.isfinite, weights)):
        raise ValueError("two or more positive weights are needed")
    bid = lambda i, w: F.struct(_cost(F.col(key_col), i, w).alias("cost"), F.lit(i).alias("shard"))
    # the lower shard wins ties; unlike an array's minimum it is known not to be null, so joins add no filter that works it out again
    best = F.least(*[bid(i, w) for i, w in enumerate(weights)])
    out = docs.select(*[c for c in docs.columns if c not in ("shard", "grown_shard")], best.alias("__best"))
    added = {"shard": F.col("__best.shard")}
    if grown_weight is not None:
        added["grown_shard"] = F.least("__best", bid(len(weights), grown_weight))["shard"]
    return out.withColumns(added).drop("__best")


def slots(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Add ``slot``: 0, 1, ... inside each shard, in the order of hashed buckets and then ``order``."""
    kept = [c for c in rows.columns if c != "slot"]
    rows = rows.select(*kept, F.pmod(F.xxhash64(*order), F.lit(BUCKETS)).cast("int").alias("__bucket"))
    sizes = rows.groupBy("shard", "__bucket").agg(F.count("*").alias("__n"))
    before = sizes.select("shard", "__bucket", (F.sum("__n").over(Window.partitionBy("shard").orderBy("__bucket")) - F.col("__n")).alias("__before"))
    own = Window.partitionBy("shard", "__bucket").orderBy(*order)
    rows = rows.withColumn("__own", F.row_number().over(own) - 1)
    return rows.join(before, ["shard", "__bucket"]).withColumn("slot", F.col("__before") + F.col("__own")).select(*kept, "slot")


def shard(
    docs: DataFrame, weights: Sequence[float] = (1.0,) * 16, *, key_col: str = "doc_id", text_col: str = "text",
    grown_weight: float | None = 1.0, carry: Sequence[str] | None = None,
) -> DataFrame:
    """The key and the columns ``carry`` (all) plus size (UTF-8 bytes + 1), text_crc32, shard, grown_shard and slot. A null text is
    empty.

    Slots take two passes over the rows. Without their text these are written once for both, so texts are read once.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = docs.withColumns({"size": F.octet_length(text).cast("long") + 1, "text_crc32": F.crc32(text)})
    if carry is not None:
        sized = sized.select(*dict.fromkeys([key_col, *carry, "size", "text_crc32"]))
    rows = assign(sized, weights, key_col=key_col, grown_weight=grown_weight)
    if text_col not in rows.columns:
        rows = Scratch(docs.sparkSession).keep(rows)
    return slots(rows, [key_col, "text_crc32", "size"])
