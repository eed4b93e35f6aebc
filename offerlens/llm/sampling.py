"""A bounded sample of labelled rows, however often an id or a text is repeated."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def _draw() -> list[Column]:
    return [F.xxhash64("id"), F.col("id")]


def texts_of_sample(docs: DataFrame, marked: DataFrame, most: int, *, id_col: str, text_col: str) -> DataFrame:
    """(id, mark, text, body) of the documents of at most ``most`` ids of each mark, ``body`` being a digest of the text.

    marked: id (once each) and mark, 0 or 1. The ids with the least hashes are taken. An id may have any number of rows.
    """
    take = lambda mark: marked.where(F.col("mark") == mark).orderBy(*_draw()).limit(most)
    sample = take(1).unionByName(take(0))  # 2 * most rows of an id and a number
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(sample), "id").select("id", "mark", "text", F.unhex(F.sha2("text", 256)).alias("body"))


def rows_per_mark(found: DataFrame, most: int) -> DataFrame:
    """One row per (id, body), and of these at most ``most`` of each mark. Tasks cut their own rows before the shuffle."""
    once = found.dropDuplicates(["id", "body"])
    place = F.row_number().over(Window.partitionBy("mark").orderBy(*_draw(), "body"))
    return once.withColumn("place", place).where(F.col("place") <= most).drop("place")


def id_type(df: DataFrame) -> str:
    """The type of the column ``id``, as a schema text."""
    return df.schema["id"].dataType.simpleString()
