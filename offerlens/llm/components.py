"""Connected components of an edge table by alternating large and small stars."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from offerlens.llm.scratch import Scratch


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """One star step on edges (u > v). Large: hang each node's larger neighbours on its smallest; small: the others."""
    if larger:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        near = both.where("v > u")
        moved = near.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        moved = moved.unionByName(least.select("u", F.col("m").alias("v")))
    return moved.where("u > v").distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node with an edge; the component is its smallest node.

    Each step keeps the components and is a grouped minimum plus a join on the node, so a hub with many neighbours
    is combined map-side; its edges meet that minimum in one partition, row by row. Rounds grow with the log of the longest path; nulls and loops
    are dropped. An empty edge table gives an empty result.
    """
    now = scratch.keep(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct()
    )
    state = _state(now)
    while state[0]:
        then = scratch.keep(_star(_star(now, True), False))
        new = _state(then)
        scratch.drop(now)
        now, done = then, new == state
        state = new
        if done:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
