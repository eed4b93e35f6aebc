"""Mixing sources to target weights.

Targets: sources share all words by weight, no source beyond ``most`` times its own words; what is cut off is
shared again by weight. A source's target is met by whole passes over it and a part of one more pass.

Blocks: the documents of a source are dealt into about sqrt(n) blocks by a hash. The partial pass takes blocks in a
permuted order, and of the last block the documents that still fit, also in a permuted order.

Splitting tree: every (source, block, pass) is a unit. A node of the tree holds a quota of units and hands half of
its output shards to each child: a random half of its units goes left, so the left child's counts per source are a
multivariate hypergeometric draw and the right child holds what is left, exactly. At the leaves each shard has its
quota of disjoint permuted blocks, and its documents are shuffled inside the shard by a hash.

Only units and sources are ranked in windows, never documents of a whole source; the ranks of units are found
in buckets of their hash. All draws are hashes of ids and the seed, so reruns agree.

Null and empty texts have size 0. A null source is a source of its own, after all others. Rows that share an id
are told apart by their texts; equal rows are drawn alike. Other columns are kept; those named like a result give way.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from offerlens.llm.scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3
SHARDS = 16
RESULT = ("size", "source_size", "target", "shards", "taken")


def _hash(*parts: Column | str) -> Column:
    """52 bits of the MD5 of the parts as text, as a long."""
    text = F.concat_ws("|", *[F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Add ``target`` to a table (source, source_size) with one row per source.

    Filled like vessels: with level t a source holds min(most * size, weight * t). Sources in the order of the level at
    which they are full are closed one after another; the level is right when the next is not full at it.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn.cast("int") + 1)
    rows = sizes.withColumn("weight", weight).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    rows = rows.withColumn("full_at", F.col("cap") / F.col("weight"))
    every, order = Window.partitionBy(), Window.orderBy("full_at", F.col("source").isNull(), "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({
        "rest": F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "open": F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)),
    })
    rows = rows.withColumn("level", F.col("rest") / F.col("open"))
    level = F.max(F.when(F.col("level") <= F.col("full_at"), F.col("level"))).over(every)
    return rows.withColumn("target", F.least(F.col("cap"), F.coalesce(F.col("weight") * level, F.col("cap")))).drop(
        "cap", "full_at", "rest", "open", "level")


def _null_safe(left: str, right: str) -> Column:
    return F.col(left).eqNullSafe(F.col(right))


def draws(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[float] = WEIGHTS, most: int = MOST, shards: int = SHARDS, seed: int = 0,
) -> DataFrame:
    """One row per distinct (id, text key, source): id, key, source, size, source_size, target, shards.

    ``shards`` holds the output shard of each copy that the mix takes, in the order of the passes.
    """
    scratch = Scratch(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = scratch.keep(docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text).alias("key"), F.col(source_col).cast("string").alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
    ).groupBy("id", "key", "source", "size").agg(F.count("*").alias("rows")))
    per = own.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count("*").alias("n"))
    per = targets(per, weights, most).withColumn("blocks", F.ceil(F.sqrt(F.col("n").cast("double"))).cast("long"))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    per = per.withColumn("passes", passes.cast("int"))
    per = scratch.keep(per.withColumn("part", F.greatest(F.lit(0.0), F.col("target") - F.col("passes") * F.col("source_size"))))
    dealt = own.join(per.withColumnRenamed("source", "_source"), _null_safe("source", "_source")).drop("_source")
    dealt = dealt.withColumn("place", _hash(F.lit(seed), "id", "size")).withColumn("block", F.pmod("place", "blocks"))
    held = F.col("size") * F.col("rows")
    blocks = dealt.groupBy("source", "block").agg(
        F.sum(held).alias("block_size"), F.first("part").alias("part"), F.first("passes").alias("passes"))
    blocks = blocks.withColumn("turn", _hash(F.lit(seed), "source", F.lit("block"), "block"))
    before = Window.partitionBy("source").orderBy("turn", "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("left", F.col("part") - F.coalesce(F.sum("block_size").over(before), F.lit(0)))
    blocks = scratch.keep(blocks.select("source", "block", "block_size", "passes", "left"))
    units = blocks.select("source", "block", F.explode(F.sequence(F.lit(0), F.col("passes") - (F.col("left") <= 0).cast("int"))).alias("pass")
                          ).where("pass >= 0")
    placed = split_tree(units, shards, seed, scratch).groupBy("source", "block").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pass", "shard"))), lambda x: x["shard"]).alias("placed"))
    named = blocks.withColumnsRenamed({"source": "_source", "block": "_block"}).drop("passes")
    named = named.join(placed, _null_safe("_source", "source") & (F.col("_block") == F.col("block")), "left").drop("source", "block")
    dealt = dealt.join(named, _null_safe("source", "_source") & (F.col("block") == F.col("_block"))).drop("_source", "_block")
    # whole blocks need no order; only the block in which the part ends is ordered
    ends = (F.col("left") > 0) & (F.col("left") < F.col("block_size"))
    inside = Window.partitionBy("source", "block").orderBy("place", "id", "key").rowsBetween(Window.unboundedPreceding, -1)
    last = dealt.where(ends).withColumn("so_far", F.coalesce(F.sum(held).over(inside), F.lit(0)))
    last = last.withColumn("more", (F.col("so_far") + held / 2 <= F.col("left")).cast("int")).drop("so_far")
    rest = dealt.where(~ends).withColumn("more", ((F.col("left") > 0) & (F.col("left") >= F.col("block_size"))).cast("int"))
    copies = F.when(F.col("source_size") > 0, F.col("passes") + F.col("more")).otherwise(0)
    none = F.array().cast("array<int>")
    return last.unionByName(rest).select(
        "id", "key", "source", "size", "source_size", "target", F.slice(F.coalesce("placed", none), F.lit(1), copies.cast("int")).alias("shards"))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The document columns plus size, source_size, target (of its source), shards (one per copy) and taken (words)."""
    drawn = draws(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    drawn = drawn.withColumnsRenamed({c: f"__{c}" for c in drawn.columns})
    kept = [c for c in docs.columns if c not in RESULT]
    rows = docs.withColumns({"__own": F.col(id_col), "__text_key": F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))),
                             "__from": F.col(source_col).cast("string")})
    same = _null_safe("__own", "__id") & (F.col("__text_key") == F.col("__key")) & _null_safe("__from", "__source")
    return rows.join(drawn, same).select(
        *kept, *[F.col(f"__{c}").alias(c) for c in ("size", "source_size", "target", "shards")],
        (F.col("__size") * F.size("__shards")).alias("taken"))


def mixed(docs: DataFrame, *, seed: int = 0, **options) -> DataFrame:
    """The mix itself: one row per copy with the document columns, ``mix_shard`` and ``mix_order`` (shuffled inside it).

    Write with ``repartition("mix_shard")`` and ``sortWithinPartitions("mix_shard", "mix_order")`` for one run per shard.
    """
    options = {"id_col": "doc_id", "text_col": "text", **options}
    rows = mix(docs.withColumn("__row", F.struct(*docs.columns)), seed=seed, **options)
    rows = rows.select("__row", F.posexplode("shards").alias("__pass", "mix_shard"))
    order = _hash(F.lit(seed), F.lit("order"), F.col("__row")[options["id_col"]], "__pass")
    return rows.select("__row.*", "mix_shard", order.alias("mix_order"))


def split_tree(units: DataFrame, shards: int, seed: int = 0, scratch: Scratch | None = None) -> DataFrame:
    """Add ``shard`` to units, one row each, identified by all their columns: the leaves of the splitting tree."""
    if shards < 1:
        raise ValueError("shards must be positive")
    scratch, names = scratch or Scratch(units.sparkSession), units.columns
    out = units.withColumns({"_first": F.lit(0), "_shards": F.lit(shards)})
    for level in range(max(0, (shards - 1).bit_length())):
        out = scratch.keep(_split(scratch.keep(out) if not level else out, names, level, seed))
    return out.select(*names, F.col("_first").alias("shard"))


def _split(nodes: DataFrame, names: list[str], level: int, seed: int) -> DataFrame:
    """One level: of a node's units, in random order, the left child's share of shards takes the first ones."""
    rows = nodes.withColumn("_draw", _hash(F.lit(seed), F.lit(f"level {level}"), *names))
    rows = rows.withColumn("_bucket", F.shiftright("_draw", 42).cast("int"))  # 1024 buckets
    sizes = rows.groupBy("_first", "_bucket").agg(F.count("*").alias("_n"))
    node = Window.partitionBy("_first")
    sizes = sizes.select("_first", "_bucket", (F.sum("_n").over(node.orderBy("_bucket")) - F.col("_n")).alias("_before"), F.sum("_n").over(node).alias("_all"))
    rank = F.row_number().over(Window.partitionBy("_first", "_bucket").orderBy("_draw", *names))
    rows = rows.withColumn("_rank", rank).join(sizes, ["_first", "_bucket"])
    left = F.floor((F.col("_shards") + 1) / 2).cast("int")
    quota = F.floor(F.col("_all") * left / F.col("_shards"))
    goes_left = (F.col("_before") + F.col("_rank") <= quota) | (F.col("_shards") == 1)
    return rows.select(
        *names, F.when(goes_left, F.col("_first")).otherwise(F.col("_first") + left).alias("_first"),
        F.when(F.col("_shards") == 1, F.lit(1)).when(goes_left, left).otherwise(F.col("_shards") - left).alias("_shards"),
    )
