"""Attribute votes over several sources, and catalog drafts made from them."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens.functions import fixed_values as FV
from offerlens.functions.text import any_of, squeeze

Resolver = Callable[[Column, Column, Column], Column]


def majority_value(
    votes: DataFrame, group: list[str], whole: Column | None = None, with_candidates: bool = False
) -> DataFrame:
    """Vote per group. votes: group.., value, src_pos. Text is compared lower-case with single
    blanks, and the winner is given in its first spelling; ``whole`` marks votes compared as they
    are. Two aggregations: spellings are counted before groups are, so a group of many sources
    arrives as a few counts. ``with_candidates`` adds all spellings, for a resolver to choose from.
    """
    loose = squeeze(F.lower("value"))
    norm = loose if whole is None else F.when(whole, F.col("value")).otherwise(loose)
    spellings = (
        votes.filter(F.col("value").isNotNull()).groupBy(*group, norm.alias("norm"))
        .agg(
            F.count("*").alias("n"),
            F.min("src_pos").alias("pos"),
            F.min_by("value", "src_pos").alias("value"),
        )
    )
    top = F.max(F.struct(F.col("n"), (-F.col("pos")).alias("late"), F.col("value").alias("v")))
    every = F.array_sort(F.collect_list(F.struct("pos", "value"))) if with_candidates else F.max(
        F.lit(None).cast("array<struct<pos:int,value:string>>")
    )
    return spellings.groupBy(*group).agg(
        F.sum("n").alias("n_sources"),
        F.min_by("value", "pos").alias("first_value"),
        top.alias("top"),
        every.alias("candidates"),
    ).select(
        *group,
        "n_sources",
        "first_value",
        F.transform("candidates", lambda c: c.value).alias("candidates"),
        F.when(
            (F.col("top.n") >= 3)
            | ((F.col("top.n") == F.col("n_sources")) & (F.col("n_sources") >= 2)),
            F.col("top.v"),
        ).alias("majority"),
    )


def reconcile(
    entities: DataFrame,
    votes: DataFrame,
    fields: list[str] | None = None,
    resolve: Resolver | None = None,
) -> DataFrame:
    """Value of every field of every entity, how it was found, and whether to review it.

    No or one source: fallback, flagged. Three equal votes, or all equal: majority. Else a
    tiebreak, not flagged. ``resolve(field, candidates, name)`` decides the first and the last
    case; by default the first value is taken.
    """
    fields = fields or FV.RECONCILED_FIELDS
    counted = majority_value(votes, ["entity_id", "field"], F.col("field") == "zones", resolve is not None)
    grid = entities.select("entity_id", "name", F.explode(any_of(fields)).alias("field"))
    rows = grid.join(counted, ["entity_id", "field"], "left")
    n = F.coalesce("n_sources", F.lit(0))
    none = F.array().cast("array<string>")
    picked = (
        resolve(F.col("field"), F.coalesce("candidates", none), F.col("name"))
        if resolve
        else F.col("first_value")
    )
    return rows.select(
        "entity_id",
        "field",
        F.when((n >= 2) & F.col("majority").isNotNull(), F.col("majority")).otherwise(picked).alias("value"),
        F.when(n < 2, "fallback").when(F.col("majority").isNotNull(), "majority")
        .otherwise("tiebreak").alias("source"),
        (n < 2).alias("flagged"),
    )


def draft_entries(catalog: DataFrame, reconciled: DataFrame) -> DataFrame:
    """Catalog drafts: reconciled fields side by side, size template by kind of category, inactive,
    with the fields that need review."""
    wide = reconciled.groupBy("entity_id").agg(
        *[
            F.max(F.when(F.col("field") == f, F.col("value"))).alias(f)
            for f in FV.RECONCILED_FIELDS
        ],
        F.collect_set(F.when(F.col("flagged"), F.col("field"))).alias("_flagged"),
    )
    terms = lambda table: F.create_map(
        *[x for tier, words in table.items() for x in (F.lit(tier), any_of(words))]
    )
    is_tree = F.col("category").isin(FV.TREE_CATEGORIES)
    template = F.when(is_tree, terms({**FV.POT_SIZE_TERMS, **FV.BAREROOT_SIZE_TERMS}))
    return catalog.join(wide, "entity_id").select(
        "entity_id", "name", "botanical", "category",
        *FV.RECONCILED_FIELDS,
        template.otherwise(terms(FV.POT_SIZE_TERMS)).alias("size_tiers"),
        F.lit("").alias("price_range"),
        F.lit(False).alias("active"),
        F.filter(any_of(FV.RECONCILED_FIELDS), lambda f: F.array_contains("_flagged", f)).alias("review_flags"),
    )
