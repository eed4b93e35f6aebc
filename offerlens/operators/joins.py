"""Joins between offers, sellers, promotions, catalog, handle map and published pages.

No join carries a broadcast hint: Spark broadcasts a side when its measured size is under the
session's threshold and sorts and merges otherwise, splitting skewed keys where both sides are dealt out for the join alone.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlens.functions import fixed_values as FV
from offerlens.operators.windows import top_per_group
from offerlens.schemas import COLS, Cols


def with_sellers(obs: DataFrame, sellers: DataFrame, keys: Cols = COLS) -> DataFrame:
    """Observations of active sellers with the seller's columns; unknown sellers are dropped."""
    active = sellers.filter(F.coalesce("active", F.lit(True))).drop("active")
    return obs.join(active, keys.seller)


def attach_promos(rows: DataFrame, promos: DataFrame, keys: Cols = COLS) -> DataFrame:
    """Left join; a promotion without codes and banners counts as none."""
    some = promos.filter((F.size("codes") > 0) | (F.size("banners") > 0))
    return rows.join(some.select(keys.seller, "codes", "banners"), keys.seller, "left")


def handles_for(catalog: DataFrame, handle_map: DataFrame, keys: Cols = COLS) -> DataFrame:
    """Catalog entities each seller carries, with the seller's handle."""
    return catalog.join(handle_map.select(keys.seller, keys.entity, "handle"), keys.entity)


def with_snapshot(fresh: DataFrame, snapshot: DataFrame, keys: Cols = COLS) -> DataFrame:
    old = snapshot.select(*keys.pair, keys.tier, F.col(keys.price).alias("old_price"))
    return fresh.join(old, [*keys.pair, keys.tier], "left")


def stored_and_fresh(stored: DataFrame, fresh: DataFrame, keys: Cols = COLS) -> DataFrame:
    new = fresh.select(*keys.pair, keys.tier, F.col(keys.price).alias("fresh_price"))
    return stored.join(new, [*keys.pair, keys.tier])


def unmapped(entities: DataFrame, handle_map: DataFrame, on: list[str]) -> DataFrame:
    return entities.join(handle_map.select(*on), on, "left_anti")


def unprocessed(snapshots: DataFrame, progress: DataFrame, keys: Cols = COLS) -> DataFrame:
    """Archive snapshots whose (entity, seller, month) was not handled yet."""
    on = [*keys.pair, "yyyymm"]
    return snapshots.join(progress.select(*on), on, "left_anti")


def stale_pages(pages: DataFrame, active_entities: DataFrame, keys: Cols = COLS) -> DataFrame:
    """Published pages whose entity is no longer active."""
    return pages.join(active_entities.select(keys.entity), keys.entity, "left_anti")


def id_conflicts(catalog: DataFrame, batch: DataFrame, key: str = "id") -> DataFrame:
    return batch.join(catalog.select(key), key, "left_semi")


def guide_for_category(
    categories: DataFrame, guides: DataFrame, guide_category: DataFrame
) -> DataFrame:
    """The guide of each category, or the fallback guide.

    guides: slug, title; guide_category: slug, category. The fallback is a scalar subquery.
    """
    dedicated = (
        guides.join(guide_category.filter(F.col("category").isNotNull()), "slug")
        .groupBy("category")
        .agg(F.max_by(F.struct("slug", "title"), "slug").alias("own"))
    )
    guide = F.struct("slug", "title")
    fallback = guides.filter(F.col("slug") == FV.FALLBACK_GUIDE).agg(F.max(guide)).scalar()
    return (
        categories.select("category").distinct().join(dedicated, "category", "left")
        .withColumn("guide", F.coalesce("own", fallback))
        .select("category", F.col("guide.slug").alias("guide_slug"), F.col("guide.title").alias("guide_title"))
    )


def related_entities(
    guide_category: DataFrame, entities: DataFrame, n: int = 10, keys: Cols = COLS
) -> DataFrame:
    """First ``n`` entities of a guide's category; a guide for no category shows the first of all.

    The first ``n`` per category and overall are cut before guides are joined.
    """
    columns = [keys.entity, "entity_ord"]
    per_category = top_per_group(
        entities.select("category", *columns), ["category"], [F.col("entity_ord")], n
    )
    overall = (
        entities.select(*columns).orderBy("entity_ord").limit(n)
        .select(F.lit(None).cast("string").alias("category"), *columns)
    )
    heads = per_category.unionByName(overall)
    g = guide_category.alias("g")
    joined = g.join(heads.alias("h"), F.col("g.category").eqNullSafe(F.col("h.category")))
    return joined.select("g.slug", f"h.{keys.entity}", "h.entity_ord")


def of_scraper_type(entries: DataFrame, sellers: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """Entries whose seller is of one type, and how many were skipped."""
    tagged = entries.join(sellers.select("seller_id", "scraper_type"), "seller_id", "left")
    is_kind = F.coalesce(F.col("scraper_type") == kind, F.lit(False))
    return (
        tagged.filter(is_kind).drop("scraper_type"),
        tagged.agg(F.count_if(~is_kind).alias("skipped")),
    )


def field_diff(current: DataFrame, extracted: DataFrame, fields: list[str], key: str = "id") -> DataFrame:
    """Per entity and field: current against extracted value, compared as text, null equal to null."""
    pair = lambda f: F.struct(
        F.lit(f).alias("field"),
        F.col(f"c.{f}").cast("string").alias("current_value"),
        F.col(f"x.{f}").cast("string").alias("extracted_value"),
    )
    joined = current.alias("c").join(extracted.alias("x"), F.col(f"c.{key}") == F.col(f"x.{key}"))
    return (
        joined.select(F.col(f"c.{key}").alias(key), F.explode(F.array(*[pair(f) for f in fields])).alias("d"))
        .select(key, "d.*")
        .withColumn(
            "verdict",
            F.when(F.col("current_value").eqNullSafe(F.col("extracted_value")), "MATCH").otherwise("DIFF"),
        )
    )
