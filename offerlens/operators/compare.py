"""The comparison table: what each seller asks for each size now, who is cheapest, what is saved."""
from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerlens.functions import fixed_values as FV
from offerlens.functions import pricing as P
from offerlens.functions import tiers as T
from offerlens.functions import urls as U
from offerlens.functions.calendar import bit
from offerlens.operators.quality import drop_stale, tier_extremes
from offerlens.operators.windows import magnitude, split_rank, top_per_group
from offerlens.schemas import COLS, Cols

CLASS_PRICED, CLASS_NO_PRICE, CLASS_SOLD_OUT, CLASS_UNAVAILABLE = 0, 1, 2, 3


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last record of each key, in ingest order. One aggregation: map tasks keep one record
    per key before anything is shuffled."""
    rest = [c for c in df.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(last.alias("_r")).select(*keys, "_r.*").select(*df.columns)


def latest_offers(offers: DataFrame, keys: Cols = COLS) -> DataFrame:
    """All sizes of the last observation of each (entity, seller).

    Rows of one observation share their position, so they share rank 1. Spark applies the rank
    limit in every map task, so only a task's newest observation of each pair is shuffled.
    """
    newest_first = Window.partitionBy(*keys.pair).orderBy(F.col(keys.ord).desc())
    return (
        offers.withColumn("_rank", F.rank().over(newest_first)).filter("_rank = 1").drop("_rank")
    )


def fold_tiers(latest: DataFrame, keys: Cols = COLS) -> DataFrame:
    """Raw sizes that mean the same tier become one row: the cheapest, the earlier one on a tie.

    ``first_price`` is the price listed first for the tier. Later prices only ever replace it with
    lower ones, so it is the highest price this seller contributes for the tier.
    Listings without any usable price stay as one row with a null tier.
    """
    usable = P.positive_price(F.col(keys.price))
    tier = F.when(usable, T.canonical_tier(F.col("raw_tier"))).alias(keys.tier)
    per_offer = ["raw_tier", keys.price, keys.was_price, "available", "variant_id"]
    fixed = [
        c for c in latest.columns if c not in {*keys.pair, keys.tier, *per_offer, "pos"}
    ]
    offer = F.struct(*[F.when(usable, F.col(c)).alias(c) for c in per_offer if c in latest.columns])
    return (
        latest.groupBy(*keys.pair, tier)
        .agg(
            F.min_by(offer, F.struct(keys.price, "pos")).alias("_o"),
            F.min_by(F.when(usable, F.col(keys.price)), "pos").alias("first_price"),
            F.min("pos").alias("first_pos"),
            *[F.any_value(c).alias(c) for c in fixed],
        )
        .select(*keys.pair, keys.tier, "_o.*", "first_price", "first_pos", *fixed)
    )


def current_listings(
    offers: DataFrame,
    sellers: DataFrame,
    as_of: date,
    stale_days: int = FV.STALE_DAYS,
    availability: DataFrame | None = None,
    keys: Cols = COLS,
) -> DataFrame:
    """Last observation of each (entity, active seller), not stale, folded to canonical tiers.

    ``sellers`` has one row per seller with its name and terms; ``active`` missing means active.
    ``availability`` (entity, seller, misses, unavailable) marks sellers that missed several runs.
    """
    live = sellers
    if "active" in sellers.columns:
        live = sellers.filter(F.coalesce("active", F.lit(True))).drop("active")
    latest = drop_stale(latest_offers(offers, keys), as_of, stale_days, keys.date)
    folded = fold_tiers(latest, keys).join(live, keys.seller)
    if availability is None:
        return folded.withColumn("unavailable", F.lit(False))
    missed = availability.select(*keys.pair, F.col("unavailable").alias("_missed"))
    return (
        folded.join(missed, keys.pair, "left")
        .withColumn(
            "unavailable",
            F.coalesce("_missed", F.lit(False)) & F.col(keys.date).isNotNull(),
        )
        .drop("_missed")
    )


def priced(listings: DataFrame, keys: Cols = COLS) -> DataFrame:
    return listings.filter(F.col(keys.tier).isNotNull())


def current_offers(
    offers: DataFrame,
    sellers: DataFrame,
    as_of: date,
    stale_days: int = FV.STALE_DAYS,
    availability: DataFrame | None = None,
    keys: Cols = COLS,
) -> DataFrame:
    return priced(current_listings(offers, sellers, as_of, stale_days, availability, keys), keys)


def _newest_first(keys: Cols) -> list[Column]:
    return [F.col(keys.ord).desc(), F.col(keys.seller)]


def best_per_tier(current: DataFrame, keys: Cols = COLS) -> DataFrame:
    """Cheapest seller of each (entity, tier) that can be bought from; the most recently observed
    one on a tie. The fallback tier has no best price."""
    open_offers = current.filter(
        P.buyable(F.col(keys.in_stock)) & ~F.col("unavailable") & T.is_visible_tier(F.col(keys.tier))
    )
    return top_per_group(
        open_offers, [keys.entity, keys.tier], [F.col(keys.price), *_newest_first(keys)]
    )


def mark_best(current: DataFrame, keys: Cols = COLS) -> DataFrame:
    """Every offer with ``is_best`` and, per listing, ``has_best_price``.

    The winner is found in place, so the offers are worked out and dealt out by entity once. An entity has one row
    per seller and tier.
    """
    is_open = F.coalesce(
        P.buyable(F.col(keys.in_stock)) & ~F.col("unavailable") & T.is_visible_tier(F.col(keys.tier)), F.lit(False)
    )
    by_rank = Window.partitionBy(keys.entity, keys.tier).orderBy(
        F.col("_open").desc(), F.col(keys.price), *_newest_first(keys)
    )
    winner = F.first(F.when(F.col("_open"), F.col(keys.seller))).over(by_rank)
    known = F.col(keys.entity).isNotNull()  # null keys match nothing
    return (
        current.withColumn("_open", is_open).repartition(keys.entity)
        .withColumn("_winner", winner)
        .withColumn("is_best", F.coalesce(known & (F.col("_winner") == F.col(keys.seller)), F.lit(False)))
        .withColumn("has_best_price", F.max("is_best").over(Window.partitionBy(*keys.pair)))
        .drop("_open", "_winner")
    )


def price_summary(listings: DataFrame, keys: Cols = COLS) -> DataFrame:
    """Lowest, highest and savings per entity over everything listed: sold-out, unavailable and
    fallback-tier prices count here."""
    per_seller = listings.groupBy(*keys.pair).agg(
        F.min(keys.price).alias("lo"),
        F.max("first_price").alias("hi"),
        F.any_value(P.buyable(F.col(keys.in_stock))).alias("open"),
        F.any_value(~F.col("has_affiliate")).alias("plain"),
    )
    return (
        per_seller.groupBy(keys.entity)
        .agg(
            F.min("lo").alias("lowest_price"),
            F.max("hi").alias("highest_price"),
            F.count("*").alias("offer_count"),
            F.bool_or("open").alias("any_in_stock"),
            F.bool_or("plain").alias("has_non_affiliate"),
        )
        .withColumn(
            "savings_pct",
            F.coalesce(P.savings_pct(F.col("lowest_price"), F.col("highest_price")), F.lit(0)),
        )
    )


def same_tier_spread(current: DataFrame, keys: Cols = COLS) -> DataFrame:
    """Savings inside one tier: the tier with the most sellers, then the largest spread.

    Sold-out offers are left out, unavailable ones and the fallback tier are not. A tier needs two
    sellers before its outlier is dropped; the seller count shown is the one after.
    """
    open_offers = current.filter(P.buyable(F.col(keys.in_stock)))
    group = [keys.entity, keys.tier]
    spread = tier_extremes(open_offers, group, keys.price).filter("n >= 2")
    scored = spread.select(
        *group,
        F.col("n_kept").alias("seller_count"),
        "low",
        "high",
        P.savings_pct(F.col("low"), F.col("high")).alias("pct"),
        T.tier_rank(F.col(keys.tier)).alias("_rank"),
    )
    picked = top_per_group(
        scored, [keys.entity], [F.desc("seller_count"), F.desc("pct"), F.asc("_rank")]
    )
    return picked.drop("_rank").withColumn("tier_label", T.tier_label(F.col(keys.tier)))


def with_seller_class(listings: DataFrame, keys: Cols = COLS) -> DataFrame:
    """Display class of a listing and its lowest price in a tier that is shown."""
    shown = F.when(
        F.col(keys.tier).isNotNull() & T.is_visible_tier(F.col(keys.tier)), F.col(keys.price)
    )
    lowest_shown = F.min(shown).over(Window.partitionBy(*keys.pair))
    return listings.withColumn("shown_price", lowest_shown).withColumn(
        "seller_class",
        F.when(F.col("unavailable"), CLASS_UNAVAILABLE)
        .when(~P.buyable(F.col(keys.in_stock)), CLASS_SOLD_OUT)
        .when(F.col("shown_price").isNull(), CLASS_NO_PRICE)
        .otherwise(CLASS_PRICED),
    ).withColumn("shown_price", F.when(F.col("seller_class") == CLASS_PRICED, F.col("shown_price")))


def seller_order(listings: DataFrame, keys: Cols = COLS) -> DataFrame:
    """Rows in display order: priced by lowest shown price, no shown price, sold out, unavailable."""
    rows = (
        with_seller_class(listings, keys)
        .groupBy(*keys.pair)
        .agg(
            *[F.any_value(c).alias(c) for c in ("seller_class", "shown_price", keys.ord)]
        )
    )
    coarse = F.struct(
        F.col("seller_class").alias("c"), F.coalesce(magnitude(F.col("shown_price")), F.lit(0)).alias("m")
    )
    order = [F.col("seller_class"), F.col("shown_price").asc_nulls_last(), *_newest_first(keys)]
    return split_rank(rows, [keys.entity], coarse, order, "seller_rank").drop(keys.ord)


def _deals(listings: DataFrame, keys: Cols) -> DataFrame:
    """Priced offers of shown tiers from sellers not sold out, with their link."""
    deals = with_seller_class(listings, keys).filter(
        P.buyable(F.col(keys.in_stock))
        & F.col(keys.tier).isNotNull()
        & T.is_visible_tier(F.col(keys.tier))
    )
    return deals.withColumn("deal_url", U.variant_url(F.col("url"), F.col("variant_id"))).withColumn(
        "sale_flag", P.sale_flag(F.col(keys.was_price))
    )


def _display_order(keys: Cols) -> list[Column]:
    return [F.col("seller_class"), F.col("shown_price").asc_nulls_last(), *_newest_first(keys)]


def tier_deals(listings: DataFrame, keys: Cols = COLS) -> DataFrame:
    """Cheapest deal of each tier; sellers shown first win ties. Tiers that read like ids are left
    out."""
    top = top_per_group(
        _deals(listings, keys),
        [keys.entity, keys.tier],
        [F.col(keys.price), *_display_order(keys)],
    )
    return top.withColumn("label", T.tier_label(F.col(keys.tier))).filter(
        ~F.col("label").rlike(r"\d{7,}")
    )


def best_deals(listings: DataFrame, n: int = 3, keys: Cols = COLS) -> DataFrame:
    """Best deal (rank 1) and runners-up over all tiers and sellers."""
    ranked = _deals(listings, keys).withColumn("_tier_rank", T.tier_rank(F.col(keys.tier)))
    order = [F.col(keys.price), F.col("_tier_rank"), *_display_order(keys)]
    return top_per_group(ranked, [keys.entity], order, n, "deal_rank").drop("_tier_rank")


def default_variant(current: DataFrame, keys: Cols = COLS) -> DataFrame:
    """Variant behind each listing's main link: that of its cheapest size."""
    return current.groupBy(*keys.pair).agg(
        F.min_by("variant_id", F.struct(keys.price, "first_pos")).alias("default_variant_id")
    )


def comparison_matrix(
    current: DataFrame, tiers: list[str] | None = None, keys: Cols = COLS
) -> DataFrame:
    """Sellers x tiers. The tier columns are a fixed list, so no pass is spent finding them."""
    columns = tiers or [t for t in FV.TIER_ORDER if t != FV.HIDDEN_TIER]
    return current.groupBy(*keys.pair).pivot(keys.tier, columns).agg(F.min(keys.price))


def category_summary(catalog: DataFrame, prices: DataFrame, keys: Cols = COLS) -> DataFrame:
    """Entities and price range per category. Ranges compare as numbers."""
    return (
        catalog.join(prices, keys.entity, "left")
        .groupBy("category")
        .agg(
            F.count("*").alias("entity_count"),
            F.min("lowest_price").alias("range_low"),
            F.max("highest_price").alias("range_high"),
        )
    )


def hero_offer(spread: DataFrame, entities: DataFrame, keys: Cols = COLS) -> DataFrame:
    """The entity with the largest same-tier spread; the first listed wins a tie."""
    return (
        spread.filter("high > low AND pct > 0").join(entities, keys.entity)
        .orderBy(F.desc("pct"), F.asc("entity_ord"))
        .limit(1)
    )


def pre_lowest(offers: DataFrame, keys: Cols = COLS) -> DataFrame:
    """Lowest price over the last observations of all sellers, before any filter."""
    return (
        latest_offers(offers, keys).filter(P.positive_price(F.col(keys.price)))
        .groupBy(keys.entity).agg(F.min(keys.price).alias("lowest_price"))
    )


def similar_entities(entities: DataFrame, n: int = 5, keys: Cols = COLS) -> DataFrame:
    """Up to ``n`` others of the category: most shared zones first, then cheapest, unknown last.

    ``entities``: entity, category, zones, lowest_price, entity_ord. Zones are small integers, so
    a category has few distinct zone sets however many entities it has. The best n+1 entities of
    each set are kept, sets are compared with sets, and every entity reads the list of its set.
    """
    packed = entities.withColumn(
        "zone_mask",
        F.aggregate("zones", F.lit(0), lambda acc, z: acc.bitwiseOR(bit(z))),
    )
    order = [F.col("lowest_price").asc_nulls_last(), F.col("entity_ord")]
    heads = top_per_group(packed, ["category", "zone_mask"], order, n + 1).select(
        "category",
        F.col("zone_mask").alias("other_mask"),
        F.col(keys.entity).alias("similar_id"),
        F.col("lowest_price"),
        F.col("entity_ord"),
    )
    masks = packed.select("category", "zone_mask").distinct()
    overlap = F.bit_count(F.col("zone_mask").bitwiseAND(F.col("other_mask")))
    by_set = ["category", "zone_mask"]
    candidates = masks.join(heads, "category").withColumn("overlap", overlap)
    ranked = top_per_group(candidates, by_set, [F.desc("overlap"), *order], n + 1, "_r")
    lists = ranked.groupBy(*by_set).agg(
        F.array_sort(F.collect_list(F.struct("_r", "similar_id", "overlap", "lowest_price"))).alias("c")
    )
    others = F.slice(F.filter("c", lambda x: x.similar_id != F.col(keys.entity)), 1, n)
    return (
        packed.join(lists, by_set)
        .select(keys.entity, F.posexplode(others).alias("rank0", "s"))
        .select(
            keys.entity,
            (F.col("rank0") + 1).alias("similar_rank"),
            "s.similar_id",
            F.col("s.overlap").alias("zone_overlap"),
            F.col("s.lowest_price").alias("similar_price"),
        )
    )


def browse(
    entities: DataFrame, category: str | None, zone: int | None, sort: str = "name"
) -> DataFrame:
    """A category page: filter by zone, sort by name, price or savings. A missing price sorts as
    999, missing savings as 0."""
    out = entities
    if category is not None:
        out = out.filter(F.col("category") == category)
    if zone is not None:
        out = out.filter(F.array_contains("zones", zone))
    price = F.coalesce("lowest_price", F.lit(999.0))
    sorts = {
        "name": F.asc("name"),
        "price-low": price.asc(),
        "price-high": price.desc(),
        "savings": F.coalesce("savings_pct", F.lit(0)).desc(),
    }
    return out.orderBy(sorts[sort], "entity_ord")
