"""Filters, gates and data checks."""
from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerlens.functions import fixed_values as FV
from offerlens.functions import pricing as P
from offerlens.functions import tiers as T
from offerlens.functions.names import match_score
from offerlens.functions.text import all_groups, first_group, squeeze, unescape
from offerlens.operators.windows import top_per_group
from offerlens.schemas import COLS, Cols


def active_only(df: DataFrame, column: str = "active", missing_is_active: bool = True) -> DataFrame:
    """Catalog and seller filter. For collection and counts a missing flag means inactive."""
    return df.filter(F.coalesce(column, F.lit(missing_is_active)))


def drop_stale(
    df: DataFrame, as_of: date, days: int = FV.STALE_DAYS, column: str = "obs_date"
) -> DataFrame:
    """Rows last seen more than ``days`` ago go; rows without a readable date stay. Written as a
    bound on the column itself, so it can be pushed to a scan."""
    oldest = F.date_sub(F.lit(as_of), days)
    return df.filter(F.col(column).isNull() | (F.col(column) >= oldest))


def drop_packs(df: DataFrame, title: str) -> DataFrame:
    return df.filter(~F.coalesce(T.is_pack(F.col(title)), F.lit(False)))


def positive_price(df: DataFrame, column: str = "price") -> DataFrame:
    return df.filter(F.col(column) > 0)


def swing_gate(
    fresh: DataFrame,
    snapshot: DataFrame,
    limit_pct: float = FV.SWING_PCT,
    keys: Cols = COLS,
    listing: list[str] | None = None,
) -> DataFrame:
    """Fresh prices next to the last accepted ones, flagged where they moved by more than
    ``limit_pct``. One such size quarantines the whole listing (``accepted`` false on all its rows);
    ``listing`` names its columns where a pair was observed more than once.

    A quarantined listing gets no snapshot row, so with the plain snapshot update its next price
    has nothing to be compared with; see ``snapshot_after``.
    """
    old = snapshot.select(*keys.pair, keys.tier, F.col(keys.price).alias("old_price"))
    change = F.abs(F.col(keys.price) - F.col("old_price")) / F.col("old_price") * 100
    comparable = (F.col("old_price") > 0) & (F.col(keys.price) > 0)
    flagged = (
        fresh.join(old, [*keys.pair, keys.tier], "left")
        .withColumn("change_pct", F.when(comparable, change))
        .withColumn("is_anomaly", F.coalesce(F.col("change_pct") > limit_pct, F.lit(False)))
    )
    bad = F.max("is_anomaly").over(Window.partitionBy(*(listing or keys.pair)))
    return flagged.withColumn("accepted", ~bad)


def snapshot_after(
    gated: DataFrame,
    snapshot: DataFrame,
    keep_baseline: bool = False,
    keys: Cols = COLS,
    ran: DataFrame | None = None,
) -> DataFrame:
    """Price snapshot after a gated run. Sellers in the run are replaced: those of ``ran``, which
    also names sellers that ran and found nothing, or else those with gated rows. With
    ``keep_baseline`` the old prices of quarantined listings stay, so the next run still has
    something to compare."""
    columns = [*keys.pair, keys.tier, keys.price]
    ran = (gated if ran is None else ran).select(keys.seller).distinct()
    others = snapshot.join(ran, keys.seller, "left_anti").select(*columns)
    out = others.unionByName(gated.filter("accepted").select(*columns))
    if not keep_baseline:
        return out
    held = gated.filter(~F.col("accepted")).select(*keys.pair).distinct()
    return out.unionByName(snapshot.join(held, keys.pair, "left_semi").select(*columns))


def tier_extremes(df: DataFrame, group: list[str], price: str, ratio: float = FV.OUTLIER_RATIO) -> DataFrame:
    """Per group: rows, lowest and highest price, and both counts and highest after the top price
    is dropped where it is ``ratio`` times the next one (three prices needed).

    Rows n, low, high, n_kept. The two top prices come from a map-side-limited top-2, the rest from
    partial aggregates: no group is ever sorted whole.
    """
    totals = df.groupBy(*group).agg(F.count("*").alias("n"), F.min(price).alias("low"))
    tops = (
        top_per_group(df.select(*group, price), group, [F.desc(price)], 2)
        .groupBy(*group)
        .agg(F.max(price).alias("top"), F.min(price).alias("second"))
    )
    drop = (F.col("n") >= 3) & (F.col("second") > 0) & (F.col("top") / F.col("second") >= ratio)
    return totals.join(tops, group).select(
        *group,
        "n",
        (F.col("n") - drop.cast("int")).alias("n_kept"),
        "low",
        F.when(drop, F.col("second")).otherwise(F.col("top")).alias("high"),
        drop.alias("dropped_top"),
        "top",
    )


def drop_top_outlier(
    df: DataFrame, group: list[str], price: str = "price", ratio: float = FV.OUTLIER_RATIO
) -> DataFrame:
    """Rows without the one price that stands ``ratio`` times above the next in its group."""
    bad = tier_extremes(df, group, price, ratio).filter("dropped_top")
    return df.join(bad.select(*group, F.col("top").alias(price)), [*group, price], "left_anti")


def price_compare(
    stored: DataFrame,
    fresh: DataFrame,
    tolerance: float = FV.PRICE_TOLERANCE,
    keys: Cols = COLS,
    targets: DataFrame | None = None,
    fetched: DataFrame | None = None,
) -> DataFrame:
    """Stored against fresh prices per listing: PASS, MISMATCH, error, no_data or skip.

    A size that is gone from the fresh page is not a mismatch. ``fetched`` names the listings whose
    re-fetch gave a product; a listing outside it is an ``error``, by default one without fresh rows.
    ``targets`` adds listings to check that may have no stored price (``no_data``), and, with a null
    seller, entities that no eligible seller lists (``skip``).
    """
    stored = stored.filter(F.col(keys.seller).isNotNull())
    new = fresh.select(*keys.pair, keys.tier, F.col(keys.price).alias("fresh_price"))
    pairs = stored.join(new, [*keys.pair, keys.tier], "left")
    usable = (F.col(keys.price) > 0) & (F.col("fresh_price") > 0)
    diff = F.abs(F.col("fresh_price") - F.col(keys.price)) / F.col(keys.price)
    off = F.coalesce(usable & (diff > tolerance), F.lit(False))
    detail = F.struct(
        F.col(keys.tier).alias("tier"),
        F.col(keys.price).alias("stored"),
        F.col("fresh_price").alias("fresh"),
        F.bround(diff * 100, 1).alias("diff_pct"),
    )
    seen = fresh.groupBy(*keys.pair).agg(F.count("*").alias("fresh_tiers"))
    got = (fresh if fetched is None else fetched).select(*keys.pair).distinct().withColumn("_got", F.lit(True))
    checked = (
        pairs.groupBy(*keys.pair)
        .agg(
            F.count("*").alias("stored_tiers"),
            F.count_if(usable & ~off).alias("matches"),
            F.count_if(off).alias("mismatches"),
            F.array_sort(F.collect_list(F.when(off, detail))).alias("details"),
        )
        .join(seen, keys.pair, "left").join(got, keys.pair, "left")
        .withColumn(
            "status",
            F.when(F.col("_got").isNull(), "error")
            .when(F.col("mismatches") > 0, "MISMATCH")
            .otherwise("PASS"),
        )
        .withColumn("fresh_tiers", F.coalesce("fresh_tiers", F.lit(0)))
        .drop("_got")
    )
    if targets is None:
        return checked
    rest = targets.select(*keys.pair).distinct().join(stored.select(*keys.pair), keys.pair, "left_anti")
    rest = rest.select(
        *keys.pair, F.lit(0).alias("stored_tiers"),
        F.when(F.col(keys.seller).isNull(), "skip").otherwise("no_data").alias("status"),
    )
    return checked.unionByName(rest, allowMissingColumns=True).fillna(
        0, ["fresh_tiers", "matches", "mismatches"]
    )


def eligible_seller(mapped: DataFrame, sellers: DataFrame, entities: DataFrame, seed: int, keys: Cols = COLS) -> DataFrame:
    """Per entity one of the sellers that list it and can be re-fetched, at random by ``seed``; a null
    seller where there is none. ``sellers`` holds the eligible ones."""
    usable = mapped.select(*keys.pair).join(sellers.select(keys.seller).distinct(), keys.seller, "left_semi")
    chosen = usable.groupBy(keys.entity).agg(
        F.min_by(keys.seller, F.struct(seeded_order(keys.pair, seed), keys.seller)).alias(keys.seller)
    )
    return entities.select(keys.entity).distinct().join(chosen, keys.entity, "left")


def seeded_order(columns: list[str], seed: int) -> Column:
    """Pseudo-random order by the MD5 of the columns and the seed."""
    return F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns], F.lit(str(seed))))


def verification_sample(
    listings: DataFrame, n: int, seed: int, keys: Cols = COLS
) -> DataFrame:
    """``n`` entities at random, with one random seller each. The same seed gives the same sample."""
    per_entity = listings.groupBy(keys.entity).agg(
        F.min_by(keys.seller, F.struct(seeded_order(keys.pair, seed), keys.seller)).alias(keys.seller)
    )
    return per_entity.orderBy(seeded_order([keys.entity], seed), keys.entity).limit(n)


def verification_summary(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count("*").alias("checked"),
        F.count_if(F.col("status") == "PASS").alias("passed"),
        F.count_if(F.col("status") == "MISMATCH").alias("failed"),
        F.count_if(F.col("status") == "error").alias("errors"),
        F.count_if(~F.col("status").isin("PASS", "MISMATCH", "error")).alias("skipped"),
    ).withColumn("is_failure", F.col("failed") > 0)


def halt_decision(results: DataFrame, limit: float = 0.2) -> DataFrame:
    """Stop the build when more than ``limit`` of the checks failed."""
    failed = (F.col("status") == "MISMATCH").cast("double")
    return results.agg(F.coalesce(F.avg(failed), F.lit(0.0)).alias("failed_share")).withColumn(
        "halt", F.col("failed_share") > limit
    )


def sanity_flags(
    offers: DataFrame, is_large_kind: Column | None = None, keys: Cols = COLS
) -> DataFrame:
    """Offers with something wrong, and what. ``is_large_kind`` marks kinds (trees) whose price
    may well pass 500."""
    price, was, tier = F.col(keys.price), F.col(keys.was_price), F.col(keys.tier)
    small_kind = ~is_large_kind if is_large_kind is not None else F.lit(True)
    rules = [
        ("price_over_500", small_kind & (price > 500)),
        ("price_over_1000", price > 1000),
        ("price_under_3", price < 3),
        ("was_not_above_price", was <= price),
        ("unresolved_tier", tier.rlike(r"^variant-")),
    ]
    flags = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules]))
    return offers.withColumn("flags", flags).filter(F.size("flags") > 0)


REQUIRED = ["id", "common_name", "botanical_name", "category", "sun", "mature_size", "type"]


def catalog_checks(
    catalog: DataFrame, handle_map: DataFrame, categories: DataFrame, min_sellers: int = 2
) -> DataFrame:
    """One row per (entry, broken rule)."""
    mapped = (
        handle_map.groupBy("entity_id").agg(F.count_distinct("seller_id").alias("n_sellers"))
        .withColumnRenamed("entity_id", "id")
    )
    ids = catalog.groupBy("id").agg((F.count("*") > 1).alias("is_duplicate"))
    known = categories.select("category").distinct().withColumn("known_category", F.lit(True))
    index = F.col("price_seasonality.monthly_index")
    zones = F.col("zones")
    season_keys = F.map_keys(F.coalesce("planting_seasons", F.map_from_arrays(F.array(), F.array())
                                        .cast("map<string,struct<spring:string,fall:string,summer:string>>")))
    no = F.lit(False)
    rules = [
        *[(f"missing_{c}", F.col(c).isNull()) for c in REQUIRED],
        ("duplicate_id", F.col("is_duplicate")),
        ("id_not_kebab", ~F.col("id").rlike("^[a-z0-9]+(-[a-z0-9]+)*$")),
        ("unknown_category", F.col("known_category").isNull()),
        ("zones_not_sorted", ~(zones == F.array_sort(zones))),
        ("zones_out_of_range", F.exists(zones, lambda z: ~z.between(1, 13))),
        (
            "season_missing_for_zone",
            F.size(F.array_except(F.transform(zones, lambda z: z.cast("string")), season_keys)) > 0,
        ),
        ("index_not_12", index.isNull() | (F.size(index) != 12)),
        ("index_out_of_range", F.exists(index, lambda v: ~v.between(1, 5))),
        ("mapped_at_few_sellers", F.coalesce("n_sellers", F.lit(0)) < min_sellers),
    ]
    broken = F.array_compact(
        F.array(*[F.when(F.coalesce(rule, no), F.lit(name)) for name, rule in rules])
    )
    return (
        catalog.join(ids, "id").join(known, "category", "left").join(mapped, "id", "left")
        .select("id", F.explode(broken).alias("violation"))
    )


def page_title(html: Column) -> Column:
    """Text of the first <title>, up to the first bar."""
    return squeeze(unescape(F.substring_index(first_group(html, FV.PAGE_TITLE_PATTERN), "|", 1)))


def title_mismatch(pages: DataFrame, expected: DataFrame, floor: float = 0.5) -> DataFrame:
    """Pages whose title does not look like the name they are filed under (url -> name)."""
    titles = pages.select(*[c for c in pages.columns if c != "html"], page_title(F.col("html")).alias("page_title"))
    scored = titles.join(expected, "url")
    score = match_score(F.col("name"), F.coalesce("page_title", F.lit("")))
    return scored.withColumn("title_score", score).filter(F.col("title_score") < floor)


def page_links(pages: DataFrame, page_key: str = "url") -> DataFrame:
    return pages.select(
        page_key, F.explode(all_groups(F.col("html"), r'href="([^"]*)"')).alias("href")
    )


def broken_internal_links(pages: DataFrame, known_paths: DataFrame, page_key: str = "url") -> DataFrame:
    """Links within the site whose target is no known page, with how often each page has them."""
    internal = page_links(pages, page_key).filter(F.col("href").startswith("/")).withColumn(
        "path", F.substring_index(F.substring_index("href", "#", 1), "?", 1)
    )
    return (
        internal.groupBy(page_key, "path").agg(F.count("*").alias("n_links"))
        .join(known_paths.select("path").distinct(), "path", "left_anti")
    )
