"""Coverage, run reports, mappings and inventories."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens.functions import fixed_values as FV
from offerlens.functions.calendar import feedback_labels, long_date
from offerlens.functions.text import any_of
from offerlens.operators.joins import id_conflicts
from offerlens.schemas import COLS, Cols


def coverage_per_seller(offers: DataFrame, keys: Cols = COLS) -> DataFrame:
    """Prices and entities per seller."""
    per_pair = offers.groupBy(*keys.pair).agg(F.count("*").alias("n"))
    return per_pair.groupBy(keys.seller).agg(
        F.sum("n").alias("prices"), F.count("*").alias("entities")
    )


def coverage_levels(
    entities: DataFrame, offers: DataFrame, levels: tuple[int, ...] = (5, 3, 1), keys: Cols = COLS
) -> DataFrame:
    """How many entities have at least k sellers, and how many have none."""
    per_entity = (
        offers.select(*keys.pair).distinct().groupBy(keys.entity).agg(F.count("*").alias("n"))
    )
    n = F.coalesce("n", F.lit(0))
    return entities.join(per_entity, keys.entity, "left").agg(
        *[F.count_if(n >= k).alias(f"at_{k}_or_more") for k in levels],
        F.count_if(n == 0).alias("at_none"),
    )


def run_stats(
    expected: DataFrame, results: DataFrame, gated: DataFrame, keys: Cols = COLS
) -> DataFrame:
    """Per seller of a run: products expected, found and failed, prices, anomalies.

    expected: seller, entity (the handle map); results: seller, entity, error; gated: output of the
    swing gate.
    """
    planned = expected.groupBy(keys.seller).agg(F.count("*").alias("expected"))
    fetched = results.groupBy(keys.seller).agg(
        F.count_if(F.col("error").isNull()).alias("found"),
        F.count_if(F.col("error").isNotNull()).alias("errors"),
    )
    priced = gated.groupBy(keys.seller).agg(
        F.count("*").alias("prices"), F.count_if("is_anomaly").alias("anomalies")
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return (
        planned.join(fetched, keys.seller, "left").join(priced, keys.seller, "left")
        .select(
            keys.seller, "expected", zero("found"), zero("errors"), zero("prices"), zero("anomalies")
        )
        .withColumn("few_found", F.col("found") < F.col("expected") * FV.HEALTH_FLOOR)
    )


def merge_stats(previous: DataFrame, stats: DataFrame, keys: Cols = COLS) -> DataFrame:
    """Stats of all sellers after a run: those of the run are replaced, the others stay as they were."""
    kept = previous.join(stats.select(keys.seller).distinct(), keys.seller, "left_anti")
    return kept.select(*stats.columns).unionByName(stats)


def run_health(stats: DataFrame) -> DataFrame:
    """A seller is degraded below 80% found; nothing expected counts as all found."""
    rate = F.when(F.col("expected") == 0, 1.0).otherwise(F.col("found") / F.col("expected"))
    return stats.withColumn("hit_rate", rate).withColumn(
        "health", F.when(F.col("hit_rate") < FV.HEALTH_FLOOR, "degraded").otherwise("healthy")
    )


def pipeline_health(health: DataFrame) -> DataFrame:
    degraded = F.count_if(F.col("health") == "degraded")
    return health.agg(degraded.alias("degraded_sellers")).withColumn(
        "pipeline_status", F.when(F.col("degraded_sellers") > 0, "degraded").otherwise("healthy")
    )


def anomaly_lines(gated: DataFrame, keys: Cols = COLS) -> DataFrame:
    """One readable line per anomaly."""
    money = lambda c: F.concat(F.lit("$"), F.format_string("%.2f", c))
    return gated.filter("is_anomaly").select(
        *keys.pair,
        keys.tier,
        F.concat_ws(
            "",
            F.lit("ANOMALY: "), F.col(keys.entity).cast("string"), F.lit(" at "), F.col(keys.seller),
            F.lit(" tier="), F.col(keys.tier), F.lit(": "), money(F.col("old_price")), F.lit(" -> "),
            money(F.col(keys.price)), F.lit(" ("), F.bround("change_pct").cast("long").cast("string"),
            F.lit("% change)"),
        ).alias("line"),
    )


def snapshot_totals(stats: DataFrame) -> DataFrame:
    return stats.agg(
        F.coalesce(F.sum("prices"), F.lit(0)).alias("total_prices"),
        F.coalesce(F.sum("anomalies"), F.lit(0)).alias("total_anomalies"),
    )


def promo_count(promos: DataFrame) -> DataFrame:
    some = (F.coalesce(F.size("codes"), F.lit(0)) > 0) | (F.coalesce(F.size("banners"), F.lit(0)) > 0)
    return promos.agg(F.count_if(some).alias("sellers_with_promos"))


def feedback_enrich(items: DataFrame) -> DataFrame:
    """Display labels and dates for feedback items."""
    category = F.coalesce("category", F.lit("other"))
    status = F.coalesce("status", F.lit("reviewing"))
    category_label, status_label = feedback_labels(F.col("category"), status)
    return items.select(
        F.coalesce("id", F.lit("")).alias("id"),
        category.alias("category"),
        category_label.alias("category_label"),
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("body", F.lit("")).alias("body"),
        "submitted_at",
        long_date(F.col("submitted_at")).alias("submitted_date"),
        status.alias("status"),
        status_label.alias("status_label"),
        F.coalesce("upvotes", F.lit(0)).alias("upvotes"),
        "response",
        long_date(F.col("response.responded_at")).alias("response_date"),
    )


def feedback_board(items: DataFrame, status: str = "all", sort: str = "upvotes") -> DataFrame:
    shown = items if status == "all" else items.filter(F.col("status") == status)
    newest = F.coalesce("submitted_at", F.lit("")).desc()
    orders: dict[str, list[Column]] = {
        "upvotes": [F.desc("upvotes")],
        "newest": [newest],
        "responded": [F.col("response").isNull().asc(), newest],
    }
    return shown.orderBy(*orders[sort], "id")


def feedback_counts(items: DataFrame) -> DataFrame:
    return items.agg(
        F.count("*").alias("submissions"),
        F.count_if(F.col("response").isNotNull()).alias("responded"),
        F.count_if(F.col("status") == "done").alias("done"),
    )


def insert_if_absent(current: DataFrame, new: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Union that keeps existing mappings; also how many rows were added and skipped."""
    added = new.join(current.select(*keys), keys, "left_anti")
    known = current.select(*keys).distinct().withColumn("_known", F.lit(True))
    stats = new.join(known, keys, "left").agg(
        F.count_if(F.col("_known").isNull()).alias("added"),
        F.count_if(F.col("_known").isNotNull()).alias("skipped"),
    )
    return current.unionByName(added), stats


def upsert_mapping(current: DataFrame, new: DataFrame, keys: list[str], value: str = "handle") -> DataFrame:
    """Set mappings; the new value wins, and unknown keys are created."""
    fresh = new.select(*keys, F.col(value).alias("_new"))
    return current.join(fresh, keys, "full_outer").select(
        *keys, F.coalesce("_new", value).alias(value)
    )


def insert_batch(catalog: DataFrame, batch: DataFrame, key: str = "id") -> DataFrame:
    """All rows of the batch or none: any id already there fails the whole insert while it runs."""
    n = F.count("*")
    is_free = id_conflicts(catalog, batch, key).agg(
        F.when(n == 0, F.lit(True))
        .otherwise(F.raise_error(F.concat(n.cast("string"), F.lit(" ids already exist"))))
    )
    return catalog.unionByName(batch.filter(is_free.scalar()))


def patch_zone(catalog: DataFrame, entity: str, zone: int, spring: str, fall: str) -> DataFrame:
    """Add one zone and its planting window to an entry, if it is not there yet."""
    hit = F.col("id") == entity
    key = F.lit(str(zone))
    window = F.struct(
        F.lit(spring).alias("spring"), F.lit(fall).alias("fall"), F.lit(None).cast("string").alias("summer")
    )
    new_zone = hit & ~F.array_contains("zones", zone)
    new_season = hit & ~F.map_contains_key("planting_seasons", str(zone))
    return catalog.withColumn(
        "zones", F.when(new_zone, F.array_append("zones", F.lit(zone))).otherwise(F.col("zones"))
    ).withColumn(
        "planting_seasons",
        F.when(new_season, F.map_concat("planting_seasons", F.create_map(key, window)))
        .otherwise(F.col("planting_seasons")),
    )


def url_inventory(
    entities: DataFrame, categories: DataFrame, guides: DataFrame, lastmod: Column
) -> DataFrame:
    """Every published path once."""
    page = lambda df, folder, c: df.select(
        F.concat(F.lit(f"/{folder}/"), F.col(c).cast("string"), F.lit(".html")).alias("path")
    )
    # The fixed paths ride on one aggregated row, so an empty catalog still lists them.
    static = entities.agg(F.count("*")).select(F.explode(any_of(FV.STATIC_SITE_URLS)).alias("path"))
    paths = (
        static.unionByName(page(entities, "plants", "entity_id"))
        .unionByName(page(categories, "category", "category"))
        .unionByName(page(guides, "guides", "slug"))
    )
    return paths.distinct().withColumn("lastmod", lastmod)


def keep_first_distinct(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """First occurrence of each value per key, text compared without case."""
    return df.groupBy(*keys, F.lower(value).alias("_v")).agg(
        F.min_by(value, order).alias(value), F.min(order).alias(order)
    ).drop("_v")
