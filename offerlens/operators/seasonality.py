"""Price seasonality and planting windows per category."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens.functions import fixed_values as FV
from offerlens.functions.calendar import bit, mask_flags, month_mask

MAP_ZONES = range(3, 10)


def seasonal(catalog: DataFrame) -> DataFrame:
    """Entries with any seasonality: a price pattern or planting windows."""
    return catalog.filter(
        F.col("price_seasonality").isNotNull() | (F.coalesce(F.size("planting_seasons"), F.lit(0)) > 0)
    ).withColumn("category", F.coalesce("category", F.lit("uncategorized")))


def monthly_index(catalog: DataFrame) -> DataFrame:
    """Mean monthly price level per category, halves to even, kept within 1..5; 3 where no entry
    has a full year."""
    index = F.col("price_seasonality.monthly_index")
    per_month = (
        seasonal(catalog).filter(F.size(index) == 12)
        .select("category", F.posexplode(index).alias("m", "level"))
        .groupBy("category", "m")
        .agg(F.sum("level").alias("total"), F.count("*").alias("n"))
        .withColumn("level", F.least(F.lit(5), F.greatest(F.lit(1), F.bround(F.col("total") / F.col("n")).cast("int"))))
    )
    levels = per_month.groupBy("category").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("m", "level"))), lambda x: x.level).alias("own")
    )
    default = F.array(*[F.lit(3)] * 12)
    return (
        seasonal(catalog).select("category").distinct().join(levels, "category", "left")
        .select("category", F.coalesce("own", default).alias("monthly_index"))
    )


def category_tips(catalog: DataFrame, order: str = "entity_ord") -> DataFrame:
    """Buying advice of the first entry of each category that has any."""
    s = F.col("price_seasonality")
    told = F.coalesce(s.best_buy, F.lit("")) != ""
    advice = F.struct(s.best_buy.alias("best_buy"), s.worst_buy.alias("worst_buy"), s.tip.alias("tip"))
    blank = lambda c, default: F.when(F.coalesce(c, F.lit("")) != "", c).otherwise(default)
    return (
        seasonal(catalog).groupBy("category").agg(F.min_by(advice, F.when(told, F.col(order))).alias("a"))
        .select(
            "category",
            blank(F.col("a.best_buy"), "Fall").alias("best_buy"),
            blank(F.col("a.worst_buy"), "Spring").alias("worst_buy"),
            F.coalesce("a.tip", F.lit("")).alias("tip"),
        )
    )


def planting_masks(catalog: DataFrame) -> DataFrame:
    """Plantable months per category and zone, as bits. Every zone of the map is there."""
    rows = seasonal(catalog)
    spans = lambda s: [month_mask(s[f]) for f in FV.SEASON_FIELDS]
    windows = rows.select("category", F.explode("planting_seasons").alias("zone", "s"))
    a, b, c = spans(F.col("s"))
    united = windows.groupBy("category", F.col("zone").try_cast("int").alias("zone")).agg(
        F.bit_or(a.bitwiseOR(b).bitwiseOR(c)).alias("mask")
    )
    zones = F.array(*[F.lit(z) for z in MAP_ZONES])
    return (
        rows.select("category").distinct().withColumn("zone", F.explode(zones))
        .join(united, ["category", "zone"], "left")
        .withColumn("mask", F.coalesce("mask", F.lit(0)))
    )


def planting_windows(catalog: DataFrame) -> DataFrame:
    return planting_masks(catalog).select(
        "category", "zone", mask_flags(F.col("mask")).alias("plantable")
    )


def level_label(level: Column) -> Column:
    return F.when(level <= 2, "Low").when(level == 3, "Avg").otherwise("High")


def best_opportunity(catalog: DataFrame, zone: int) -> DataFrame:
    """Heat-map cells of one zone: level, label, plantable, and whether both are good."""
    levels = monthly_index(catalog).select(
        "category", F.posexplode("monthly_index").alias("m", "level")
    )
    masks = planting_masks(catalog).filter(F.col("zone") == zone).select("category", "mask")
    cells = levels.join(masks, "category")
    return cells.select(
        "category",
        (F.col("m") + 1).alias("month"),
        "level",
        level_label(F.col("level")).alias("label"),
        (F.col("mask").bitwiseAND(bit(F.col("m"))) != 0).alias("plantable"),
    ).withColumn("is_best", (F.col("level") <= 2) & F.col("plantable"))
