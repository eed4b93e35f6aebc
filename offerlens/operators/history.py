"""Collection runs, availability and price history."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from offerlens.functions import fixed_values as FV
from offerlens.operators.windows import with_previous
from offerlens.schemas import COLS, Cols

MICROS_PER_HOUR = 3_600_000_000


def _slot(ts: str, gap_hours: int):
    """Number of the gap-wide time slot a stamp falls into."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    return F.floor(micros / F.lit(gap_hours * MICROS_PER_HOUR)).cast("long")


def _stamped(obs: DataFrame, keys: Cols) -> DataFrame:
    return obs.filter(F.col(keys.ts).isNotNull() & (F.coalesce(keys.seller, F.lit("")) != ""))


def run_slots(
    obs: DataFrame, gap_hours: int = FV.RUN_GAP_HOURS, keys: Cols = COLS
) -> DataFrame:
    """Run number of every non-empty (entity, slot).

    Slots are as wide as the gap, so all stamps inside one belong to one run, and a new run can
    only begin between one slot's last stamp and the next slot's first. That leaves one small row
    per slot to put in order, whatever number of observations an entity has. A gap of exactly
    ``gap_hours`` does not start a new run.
    """
    per_slot = (
        _stamped(obs, keys).groupBy(keys.entity, _slot(keys.ts, gap_hours).alias("slot"))
        .agg(
            F.min(keys.ts).alias("first_ts"),
            F.max(keys.ts).alias("last_ts"),
            F.count("*").alias("n_obs"),
        )
    )
    by_time = Window.partitionBy(keys.entity).orderBy("slot")
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    gap = micros(F.col("first_ts")) - micros(F.lag("last_ts").over(by_time))
    starts = F.coalesce(gap > gap_hours * MICROS_PER_HOUR, F.lit(True)).cast("int")
    return per_slot.withColumn("_starts", starts).withColumn(
        "run", F.sum("_starts").over(by_time).cast("int")
    ).drop("_starts")


def cluster_runs(obs: DataFrame, gap_hours: int = FV.RUN_GAP_HOURS, keys: Cols = COLS) -> DataFrame:
    """Collection runs per entity: span, observations and distinct sellers."""
    slots = run_slots(obs, gap_hours, keys)
    seen = (
        _stamped(obs, keys)
        .select(keys.entity, keys.seller, _slot(keys.ts, gap_hours).alias("slot")).distinct()
    )
    sellers = (
        seen.join(slots.select(keys.entity, "slot", "run"), [keys.entity, "slot"])
        .groupBy(keys.entity, "run").agg(F.count_distinct(keys.seller).alias("n_sellers"))
    )
    spans = slots.groupBy(keys.entity, "run").agg(
        F.min("first_ts").alias("run_start"),
        F.max("last_ts").alias("run_end"),
        F.sum("n_obs").alias("n_obs"),
    )
    return spans.join(sellers, [keys.entity, "run"])


def assign_runs(obs: DataFrame, gap_hours: int = FV.RUN_GAP_HOURS, keys: Cols = COLS) -> DataFrame:
    """Every stamped observation with its run number."""
    slots = run_slots(obs, gap_hours, keys).select(keys.entity, "slot", "run")
    return (
        _stamped(obs, keys).withColumn("slot", _slot(keys.ts, gap_hours))
        .join(slots, [keys.entity, "slot"]).drop("slot")
    )


def consecutive_misses(
    obs: DataFrame, gap_hours: int = FV.RUN_GAP_HOURS, keys: Cols = COLS
) -> DataFrame:
    """How many of the latest runs each seller was absent from."""
    slots = run_slots(obs, gap_hours, keys)
    last_seen = (
        _stamped(obs, keys).groupBy(*keys.pair).agg(F.max(keys.ts).alias("_last"))
        .withColumn("slot", _slot("_last", gap_hours))
    )
    newest = slots.groupBy(keys.entity).agg(F.max("run").alias("_newest"))
    return (
        last_seen.join(slots.select(keys.entity, "slot", "run"), [keys.entity, "slot"])
        .join(newest, keys.entity)
        .select(*keys.pair, (F.col("_newest") - F.col("run")).alias("misses"))
    )


def availability(misses: DataFrame, limit: int = FV.MISSED_RUNS_UNAVAILABLE) -> DataFrame:
    return misses.withColumn("unavailable", F.col("misses") >= limit)


def price_history(
    offers: DataFrame, active_sellers: DataFrame | None = None, keys: Cols = COLS
) -> DataFrame:
    """Per entity, day and seller: the lowest price of the last record of that day.

    The largest (record, -price) pair of a day is the lowest price of its last record, so one
    aggregation does both. Entities with a single record have no series; that is decided before
    sellers are filtered.
    """
    records = offers.groupBy(keys.entity).agg(
        (F.min(keys.ord) != F.max(keys.ord)).alias("_has_series")
    )
    rows = offers
    if active_sellers is not None:
        rows = rows.join(active_sellers.select(keys.seller).distinct(), keys.seller, "left_semi")
    daily = (
        rows.filter(F.col(keys.price) > 0)
        .groupBy(keys.entity, keys.date, keys.seller)
        .agg(F.max(F.struct(F.col(keys.ord).alias("o"), (-F.col(keys.price)).alias("p"))).alias("_m"))
        .select(keys.entity, keys.date, keys.seller, (-F.col("_m.p")).alias("price"))
    )
    return daily.join(records.filter("_has_series").select(keys.entity), keys.entity, "left_semi")


def history_matrix(
    history: DataFrame, sellers_seen: DataFrame, keys: Cols = COLS
) -> DataFrame:
    """Chart form: per entity the sorted days, and per seller one price array along them, with
    nulls where the seller has none. ``sellers_seen`` (entity, seller) adds sellers without any.

    Arrays are as long as the days on record, not as the observations.
    """
    days = history.groupBy(keys.entity).agg(F.array_sort(F.collect_set(keys.date)).alias("dates"))
    series = history.groupBy(*keys.pair).agg(
        F.map_from_entries(F.collect_list(F.struct(keys.date, "price"))).alias("_by_day")
    )
    sellers = sellers_seen.select(*keys.pair).distinct()
    return (
        sellers.join(days, keys.entity).join(series, keys.pair, "left")
        .select(
            *keys.pair,
            "dates",
            F.transform(
                "dates", lambda d: F.when(F.col("_by_day").isNotNull(), F.try_element_at("_by_day", d))
            ).alias("prices"),
        )
    )


def monthly_first_snapshot(snapshots: DataFrame, url: str = "url", ts: str = "snapshot_ts") -> DataFrame:
    """At most one archive snapshot per url and month: the earliest."""
    rest = [c for c in snapshots.columns if c not in (url, "yyyymm")]
    return (
        snapshots.groupBy(url, "yyyymm").agg(F.min_by(F.struct(*rest), ts).alias("_s"))
        .select(url, "yyyymm", "_s.*")
    )


def price_moves(offers: DataFrame, keys: Cols = COLS) -> DataFrame:
    """Every offer next to the price before it, per (entity, seller, tier)."""
    return with_previous(
        offers.filter(F.col(keys.price) > 0),
        [*keys.pair, keys.tier],
        F.col(keys.ord),
        keys.date,
        [keys.price],
        "old_",
    )


def price_drops(offers: DataFrame, n: int = 6, keys: Cols = COLS) -> DataFrame:
    """The largest drops between one price and the next."""
    old, new = F.col(f"old_{keys.price}"), F.col(keys.price)
    return (
        price_moves(offers, keys).filter(new < old)
        .withColumn("drop_pct", F.bround((1 - new / old) * 100).cast("int"))
        .orderBy(
            F.desc("drop_pct"), (old - new).desc(), keys.entity, keys.seller, keys.tier, keys.ord
        )
        .limit(n)
    )


def observed_index(offers: DataFrame, group: str = "category", keys: Cols = COLS) -> DataFrame:
    """Price level 1 (cheapest fifth) .. 5 of each calendar month, from observed prices: the month's
    average against the group's average over all months, in five equal classes."""
    cents = F.sum(F.col(keys.price).cast("decimal(18,2)"))
    monthly = offers.groupBy(group, F.month(keys.date).alias("month")).agg(
        cents.alias("_sum"), F.count("*").alias("_n")
    )
    whole = Window.partitionBy(group)
    average = (F.col("_sum") / F.col("_n")).cast("double")
    overall = (F.sum("_sum").over(whole) / F.sum("_n").over(whole)).cast("double")
    return monthly.select(
        group, "month", F.round(average / overall, 6).alias("ratio")
    ).withColumn(
        "level", F.ntile(5).over(Window.partitionBy(group).orderBy("ratio", "month"))
    )
