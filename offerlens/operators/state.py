"""Snapshot upserts and the state of broken product links.

A link's state is what its events leave behind. The fold is written as aggregates over events. No
task holds a link's events at once, but the joins with these aggregates bring them to one partition, which
adaptive execution doesn't split; ``streaming.keyed`` folds them as they come instead:

* everything up to the last ``applied`` event is forgotten;
* events before the first one that creates an entry have no effect;
* ``redirect`` starts the attempt count anew;
* ``broken`` has no effect while a candidate or a confirmed link is in flight, which is decided by
  the last status event before it.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerlens.functions import fixed_values as FV
from offerlens.operators.joins import of_scraper_type
from offerlens.operators.matching import best_replacement

LINK = ["seller_id", "entity_id"]
CREATING = ["broken", "redirect", "discovery"]
IN_FLIGHT = ["redirect_candidate", "discovery_candidate", "confirmed"]
PENDING = ["redirect_candidate", "discovery_candidate"]
REPORTABLE = ["unrecoverable", "rejected", "confirmation_failed"]
FAILED_REASON = "Confirmed handle still returns 404"

EVENT = (
    "seller_id STRING, entity_id STRING, event_ord BIGINT, event_ts TIMESTAMP, event STRING, "
    "old_handle STRING, new_handle STRING, redirect_url STRING, verdict STRING, reason STRING, "
    "common_name STRING, botanical_name STRING, candidate_title STRING, match_score DOUBLE"
)
STATE_COLUMNS = [
    "old_handle", "status", "candidate_handle", "redirect_url", "attempts", "last_discovery_attempt",
    "created_at", "updated_at", "common_name", "botanical_name", "candidate_title", "match_score",
    "reason",
]


def replace_by_key(prev: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Snapshot merge: all rows of the keys in ``new`` are replaced, others stay."""
    return prev.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def _status_of(event: Column) -> Column:
    """Status an event sets whatever came before; null for events that depend on it."""
    return (
        F.when(event == "redirect", "redirect_candidate")
        .when(event == "discovery", "discovery_candidate")
        .when(event == "verdict", F.col("verdict"))
        .when(event == "confirm_failed", "confirmation_failed")
        .when(event == "unrecoverable", "unrecoverable")
        .when(event == "state", F.col("status0"))
    )


def _as_events(events: DataFrame, prev: DataFrame | None) -> DataFrame:
    """Events, with a link's earlier state (if any) as an event before all others."""
    extra = ["status0", "attempts0", "created0", "attempted0"]
    plain = events.select(
        "*",
        F.lit(None).cast("string").alias("status0"),
        F.lit(None).cast("int").alias("attempts0"),
        F.lit(None).cast("timestamp").alias("created0"),
        F.lit(None).cast("timestamp").alias("attempted0"),
    )
    if prev is None:
        return plain
    before = prev.select(
        *LINK,
        F.lit(-1).cast("long").alias("event_ord"),
        F.col("updated_at").alias("event_ts"),
        F.lit("state").alias("event"),
        "old_handle",
        F.col("candidate_handle").alias("new_handle"),
        "redirect_url",
        F.lit(None).cast("string").alias("verdict"),
        "reason", "common_name", "botanical_name", "candidate_title", "match_score",
        F.col("status").alias("status0"),
        F.col("attempts").alias("attempts0"),
        F.col("created_at").alias("created0"),
        F.col("last_discovery_attempt").alias("attempted0"),
    )
    return plain.unionByName(before.select(*events.columns, *extra))


def _with_status_before(live: DataFrame) -> DataFrame:
    """Last definite status before each event: inside the day by a window, across days by a table
    of one row per link and day."""
    live = live.withColumn("_sets", _status_of(F.col("event"))).withColumn(
        "_day", F.when(F.col("event_ord") < 0, F.lit(-1)).otherwise(
            F.unix_date(F.col("event_ts").cast("date"))
        )
    )
    inside = Window.partitionBy(*LINK, "_day").orderBy("event_ord").rowsBetween(
        Window.unboundedPreceding, -1
    )
    earlier_days = Window.partitionBy(*LINK).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        live.groupBy(*LINK, "_day")
        .agg(F.max_by("_sets", F.when(F.col("_sets").isNotNull(), F.col("event_ord"))).alias("_last"))
        .withColumn("_carry", F.last("_last", ignorenulls=True).over(earlier_days))
        .drop("_last")
    )
    return (
        live.withColumn("_in_day", F.last("_sets", ignorenulls=True).over(inside))
        .join(carried, [*LINK, "_day"])
        .withColumn("status_before", F.coalesce("_in_day", "_carry"))
        .drop("_in_day", "_carry", "_day")
    )


def link_state(events: DataFrame, prev: DataFrame | None = None) -> DataFrame:
    """Fold link events into one state row per link.

    ``event_ord`` orders the events of a link, without ties, and agrees with ``event_ts``. A
    verdict is 'confirmed' or 'rejected'.
    """
    every = _as_events(events, prev)
    kind, ord_ = F.col("event"), F.col("event_ord")
    last_applied = every.groupBy(*LINK).agg(
        F.max(F.when(kind == "applied", ord_)).alias("_applied")
    )
    open_events = every.join(last_applied, LINK).filter(
        F.col("_applied").isNull() | (ord_ > F.col("_applied"))
    )
    marks = open_events.groupBy(*LINK).agg(
        F.min(F.when(kind.isin(*CREATING, "state"), ord_)).alias("_created"),
        F.max(F.when(kind == "redirect", ord_)).alias("_redirected"),
    )
    live = open_events.drop("_applied").join(marks, LINK).filter(ord_ >= F.col("_created"))
    rows = _with_status_before(live)

    broken = (kind == "broken") & ~F.coalesce(F.col("status_before").isin(*IN_FLIGHT), F.lit(False))
    written = broken | kind.isin("redirect", "discovery", "state")
    has_effect = (kind != "broken") | broken
    counted = kind.isin("attempt", "discovery") & (
        F.col("_redirected").isNull() | (ord_ > F.col("_redirected"))
    )
    carried = (kind == "state") & F.col("_redirected").isNull()
    latest = lambda value, when: F.max_by(value, F.when(when, ord_))
    # A field of the last full write, if that was an event which fills it.
    kept = lambda c, *kinds: latest(F.when(kind.isin(*kinds, "state"), F.col(c)), written)
    states = rows.groupBy(*LINK).agg(
        F.coalesce(latest(F.col("old_handle"), broken | kind.isin("redirect", "state")), F.lit("")).alias("old_handle"),
        latest(F.coalesce("_sets", F.lit("broken")), F.col("_sets").isNotNull() | broken).alias("status"),
        kept("new_handle", "redirect", "discovery").alias("candidate_handle"),
        kept("redirect_url", "redirect").alias("redirect_url"),
        (F.count_if(counted) + F.coalesce(F.max(F.when(carried, F.col("attempts0"))), F.lit(0)))
        .cast("int").alias("attempts"),
        latest(
            F.when(kind == "state", F.col("attempted0")).otherwise(F.col("event_ts")), counted | carried
        ).alias("last_discovery_attempt"),
        F.min_by(F.coalesce("created0", "event_ts"), ord_).alias("created_at"),
        latest(F.col("event_ts"), has_effect).alias("updated_at"),
        *[
            kept(c, "discovery").alias(c)
            for c in ("common_name", "botanical_name", "candidate_title", "match_score")
        ],
        latest(
            F.when(kind.isin("verdict", "unrecoverable", "state"), F.col("reason"))
            .when(kind == "confirm_failed", FAILED_REASON),
            written | kind.isin("verdict", "confirm_failed", "unrecoverable"),
        ).alias("reason"),
    )
    return states.select(*LINK, *STATE_COLUMNS)


def actionable(
    state: DataFrame, now: Column, cooldown_hours: int = FV.COOLDOWN_HOURS, limit: int = FV.MAX_ATTEMPTS
) -> DataFrame:
    """Broken links with attempts left whose last attempt lies at least the cooldown back."""
    last = F.col("last_discovery_attempt")
    rested = last <= now - F.expr(f"INTERVAL {cooldown_hours} HOURS")
    return state.filter(
        (F.col("status") == "broken") & (F.coalesce("attempts", F.lit(0)) < limit) & (last.isNull() | rested)
    )


def expire(state: DataFrame, now: Column, limit: int = FV.MAX_ATTEMPTS) -> DataFrame:
    """Broken links out of attempts become unrecoverable."""
    out = (F.col("status") == "broken") & (F.coalesce("attempts", F.lit(0)) >= limit)
    return (
        state.withColumn("_out", out)
        .withColumn("status", F.when(F.col("_out"), "unrecoverable").otherwise(F.col("status")))
        .withColumn("updated_at", F.when(F.col("_out"), now).otherwise(F.col("updated_at")))
        .withColumn(
            "reason",
            F.when(F.col("_out"), f"No candidate found after {limit} attempts").otherwise(F.col("reason")),
        )
        .drop("_out")
    )


def pending(state: DataFrame) -> DataFrame:
    return state.filter(F.col("status").isin(*PENDING))


def confirmed(state: DataFrame) -> DataFrame:
    return state.filter(F.col("status") == "confirmed")


def reportable(state: DataFrame) -> DataFrame:
    return state.filter(F.col("status").isin(*REPORTABLE))


def attention_report(state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What needs a person: one line per link, and counts per status."""
    named = lambda c: F.when(F.coalesce(c, F.lit("")) != "", F.col(c))
    is_final = F.col("status") == "unrecoverable"
    lines = reportable(state).select(
        "status",
        *LINK,
        F.coalesce(named("common_name"), named("entity_id"), F.lit("Unknown")).alias("item"),
        F.coalesce("old_handle", F.lit("N/A")).alias("old_handle"),
        F.when(is_final, F.col("attempts")).alias("attempts"),
        F.when(~is_final, F.coalesce("candidate_handle", F.lit("N/A"))).alias("candidate_handle"),
        F.coalesce("reason", F.lit("")).alias("reason"),
    )
    return lines, lines.groupBy("status").agg(F.count("*").alias("links"))


def recovery_pass(
    state: DataFrame,
    now: Column,
    catalog: DataFrame,
    sellers: DataFrame,
    products: DataFrame,
    snapshot: DataFrame,
    variant_prices: DataFrame,
    seller_type: str = "shopify",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One recovery run: expire, pick what is due, look for replacements.

    Returns (expired state, events to fold with ``link_state``, summary). A due link gets a
    discovery event if a candidate was found, else an attempt, also when its entity is unknown.
    """
    gone = (F.col("status") == "broken") & (F.coalesce("attempts", F.lit(0)) >= FV.MAX_ATTEMPTS)
    expired = expire(state, now)
    due, skipped = of_scraper_type(actionable(expired, now), sellers, seller_type)
    found = best_replacement(due, catalog, products, snapshot, variant_prices)
    hit = F.col("candidate_handle_new").isNotNull()
    events = (
        due.select(*LINK, "old_handle")
        .join(
            found.select(
                *LINK,
                F.col("candidate_handle").alias("candidate_handle_new"),
                "candidate_title", "match_score", "common_name", "botanical_name",
                "old_prices", "candidate_prices",
            ),
            LINK,
            "left",
        )
        .select(
            *LINK,
            F.when(hit, "discovery").otherwise("attempt").alias("event"),
            now.alias("event_ts"),
            "old_handle",
            F.col("candidate_handle_new").alias("new_handle"),
            "candidate_title", "match_score", "common_name", "botanical_name",
            "old_prices", "candidate_prices",
        )
    )
    totals = events.agg(
        F.count("*").alias("entries_processed"),
        F.count_if(F.col("event") == "discovery").alias("candidates_found"),
    )
    marked = state.agg(F.count_if(gone).alias("marked_unrecoverable"))
    summary = totals.select(
        "*", marked.scalar().alias("marked_unrecoverable"), skipped.scalar().alias("skipped")
    )
    return expired, events, summary


def apply_validated(
    state: DataFrame, sellers: DataFrame, probes: DataFrame, now: Column
) -> tuple[DataFrame, DataFrame]:
    """Outcome of probing confirmed links. probes: seller, entity, status_code, has_product.

    Returns (handle rows to upsert, link events). Links without a handle, of an unknown seller or
    without an answer are left as they are.
    """
    usable = (
        confirmed(state).filter(F.coalesce("candidate_handle", F.lit("")) != "")
        .join(sellers.select("seller_id"), "seller_id", "left_semi")
        .join(probes.filter(F.col("status_code").isNotNull()), LINK)
    )
    good = (F.col("status_code") == 200) & F.coalesce("has_product", F.lit(False))
    handles = usable.filter(good).select(*LINK, F.col("candidate_handle").alias("handle"))
    events = usable.select(
        *LINK, F.when(good, "applied").otherwise("confirm_failed").alias("event"), now.alias("event_ts")
    )
    return handles, events
