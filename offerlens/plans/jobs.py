"""The three daily jobs and the archive backfill, each as one plan over all entities.

Tables used by several outputs are written once (``cut_lineage``): to the folder the cluster names
for checkpoints, so they outlive executors.
"""
from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerlens.functions import fixed_values as FV
from offerlens.operators import catalog as K
from offerlens.operators import compare as A
from offerlens.operators import history as W
from offerlens.operators import joins as J
from offerlens.operators import pages as X
from offerlens.operators import quality as Q
from offerlens.operators import state as S
from offerlens.operators import store_products as SP
from offerlens.session import cut_lineage
from offerlens.sources.passes import Passes


@dataclass
class ComparisonTables:
    listings: DataFrame
    offers: DataFrame
    summary: DataFrame
    spread: DataFrame
    seller_order: DataFrame
    tier_deals: DataFrame
    best_deals: DataFrame
    history: DataFrame
    similar: DataFrame
    categories: DataFrame
    hero: DataFrame


def build_comparison(
    offers: DataFrame,
    sellers: DataFrame,
    promos: DataFrame,
    catalog: DataFrame,
    as_of: date,
    stale_days: int = FV.STALE_DAYS,
) -> ComparisonTables:
    """Everything the comparison pages show, for all active entities at once.

    catalog: entity_id, entity_ord, name, category, zones, active. The listings are computed once;
    every table reads them.
    """
    active = Q.active_only(catalog)
    known = offers.join(active.select("entity_id"), "entity_id", "left_semi")
    missed = W.availability(W.consecutive_misses(known))
    listings = A.current_listings(known, sellers, as_of, stale_days, missed)
    listings = cut_lineage(J.attach_promos(listings, promos))
    current = A.priced(listings)
    summary, spread = A.price_summary(listings), A.same_tier_spread(current)
    live = sellers.filter(F.coalesce("active", F.lit(True)))
    ranked = active.join(A.pre_lowest(known), "entity_id", "left")
    return ComparisonTables(
        listings=listings,
        offers=A.mark_best(current),
        summary=summary,
        spread=spread,
        seller_order=A.seller_order(listings),
        tier_deals=A.tier_deals(listings),
        best_deals=A.best_deals(listings),
        history=W.price_history(known, live),
        similar=A.similar_entities(ranked),
        categories=A.category_summary(active, summary),
        hero=A.hero_offer(spread, active),
    )


@dataclass
class CollectionResult:
    accepted: DataFrame
    quarantined: DataFrame
    snapshot: DataFrame
    stats: DataFrame
    status: DataFrame
    anomalies: DataFrame


def collect_run(
    fresh: DataFrame,
    results: DataFrame,
    handle_map: DataFrame,
    snapshot: DataFrame,
    keep_baseline: bool = False,
    previous: DataFrame | None = None,
) -> CollectionResult:
    """One collection run: gate fresh offers, update the price snapshot, report health.

    A seller ran if it has results or prices; its old snapshot rows go even if it found nothing.
    ``previous`` holds the stats of earlier runs, so health and status cover sellers that did not run.
    """
    gated = cut_lineage(Q.swing_gate(fresh, snapshot))
    ran = results.select("seller_id").unionByName(gated.select("seller_id")).distinct()
    stats = K.run_stats(handle_map.join(ran, "seller_id", "left_semi"), results, gated)
    stats = K.run_health(stats if previous is None else K.merge_stats(previous, stats))
    return CollectionResult(
        accepted=gated.filter("accepted"),
        quarantined=gated.filter(~F.col("accepted")),
        snapshot=Q.snapshot_after(gated, snapshot, keep_baseline, ran=ran),
        stats=stats,
        status=K.pipeline_health(stats),
        anomalies=K.anomaly_lines(gated),
    )


def recover_links(
    state: DataFrame,
    now: Column,
    catalog: DataFrame,
    sellers: DataFrame,
    products: DataFrame,
    snapshot: DataFrame,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One recovery run over all sellers: (new state, events with prices, summary)."""
    prices = SP.variant_price_map(products, ["seller_id", "handle"])
    expired, events, summary = S.recovery_pass(
        state, now, catalog, sellers, products, snapshot, prices
    )
    events = cut_lineage(events)
    columns = [f.split()[0] for f in S.EVENT.split(", ")]
    filled = events.withColumn("event_ord", F.lit(1).cast("long"))
    for c in columns:
        if c not in filled.columns:
            filled = filled.withColumn(c, F.lit(None).cast("string"))
    return S.link_state(filled.select(*columns), expired), events, summary


def archive_backfill(
    snapshots: DataFrame, progress: DataFrame, products: DataFrame, pages: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Dated prices out of archived pages: (records, progress after).

    snapshots: entity_id, seller_id, url, stamp, snapshot_ts, yyyymm; products (product documents)
    and pages (url, stamp, kind, html) hold what was fetched. One snapshot per url and month is
    used, done ones are skipped, and a product document is preferred over a page.
    """
    due = J.unprocessed(W.monthly_first_snapshot(snapshots), progress)
    done = progress.unionByName(due.select("entity_id", "seller_id", "yyyymm")).distinct()
    return _archived_prices(due, products, pages), done


AT = ["url", "stamp"]


def _archived_prices(due: DataFrame, products: DataFrame, pages: DataFrame) -> DataFrame:
    """The pages meet their snapshots once, and what is found in them keeps the snapshot's columns."""
    due = due.select(*AT, "entity_id", "seller_id", "snapshot_ts")
    from_docs = SP.offers_from_products(products.select(*AT, "variants").join(due, AT), due.columns).select(
        *due.columns, F.col("tier").alias("size"), "price", F.col("was_price").alias("regular_price"),
        F.lit("high").alias("confidence"),
    ).filter(~F.col("size").startswith("variant-"))
    rest = pages.select(*AT, "kind", "html").join(due, AT).join(from_docs.select(*AT).distinct(), AT, "left_anti")
    return from_docs.unionByName(X.archive_offers(rest, due.columns)).select(
        "entity_id",
        "seller_id",
        F.to_date("snapshot_ts").alias("obs_date"),
        "size",
        "price",
        "regular_price",
        F.concat_ws("/", F.lit("https://web.archive.org/web"), "stamp", "url").alias("archive_url"),
        "confidence",
    )


def _home(portions: int) -> Column:
    """The portion that a snapshot, page or product document falls into by itself."""
    return F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in AT]), F.lit(portions))


def _of_portion(fetched: DataFrame, portion: int, portions: int, away: DataFrame | None) -> DataFrame:
    """Rows at home in the portion, and those of the snapshots ``away``, which are at home in others."""
    own = fetched.filter(_home(portions) == portion)
    if away is None:
        return own
    return own.unionByName(fetched.filter(_home(portions) != portion).join(away.select(*AT), AT, "left_semi"))


PROGRESS = "entity_id STRING, seller_id STRING, yyyymm STRING"
ARCHIVED = (
    "entity_id STRING, seller_id STRING, obs_date DATE, size STRING, price DOUBLE, regular_price DOUBLE, "
    "archive_url STRING, confidence STRING"
)


def resume_backfill(
    passes: Passes, snapshots: DataFrame, products: DataFrame, pages: DataFrame, portions: int = 16, at_most: int | None = None
) -> int:
    """Run the archive backfill in up to ``portions`` passes of whole months, going on where an earlier run was cut off.

    Each pass commits its records and its progress together, so a month counts once and none is lost. A month is in the least
    portion that a snapshot of it falls into by the hash of its url and stamp, so a pass reads the pages of that hash and, only where
    a month has snapshots of several urls, looks for the others. Portions with nothing due take no pass. ``at_most`` ends the run
    after so many passes. Returns how many passes were committed.
    """
    month = ["entity_id", "seller_id", "yyyymm"]
    due = J.unprocessed(W.monthly_first_snapshot(snapshots), passes.read("progress", PROGRESS)).withColumn("_home", _home(portions))
    of_month = Window.partitionBy(*month).orderBy("_home")
    due = cut_lineage(due.withColumns({"_portion": F.first("_home").over(of_month), "_nth": F.row_number().over(of_month)}))
    is_away = F.col("_home") != F.col("_portion")
    found = due.groupBy("_portion").agg(F.count_if(is_away).alias("away")).orderBy("_portion").collect()  # a row per portion
    for portion, n_away in found[:at_most]:
        part = due.filter(F.col("_portion") == portion)
        away = part.filter(is_away) if n_away else None
        fetched = [_of_portion(x, portion, portions, away) for x in (products, pages)]
        number = passes.begin()
        passes.write(number, "records", _archived_prices(part, *fetched))
        passes.write(number, "progress", part.filter("_nth = 1").select(*month))
        passes.commit(number, part.agg(F.count("*").alias("snapshots")))
    return len(found[:at_most])


def archived_records(passes: Passes) -> DataFrame:
    """The records of all committed passes."""
    return passes.read("records", ARCHIVED)


STATS = ["seller_id", "expected", "found", "errors", "prices", "anomalies", "few_found"]


def run_collection(
    passes: Passes, fresh: DataFrame, results: DataFrame, handle_map: DataFrame, keep_baseline: bool = False
) -> CollectionResult:
    """One collection run from the last committed state to the next, with its writes: gate against the snapshot, file accepted
    and quarantined offers, write the snapshot after, health of all sellers, and the marker last.

    Read the outcome with ``passes.read('history', ...)`` (accepted offers of all runs), ``passes.newest('snapshot', ...)``
    and ``passes.newest('stats', ...)``. A run that is cut off counts for nothing and is simply run again.
    """
    shape = fresh.select("entity_id", "seller_id", "tier", "price").schema
    before = passes.newest("snapshot", shape)
    previous = None
    if passes.done():
        newest = passes.spark.read.parquet(passes._folder("stats", passes.done()[-1]))
        previous = newest.select(*[c for c in STATS if c in newest.columns])
    run = collect_run(fresh, results, handle_map, before, keep_baseline, previous)
    number = passes.begin()
    run.accepted = passes.write(number, "history", run.accepted)
    run.quarantined = passes.write(number, "quarantine", run.quarantined)
    run.snapshot = passes.write(number, "snapshot", run.snapshot.select(*shape.names))
    run.stats = passes.write(number, "stats", run.stats)
    run.anomalies = passes.write(number, "anomalies", run.anomalies)
    passes.commit(number, run.status)
    return run
