"""Kept tables, committed passes and landed files: state that is written, merged and read back."""
from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from gate import catalog as GC
from gate import compare as GA
from gate import extraction as GX
from gate import history as GH
from gate import matching as GM
from gate import quality as GQ
from gate import state as GS
from gate import tables as G
from gate.base import Gate
from offerlens.plans import jobs as P
from offerlens.session import checkpoint_dir
from offerlens.sources import kept as K
from offerlens.sources import kept_matches as KM
from offerlens.sources import observations as O
from offerlens.sources.passes import Passes
from offerlens.streaming import jobs as T

gate = Gate()
QUERIES, SQL = gate.queries, gate.sql
APPENDS = 3


def scratch(spark, name):
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


def appends(df, key):
    """Parts in no order of time, the second of them twice."""
    part = F.pmod(F.xxhash64(key), F.lit(APPENDS))
    return [df.filter(part == i) for i in (*range(APPENDS), 1)]


@gate("kept_latest", GA.SQL["latest_per_key"])
def kept_latest(spark, d):
    """The last record of each key, merged append by append, with late and repeated appends."""
    table = K.KeptTable(spark, scratch(spark, "latest"), ["user_id", "event_type"], 16)
    for part in appends(G.table(spark, d, "events"), "event_id"):
        K.merge_latest(table, part, ["ts", "event_id"])
    return table.read().select("user_id", "event_id", "event_type", "value")


@gate("kept_snapshot", GC.SQL["replace_by_key"])
def kept_snapshot(spark, d):
    """Sellers from 5 on are replaced in place, twice."""
    table = K.KeptTable(spark, scratch(spark, "snapshot"), ["seller_id"], 16)
    table.rebuild(GC.handle_map(spark, d))
    new = GC.handle_map(spark, d, True).filter(F.col("seller_id").cast("int") >= 5)
    for _ in range(2):
        K.replace_keys(table, new)
    return table.read().select(*GC.PAIR, "handle")


@gate("kept_mapping", GC.SQL["upsert_mapping"])
def kept_mapping(spark, d):
    table = K.KeptTable(spark, scratch(spark, "mapping"), GC.PAIR, 16)
    table.rebuild(GC.handle_map(spark, d).select(*GC.PAIR, "handle"))
    K.upsert_values(table, GC.handle_map(spark, d, True))
    return table.read()


@gate("kept_history", GH.SQL["price_history_events"])
def kept_history(spark, d):
    """Price history by day, merged append by append, with late and repeated appends."""
    kept = K.KeptHistory(spark, scratch(spark, "history"), 16)
    for part in appends(GH.event_obs(spark, d), "ord"):
        kept.merge(part)
    return kept.price_history().withColumn("obs_date", F.col("obs_date").cast("string"))


@gate("kept_matches", GM.SQL["best_matches"])
def kept_matches(spark, d):
    """Matches kept over changes: listings under other titles, listings and names that are gone later, one change twice."""
    kept = KM.KeptMatches(spark, scratch(spark, "matches"), buckets=16)
    names, listings = GM.entities(spark, d), GM.products(spark, d).drop("seller_id")
    later = F.pmod(F.xxhash64("product_ord"), F.lit(8)) == 0
    turned = listings.filter(later).withColumn("title", F.reverse("title"))
    extra = listings.filter(later).withColumn("product_ord", -F.col("product_ord") + (1 << 40))
    kept.change(listings.filter(~later).unionByName(turned).unionByName(extra), names=names.withColumn("name", F.lit("Old Name")))
    change = dict(products=listings.filter(later), gone=extra.select("product_ord"), names=names)
    for _ in range(2):
        kept.change(**change)
    return kept.best_matches()


@gate("collection_runs", GQ.SQL["snapshot_after"])
def collection_runs(spark, d):
    """Two collection runs with their writes. The second is cut off before its marker and run again."""
    fresh, first = GQ._run(spark, d)
    passes = Passes(spark, scratch(spark, "runs"))
    results = lambda offers: offers.select("entity_id", "seller_id", F.lit(None).cast("string").alias("error")).distinct()
    handles = results(first).drop("error")
    P.run_collection(passes, first, results(first), handles)
    lost = passes.begin()
    passes.write(lost, "snapshot", first.limit(0))
    passes.write(lost, "history", first)
    P.run_collection(passes, fresh, results(fresh), handles)
    return passes.newest("snapshot", first.schema).select("entity_id", "seller_id", "tier", "price")


@gate("archive_backfill", f"""WITH a AS ({GX.SQL["archive_offers"]})
SELECT l_orderkey || '-' || l_linenumber AS entity_id, 's' || CAST(l_linenumber % 3 AS VARCHAR) AS seller_id,
  '2023-' || LPAD(CAST(l_linenumber AS VARCHAR), 2, '0') || '-10' AS obs_date, size, price, regular_price, confidence FROM a""")
def archive_backfill(spark, d):
    """Archived pages in passes: one run ends after the first, one is cut off before its marker, the next goes on."""
    line = F.col("l_linenumber")
    url = F.concat_ws("-", F.col("l_orderkey").cast("string"), line.cast("string"))
    stamp = F.concat(F.lit("2023"), F.lpad(line.cast("string"), 2, "0"), F.lit("10000000"))
    pages = GX.archived_pages(spark, d).select(url.alias("url"), stamp.alias("stamp"), "kind", "html")
    listed = G.table(spark, d, "lineitem").select(url.alias("url"), stamp.alias("stamp"), "l_linenumber")  # not from the pages, to build no html
    snapshots = listed.select(
        "url", "stamp", F.col("url").alias("entity_id"), F.concat(F.lit("s"), (line % 3).cast("string")).alias("seller_id"),
        F.to_timestamp("stamp", "yyyyMMddHHmmss").alias("snapshot_ts"), F.substring("stamp", 1, 6).alias("yyyymm"))
    none = spark.createDataFrame([], f"url STRING, stamp STRING, variants ARRAY<{GX.VARIANT}>")
    passes = Passes(spark, scratch(spark, "archive"))
    run = lambda **most: P.resume_backfill(passes, snapshots, none, pages, portions=3, **most)
    run(at_most=1)
    lost = passes.begin()
    passes.write(lost, "records", P.archived_records(passes))
    run()
    return P.archived_records(passes).select(
        "entity_id", "seller_id", F.col("obs_date").cast("string").alias("obs_date"), "size", "price", "regular_price", "confidence")


def _landed(spark, d):
    base = scratch(spark, "landing")
    lines = GS.observation_lines(spark, d)
    step = F.pmod(F.xxhash64("entity_id", "ord"), F.lit(2))
    out = os.path.join(base, "out")
    entity = F.regexp_extract(F.col("_metadata.file_path"), r"/file=([^/]+)/", 1)
    for i in range(2):
        part = lines.filter(step == i).select("file", "value")
        part.hint("rebalance", "file").write.partitionBy("file").text(os.path.join(base, "in", f"seq={i}"), compression="gzip")
        q = T.land_observations(spark, os.path.join(base, "in"), out, os.path.join(base, "state"), max_files=100_000, entity=entity, glob="*.txt.gz")
        q.trigger(availableNow=True).start().awaitTermination()
    return out


@gate("stream_observations", GS.SQL["read_observations"].replace("CAST(entity_id AS VARCHAR)", "'f' || entity_id % 100"))
def stream_observations(spark, d):
    """Observation files that land in two appends; a file's name stands for its entity."""
    return O.explode_sizes(T.landed_observations(spark, _landed(spark, d))).select(
        "entity_id", "seller_id", F.col("obs_date").cast("string").alias("obs_date"), "raw_tier", "price", "was_price", "available", "variant_id")


@gate("stream_bad_lines", f"""WITH {G.OFFERS_SQL}, obs AS (SELECT DISTINCT entity_id, seller_id, ord FROM offers)
SELECT 'f' || entity_id % 100 AS entity_id, COUNT(*) AS bad_lines FROM obs WHERE entity_id % 13 = 0 AND ord % 2 = 0 GROUP BY 1""")
def stream_bad_lines(spark, d):
    return T.landed_bad_lines(spark, _landed(spark, d))
