"""The whole jobs and the file stream, on small inputs."""
import datetime
import json

from pyspark.sql import functions as F

from offerlens.functions import tiers as T
from offerlens.operators import catalog as K
from offerlens.plans import jobs
from offerlens.schemas import VARIANT
from offerlens.sources import observations as O
from offerlens.streaming import jobs as ST


def write(tmp_path, name, rows):
    (tmp_path / f"{name}.jsonl").write_text("\n".join(json.dumps(r) for r in rows) + "\n")


def record(seller, stamp, sizes, stock=True):
    return {"retailer_id": seller, "retailer_name": seller, "timestamp": stamp, "url": f"https://{seller}/p", "sizes": sizes, "in_stock": stock}


def history(tmp_path):
    day = lambda d: f"2026-04-0{d}T10:00:00+00:00"
    write(tmp_path, "rose", [record("a", day(1), {"1gal": 30}), record("b", day(1), {"1gal": {"price": 20, "variant_id": 5}}),
                             record("a", day(2), {"1gal": 25, "quart": 12}), record("b", day(2), {"1gal": 22})])
    write(tmp_path, "fern", [record("a", day(1), {"1gal": 9}), record("b", day(1), {"1gal": 8}),
                             *[record("b", day(d), {"1gal": 8}) for d in (2, 3, 4)]])
    write(tmp_path, "old", [record("a", day(1), {"1gal": 1})])
    return str(tmp_path)


def test_build_comparison(spark, tmp_path):
    offers = O.explode_sizes(O.read_observations(spark, history(tmp_path)))
    sellers = spark.createDataFrame([("a", "A", True, True), ("b", "B", None, False)], "seller_id STRING, seller_name STRING, active BOOLEAN, has_affiliate BOOLEAN")
    promos = spark.createDataFrame([("a", ["SAVE10"], []), ("b", [], [])], "seller_id STRING, codes ARRAY<STRING>, banners ARRAY<STRING>")
    catalog = spark.createDataFrame([("rose", 1, "Rose", "shrubs", [5, 6], None), ("fern", 2, "Fern", "shrubs", [6, 7], True), ("old", 3, "Old", "x", [5], False)],
                                    "entity_id STRING, entity_ord INT, name STRING, category STRING, zones ARRAY<INT>, active BOOLEAN")
    t = jobs.build_comparison(offers, sellers, promos, catalog, datetime.date(2026, 4, 6))
    summary = {r["entity_id"]: r for r in t.summary.collect()}
    assert set(summary) == {"rose", "fern"} and (summary["rose"]["lowest_price"], summary["rose"]["highest_price"]) == (12.0, 25.0)
    spread = {r["entity_id"]: (r["tier"], r["pct"], r["seller_count"]) for r in t.spread.collect()}
    assert spread == {"rose": ("1gal", 12, 2), "fern": ("1gal", 11, 2)}
    assert t.hero.first()["entity_id"] == "rose"
    # fern: seller a missed three runs, so it is unavailable and comes last
    order = {(r["entity_id"], r["seller_id"]): (r["seller_rank"], r["seller_class"]) for r in t.seller_order.collect()}
    assert order[("fern", "a")] == (2, 3) and order[("rose", "a")] == (1, 0)
    assert {(r["entity_id"], r["deal_rank"], r["seller_id"]) for r in t.best_deals.collect()} == {
        ("rose", 1, "a"), ("rose", 2, "b"), ("rose", 3, "a"), ("fern", 1, "b"), ("fern", 2, "a")}
    assert {(r["entity_id"], r["tier"]) for r in t.tier_deals.collect()} == {("rose", "quart"), ("rose", "1gal"), ("fern", "1gal")}
    listing = t.listings.filter("entity_id = 'rose' AND seller_id = 'a'").first()
    assert listing["codes"] == ["SAVE10"]
    assert t.listings.filter("seller_id = 'b' AND codes IS NOT NULL").count() == 0
    assert [(r["entity_id"], r["similar_id"], r["zone_overlap"]) for r in t.similar.orderBy("entity_id").collect()] == [("fern", "rose", 1), ("rose", "fern", 1)]
    assert t.categories.first()["entity_count"] == 2 and t.history.count() == 9
    assert t.offers.filter("is_best").count() == 3


def test_collect_run(spark):
    offer = "entity_id STRING, seller_id STRING, tier STRING, price DOUBLE"
    fresh = spark.createDataFrame([("e", "s", "1gal", 90.0), ("f", "s", "1gal", 5.0)], offer)
    snap = spark.createDataFrame([("e", "s", "1gal", 40.0), ("g", "t", "1gal", 3.0)], offer)
    pairs = [(e, "s") for e in "efgh"]
    handles = spark.createDataFrame(pairs, "entity_id STRING, seller_id STRING")
    results = spark.createDataFrame([("e", "s", None), ("f", "s", None), ("g", "s", "HTTP 500")], "entity_id STRING, seller_id STRING, error STRING")
    run = jobs.collect_run(fresh, results, handles, snap)
    assert [r["entity_id"] for r in run.accepted.collect()] == ["f"] and run.quarantined.count() == 1
    assert {tuple(r) for r in run.snapshot.collect()} == {("f", "s", "1gal", 5.0), ("g", "t", "1gal", 3.0)}
    s = run.stats.first()
    assert (s["expected"], s["found"], s["errors"], s["prices"], s["anomalies"], s["health"]) == (4, 2, 1, 2, 1, "degraded")
    assert run.status.first()["pipeline_status"] == "degraded"
    assert run.anomalies.first()["line"] == "ANOMALY: e at s tier=1gal: $40.00 -> $90.00 (125% change)"


def test_collect_run_without_finds_and_with_earlier_runs(spark):
    offer = "entity_id STRING, seller_id STRING, tier STRING, price DOUBLE"
    snap = spark.createDataFrame([("e", "s", "1gal", 40.0), ("g", "t", "1gal", 3.0)], offer)
    handles = spark.createDataFrame([("e", "s"), ("g", "t")], "entity_id STRING, seller_id STRING")
    results = spark.createDataFrame([("e", "s", "HTTP 500")], "entity_id STRING, seller_id STRING, error STRING")
    earlier = spark.createDataFrame([("s", 1, 1, 0, 1, 0, False), ("t", 1, 1, 0, 4, 2, False)],
                                    "seller_id STRING, expected LONG, found LONG, errors LONG, prices LONG, anomalies LONG, few_found BOOLEAN")
    run = jobs.collect_run(spark.createDataFrame([], offer), results, handles, snap, previous=earlier)
    assert {tuple(r) for r in run.snapshot.collect()} == {("g", "t", "1gal", 3.0)}
    assert {(r["seller_id"], r["prices"], r["health"]) for r in run.stats.collect()} == {("s", 0, "degraded"), ("t", 4, "healthy")}
    assert run.status.first()["degraded_sellers"] == 1


def test_archive_backfill(spark):
    ts = lambda s: datetime.datetime.strptime(s, "%Y%m%d%H%M%S")
    snap = lambda e, url, stamp: (e, "s", url, stamp, ts(stamp), stamp[:6])
    snaps = spark.createDataFrame(
        [snap("rose", "u1", "20230510000000"), snap("rose", "u1", "20230520000000"), snap("rose", "u1", "20230601000000"), snap("fern", "u2", "20230501000000"),
         snap("fern", "u2", "20230701000000")],
        "entity_id STRING, seller_id STRING, url STRING, stamp STRING, snapshot_ts TIMESTAMP, yyyymm STRING")
    progress = spark.createDataFrame([("fern", "s", "202305")], "entity_id STRING, seller_id STRING, yyyymm STRING")
    v = [("1", "1 Gallon", "20", "25", None, None), ("2", "variant-1", "9", None, None, None)]
    products = spark.createDataFrame([("u1", "20230510000000", v)], f"url STRING, stamp STRING, variants ARRAY<{VARIANT}>")
    label = '<b aria-label="1 Quart - Sale price: 7.50 - List price: $9.00">'
    pages = spark.createDataFrame([("u1", "20230510000000", "page", label), ("u1", "20230520000000", "page", label), ("u1", "20230601000000", "page", label),
                                   ("u2", "20230501000000", "page", label)], "url STRING, stamp STRING, kind STRING, html STRING")
    records, done = jobs.archive_backfill(snaps, progress, products, pages)
    got = {(r["entity_id"], str(r["obs_date"]), r["size"], r["price"], r["regular_price"], r["confidence"]) for r in records.collect()}
    assert got == {("rose", "2023-05-10", "1gal", 20.0, 25.0, "high"), ("rose", "2023-06-01", "quart", 7.5, 9.0, "medium")}
    assert {tuple(r) for r in done.collect()} == {("fern", "s", "202305"), ("rose", "s", "202305"), ("rose", "s", "202306"), ("fern", "s", "202307")}


def test_stream_observations(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    path = history(src)
    (src / "bad.jsonl").write_text("{oops\n\n")
    stream = ST.stream_observations(spark, path)
    q = stream.writeStream.format("memory").queryName("obs_in").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.table("obs_in")
    assert rows.count() == 10 and {r[0] for r in rows.select("entity_id").distinct().collect()} == {"rose", "fern", "old"}
    assert O.explode_sizes(rows).filter("entity_id = 'rose'").count() == 5


def test_dedup_keeps_first_spelling(spark):
    df = spark.createDataFrame([("s", "Flash Sale", 2), ("s", "FLASH SALE", 1), ("s", "x", 3)], "k STRING, v STRING, o INT")
    assert {tuple(r) for r in K.keep_first_distinct(df, ["k"], "v", "o").select("v", "o").collect()} == {("FLASH SALE", 1), ("x", 3)}


def test_size_names(spark):
    df = spark.createDataFrame([("1 Gallon",), ("Red",), ("3-4 foot",), ("Bare stem",)], "n STRING")
    assert [r[0] for r in df.select(T.is_size_name(F.col("n"))).collect()] == [True, False, True, True]
