"""Golden values on a small observation history: two sellers of one item, and special cases."""
import datetime
import json

import pytest
from pyspark.sql import functions as F

from offerlens.operators import compare as A
from offerlens.operators import history as W
from offerlens.operators import quality as Q
from offerlens.sources import observations as O
from offerlens.sources import records as R

AS_OF = datetime.date(2026, 4, 6)


def line(seller, stamp, sizes, stock=True, **more):
    return json.dumps({"retailer_id": seller, "retailer_name": seller.upper(), "timestamp": stamp,
                       "url": f"https://{seller}/p?variant=9", "sizes": sizes, "in_stock": stock, **more})


def size(price, was=None, vid=1, raw="x"):
    return {"price": price, "was_price": was, "available": True, "raw_size": raw, "variant_id": vid}


@pytest.fixture()
def folder(tmp_path):
    a1 = {"quart": size(15.99), "1gal": size(29.99, vid=1002), "3gal": size(54.99)}
    b1 = {"1gal": size(39.99, 49.99), "3gal": size(69.99)}
    files = {
        "hydrangea": [
            line("a", "2026-03-30T10:00:00+00:00", a1), line("b", "2026-03-30T10:30:00+00:00", b1, False),
            "", "{not json", line("a", "2026-04-01T10:00:00+00:00", a1),
            line("b", "2026-04-01T10:30:00+00:00", b1, False)],
        "stale": [line("a", "2026-02-15T10:00:00+00:00", {"1gal": 10})],
        "aliases": [line("a", "2026-04-02T10:00:00Z", {"#1-container": 20.0, "1-gallon": size(18.0, vid=7), "1gal": 19.0,
                                                       "variant-12345678": 5, "2gal": -1, "3gal": None})],
        "empty": [line("a", "2026-04-02T10:00:00Z", {}), line("zz", "2026-04-02T10:00:00Z", {"1gal": 1.0})],
    }
    for name, rows in files.items():
        (tmp_path / f"{name}.jsonl").write_text("\n".join(rows) + "\n", encoding="utf-8")
    return str(tmp_path)


@pytest.fixture()
def sellers(spark):
    return spark.createDataFrame(
        [("a", "A", True, True), ("b", "B", None, False), ("c", "C", False, True)],
        "seller_id STRING, seller_name STRING, active BOOLEAN, has_affiliate BOOLEAN")


def listings(spark, folder, sellers):
    offers = O.explode_sizes(O.read_observations(spark, folder))
    return A.current_listings(offers, sellers, AS_OF)


def by(df, *keys):
    return {tuple(r[k] for k in keys): r.asDict() for r in df.collect()}


def test_reading(spark, folder):
    obs = O.read_observations(spark, folder)
    assert obs.count() == 8
    assert obs.filter("entity_id = 'hydrangea'").orderBy("ord").select("seller_id").collect()[-1][0] == "b"
    assert O.read_observations(spark, folder + "/missing").count() == 0
    with pytest.raises(Exception):
        O.read_observations(spark, folder, on_bad="fail").collect()


def test_price_summary(spark, folder, sellers):
    got = by(A.price_summary(listings(spark, folder, sellers)), "entity_id")
    h = got[("hydrangea",)]
    assert (h["lowest_price"], h["highest_price"], h["savings_pct"], h["offer_count"]) == (15.99, 69.99, 77, 2)
    assert h["any_in_stock"] and h["has_non_affiliate"]
    assert ("stale",) not in got
    # 20 was listed first for the tier and counts as its highest, 19 never does; -1 and null are no prices
    al = got[("aliases",)]
    assert (al["lowest_price"], al["highest_price"], al["offer_count"]) == (5.0, 20.0, 1)


def test_fold(spark, folder, sellers):
    rows = by(A.priced(listings(spark, folder, sellers)).filter("entity_id = 'aliases'"), "tier")
    assert set(rows) == {("1gal",), ("default",)}
    assert (rows[("1gal",)]["price"], rows[("1gal",)]["variant_id"]) == (18.0, "7")


def test_empty_listing_counts(spark, folder, sellers):
    obs = O.read_observations(spark, folder)
    # an observation without sizes has no offer rows; unknown sellers are dropped
    assert obs.filter("entity_id = 'empty'").count() == 2
    assert listings(spark, folder, sellers).filter("entity_id = 'empty'").count() == 0


def test_same_tier_needs_two_in_stock(spark, folder, sellers):
    spread = by(A.same_tier_spread(A.priced(listings(spark, folder, sellers))), "entity_id")
    assert ("hydrangea",) not in spread


@pytest.mark.parametrize("prices,pct,n", [((20, 25, 100), 20, 2), ((20, 25, 40), 50, 3), ((20, 25, 75), 20, 2), ((20, 40), 50, 2)])
def test_outlier(spark, prices, pct, n):
    rows = [("e", str(i), "1gal", float(p), True, False, i) for i, p in enumerate(prices)]
    cur = spark.createDataFrame(rows, "entity_id STRING, seller_id STRING, tier STRING, price DOUBLE, in_stock BOOLEAN, unavailable BOOLEAN, ord INT")
    got = A.same_tier_spread(cur).first()
    assert (got["pct"], got["seller_count"]) == (pct, n)
    assert Q.drop_top_outlier(cur, ["entity_id", "tier"]).count() == n


def test_best_ties_go_to_newest(spark):
    rows = [("e", "s1", "1gal", 5.0, True, False, 1), ("e", "s2", "1gal", 5.0, None, False, 2),
            ("e", "s3", "1gal", 1.0, False, False, 3), ("e", "s4", "1gal", 2.0, True, True, 4),
            ("e", "s1", "default", 1.0, True, False, 1)]
    cur = spark.createDataFrame(rows, "entity_id STRING, seller_id STRING, tier STRING, price DOUBLE, in_stock BOOLEAN, unavailable BOOLEAN, ord INT")
    assert [(r["tier"], r["seller_id"]) for r in A.best_per_tier(cur).collect()] == [("1gal", "s2")]
    marked = by(A.mark_best(cur), "seller_id", "tier")
    assert marked[("s2", "1gal")]["has_best_price"] and not marked[("s1", "1gal")]["has_best_price"]


def test_stale_boundary(spark):
    df = spark.createDataFrame([("2026-03-07",), ("2026-03-06",), (None,)], "d STRING").select(F.col("d").cast("date").alias("obs_date"))
    assert Q.drop_stale(df, AS_OF, 30).count() == 2


def obs(spark, rows):
    return spark.createDataFrame(rows, "entity_id STRING, seller_id STRING, t STRING").withColumn("obs_ts", F.col("t").cast("timestamp"))


def test_misses(spark):
    rows = [("e", "r1", "2026-03-25 10:00:00")] + [("e", "r2", f"2026-03-{d} 10:00:00") for d in (25, 27, 29, 31)]
    got = by(W.availability(W.consecutive_misses(obs(spark, rows))), "seller_id")
    assert (got[("r1",)]["misses"], got[("r2",)]["misses"]) == (3, 0)
    assert got[("r1",)]["unavailable"] and not got[("r2",)]["unavailable"]


def test_exact_gap_stays_in_run(spark):
    rows = [("e", "a", "2026-03-25 11:30:00"), ("e", "b", "2026-03-25 23:30:00"), ("e", "a", "2026-03-26 11:30:01")]
    runs = W.cluster_runs(obs(spark, rows)).orderBy("run").collect()
    assert [(r["run"], r["n_obs"], r["n_sellers"]) for r in runs] == [(1, 2, 2), (2, 1, 1)]


def test_naive_stamps(spark, tmp_path):
    (tmp_path / "e.jsonl").write_text("\n".join([line("a", "2026-04-01T10:00:00", {"1gal": 1}), line("b", "bad", {"1gal": 1}),
                                                 line("c", "2026-04-01T23:30:00-05:00", {"1gal": 1})]))
    got = by(O.read_observations(spark, str(tmp_path)), "seller_id")
    assert got[("a",)]["obs_ts"] is None and got[("a",)]["obs_date"] == datetime.date(2026, 4, 1)
    assert got[("b",)]["obs_date"] is None
    assert got[("c",)]["obs_date"] == datetime.date(2026, 4, 1)
    assert got[("c",)]["obs_ts"] == datetime.datetime(2026, 4, 2, 4, 30)


def test_history(spark, folder):
    offers = O.explode_sizes(O.read_observations(spark, folder))
    h = by(W.price_history(offers), "entity_id", "seller_id", "obs_date")
    assert h[("hydrangea", "a", datetime.date(2026, 3, 30))]["price"] == 15.99
    assert not [k for k in h if k[0] == "stale"]
    only_first_day = W.price_history(offers).filter("NOT (seller_id = 'b' AND obs_date > '2026-03-31')")
    m = by(W.history_matrix(only_first_day, offers.filter("entity_id = 'hydrangea'")), "seller_id")
    assert m[("b",)]["prices"] == [39.99, None] and m[("a",)]["prices"] == [15.99, 15.99]


def test_purge(spark, folder, sellers):
    s = sellers.select(F.col("seller_id").alias("id"), F.when(F.col("seller_id") == "b", False).otherwise(F.col("active")).alias("active"))
    promos = spark.createDataFrame([("b",), ("a",)], "seller_id STRING")
    kept, kept_promos, stats = O.purge_seller(spark, folder, promos, s, "b")
    row = stats.first()
    assert (row["rows_removed"], row["files_modified"], row["promo_removed"]) == (2, 1, True)
    assert kept.filter("value LIKE '{not json%'").count() == 1 and kept_promos.count() == 1
    for seller in ("a", "nobody"):
        with pytest.raises(ValueError):
            O.purge_seller(spark, folder, promos, s, seller)


def test_snapshot_versions(spark, tmp_path):
    path = str(tmp_path / "snap")
    O.write_snapshot(spark.range(3), path)
    O.write_snapshot(spark.range(5), path)
    assert O.read_snapshot(spark, path).count() == 5


def test_appended_history_is_in_ingest_order(spark, tmp_path, folder):
    path = str(tmp_path / "h")
    with pytest.raises(FileNotFoundError):
        O.read_history(spark, path)
    january = [line("a", f"2026-01-0{d}T10:00:00Z", {"1gal": 10.0 + d}) for d in (1, 2, 3)]
    february = [line("a", "2026-02-01T10:00:00Z", {"1gal": 20.0})]
    for n, rows in enumerate((january, february)):
        (tmp_path / f"in{n}").mkdir()
        (tmp_path / f"in{n}" / "item.jsonl").write_text("\n".join(rows))
        assert O.append_observations(O.read_observations(spark, str(tmp_path / f"in{n}")), path, 4) == n
    history = O.explode_sizes(O.read_history(spark, path))
    assert history.count() == 4
    latest = A.latest_offers(history).collect()
    assert [(r["obs_date"].isoformat(), r["price"]) for r in latest] == [("2026-02-01", 20.0)]


def test_unfinished_versions_do_not_count(spark, tmp_path):
    path = str(tmp_path / "snap")
    O.write_snapshot(spark.range(3), path)
    (tmp_path / "snap" / "v-1").mkdir()
    assert O.read_snapshot(spark, path).count() == 3
    O.write_snapshot(spark.range(5), path)
    assert O.read_snapshot(spark, path).count() == 5


def test_records(spark, tmp_path):
    (tmp_path / "s.json").write_text('[{"id": "a", "active": false}, {"id": "b"}]')
    (tmp_path / "bad.json").write_text('[{"id": ')
    assert R.read_records(spark, str(tmp_path / "s.json"), "id STRING, active BOOLEAN").count() == 2
    assert R.read_records(spark, str(tmp_path / "bad.json"), "id STRING, active BOOLEAN").count() == 0
    with pytest.warns(UserWarning):
        assert R.read_records(spark, str(tmp_path / "none.json"), "id STRING").count() == 0
    (tmp_path / "map.json").write_text('{"s1": {"e1": "h1", "e2": "h2"}, "s2": {}}')
    rows = {tuple(r) for r in R.read_handle_map(spark, str(tmp_path / "map.json")).collect()}
    assert rows == {("s1", "e1", "h1"), ("s1", "e2", "h2")}


def test_landed_files(spark, tmp_path):
    (tmp_path / "sitemap.xml").write_text(
        '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9" xmlns:image="http://www.google.com/schemas/sitemap-image/1.1">'
        "<url><loc>https://x/products/rose-bush?a=1</loc><image:image><image:title> Rose Bush </image:title></image:image></url>"
        "<url><loc>https://x/pages/about</loc></url><url><loc>https://x/products/fern</loc></url></urlset>")
    got = {(r["handle"], r["title"]) for r in R.read_product_sitemap(spark, str(tmp_path / "sitemap.xml")).collect()}
    assert got == {("rose-bush", "Rose Bush"), ("fern", "")}
    (tmp_path / "index.xml").write_text("<sitemapindex><sitemap><loc>https://x/sitemap_Products_1.xml</loc></sitemap>"
                                        "<sitemap><loc>https://x/pages.xml</loc></sitemap></sitemapindex>")
    assert R.read_sitemap_index(spark, str(tmp_path / "index.xml")).count() == 1
    idx = tmp_path / "idx"
    idx.mkdir()
    (idx / "a.json").write_text('[["timestamp","original","statuscode"],["20230515123456","u","200"],["20230601000000","u","404"]]')
    (idx / "b.json").write_text("[]")
    rows = R.read_archive_index(spark, str(idx)).collect()
    assert [(r["yyyymm"], r["snapshot_ts"]) for r in rows] == [("202305", datetime.datetime(2023, 5, 15, 12, 34, 56))]
    (tmp_path / "01-guide.md").write_text("# T\n\nbody")
    (tmp_path / "notes.md").write_text("x")
    assert [r["file_name"] for r in R.read_documents(spark, str(tmp_path)).collect()] == ["01-guide.md"]
