"""Work that a row costs: what is looked for only where it can be, and nothing extracted twice."""
import re
from pathlib import Path

from pyspark.sql import functions as F

from gate import extraction as GX
from gate import kept as GP
from offerlens.functions import fixed_values as FV
from offerlens.functions import tiers as T
from offerlens.functions.text import let, strip, strip_named
from offerlens.operators import compare as A
from offerlens.operators import pages as X
from offerlens.operators import promos as PR

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_pot_patterns_hold_their_needles(spark):
    """Each pattern matches only texts with its needles, and the tier is the same as without them."""
    titles = ["1 gal", "one gallon", "#1 container", "trade gallon", "2-gallons", "#2container", "3gal", "3 gallon pot", "#3 container",
              "5 gal", "#5 container", "7 gallon", "#7 container", "10 gal", "15 gallon", "a quart", "1 qt", "one quart", "4.5in", '3" pot',
              "4 inch", '4"', "6 inch pot"]
    assert len(titles) == len(FV.POT_PATTERNS) == len(FV.POT_NEEDLES)
    for title, (pattern, _), needles in zip(titles, FV.POT_PATTERNS, FV.POT_NEEDLES):
        assert re.search(pattern, title) and all(n in title for n in needles)
    df = spark.createDataFrame([(t,) for t in titles], "t STRING")
    assert [r[0] for r in df.select(T.size_tier(F.col("t"))).collect()] == [tier for _, tier in FV.POT_PATTERNS]


def test_strip_named_and_let(spark):
    texts = ["a", " a ", " b", "c　", "", " ", "é", "é ", "\x1cd", "~", "!", "x\x7f", None]
    df = spark.createDataFrame([(t,) for t in texts], "t STRING")
    assert all(a == b for a, b in df.select(strip("t"), strip_named(F.col("t"))).collect())
    assert "transform(" not in plan(df.select(let(F.upper("t"), lambda x: F.concat(x, x))))


def test_page_values_are_extracted_once(spark):
    """No filter on extracted values below the explode; pages and sellers without values stay."""
    df = spark.createDataFrame([(1, "s", "Use code SAVE10 now"), (2, "s", "flash sale, use code SAVE10"), (3, "t", "none")], "i INT, seller_id STRING, html STRING")
    merged = PR.merge_page_promos(PR.promo_signals(df), "i", ["seller_id"])
    assert not [line for line in plan(merged).splitlines() if "Filter" in line]
    assert {tuple(r) for r in merged.select("seller_id", F.array_join("codes", ","), F.array_join("banners", ",")).collect()} == {
        ("s", "SAVE10", "flash sale"), ("t", "", "")}


def test_offers_are_cut_out_of_their_match(spark):
    html = ('{"@type":"Offer","sku":"12-ab","price":"n/a","x":1,"price":"3.50","availability":"https://schema.org/InStock"}'
            '{"@type":"Offer","sku":"7","price":"4","availability":"OutOfStock"}{"@type":"Offer","sku":"8-PACK","price":"4","availability":"InStock"}')
    df = spark.createDataFrame([(html,)], "html STRING").select(X._offers(F.col("html"), FV.OFFER_PATTERN).alias("o"))
    assert [tuple(o) for o in df.first().o] == [("12-ab", "12", 3.5, True), ("7", "7", 4.0, False)]
    assert len(re.findall(r"regexp_extract\(", plan(df))) <= 1


def test_archived_pages_are_one_pass(spark):
    """Not a union, whose parts get half the tasks each."""
    assert "Union" not in plan(GX.archive_offers(spark, SF))


def test_best_offers_are_marked_in_place(spark):
    rows = [(1, "a", "1gal", 5.0, 1, True, False), (1, "b", "1gal", 5.0, 2, None, False), (1, "c", "1gal", 4.0, 3, False, False),
            (1, "a", "2gal", 9.0, 1, False, False), (1, "b", "default", 1.0, 2, True, False), (2, "a", "1gal", 3.0, 1, True, True),
            (None, "a", "1gal", 3.0, 1, True, False)]
    df = spark.createDataFrame(rows, "entity_id INT, seller_id STRING, tier STRING, price DOUBLE, ord INT, in_stock BOOLEAN, unavailable BOOLEAN")
    marked = A.mark_best(df)
    got = {(r.entity_id, r.seller_id, r.tier): (r.is_best, r.has_best_price) for r in marked.collect()}
    assert {k for k, v in got.items() if v[0]} == {(1, "b", "1gal")}
    assert {k for k, v in got.items() if v[1]} == {(1, "b", "1gal"), (1, "b", "default")} and len(got) == len(rows)
    assert "Join" not in plan(marked)


def test_appends_land_compressed(spark):
    """Lines are written compressed and all are read: sound ones and broken ones."""
    landed = GP._landed(spark, SF)
    folder = Path(landed).parent / "in"
    names = [p.name for p in folder.rglob("part-*")]
    assert names and all(n.endswith(".txt.gz") for n in names)
    assert spark.read.parquet(f"{landed}/good").count() + spark.read.parquet(f"{landed}/bad").count() == (
        spark.read.text(str(folder), recursiveFileLookup=True).filter("trim(value) != ''").count())


def test_names_made_from_ids_are_looked_at_first(spark):
    df = spark.createDataFrame([("variant-1234567",), ("variant-123456",), ("Variant-44000000011 ",), ("variant-12345678 quart",)], "t STRING")
    tier = T.size_tier(F.col("t"))
    assert [r[0] for r in df.select(tier).collect()] == ["default", "variant-123456", "default", "quart"]
    text = plan(df.select(tier))
    assert text.index("variant-") < text.index("quart")


def test_listed_snapshots_build_no_pages(spark, monkeypatch):
    seen = []
    run = GP.P.resume_backfill
    monkeypatch.setattr(GP.P, "resume_backfill", lambda passes, snapshots, *rest, **more: seen.append(plan(snapshots)) or run(passes, snapshots, *rest, **more))
    assert GP.archive_backfill(spark, SF).count() and seen and not any("<html>" in p or "Aggregate" in p for p in seen)
