import pytest
from pyspark.sql import functions as F

from offerlens.functions import tiers as T

SIZES = [
    ("1 Gallon", "1gal"), ("2 Gallon", "2gal"), ("15 Gallon", "15gal"), ("10 gal", "10gal"),
    ("#1 Container", "1gal"), ("#7 Container", "7gal"), ("#3 Container 3-4 Feet", "3gal"),
    ("Quart", "quart"), ("One Quart", "quart"), ("Qt", "quart"), ("4.5 in", "quart"),
    ("3-4 feet", "3-4ft"), ("4 – 5 foot", "4-5ft"), ("03-04 ft", "3-4ft"), ("6 ft", "6ft"),
    ("PREMIUM / 1 Plant(s) | Ships in Spring", "premium-bareroot"),
    ("JUMBO / 1 Plant(s) | Ships in Spring", "jumbo-bareroot"),
    ("1 GALLON - 2-4 FT / 1 Plant(s) | Ships in Spring", "1gal"),
    ("Bare Root", "bareroot"), ("Dormant", "bareroot"), ('FIELD 12-18"', "12-18in"), ("Field grown", "field"),
    ("Semi-Dwarf", "semi-dwarf"), ("Dwarf", "dwarf"), ("Standard", "standard"),
    ("Supreme", "supreme"), ("Ultra Supreme", "ultra-supreme"),
    ("Default Title", "default"), ("", "default"), ("variant-44912345678901", "default"),
    ("12345678", "default"), ("4 inch", "4inch"), ('4"', "4inch"), ('3" pot', "3inch"),
    ("6 inch pot", "6inch"), ("3 Bulbs", "bulb"), ("1 Gallon", "1gal"),
    ("1 Gallon / Ship Week 23 (June 1st – June 5th)", "1gal"), ("Ships Now", "default"),
    ("3 Feet (One Gallon)", "1gal"), ("Odd  Name!", "odd-name"),
]


def column(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i INT, v STRING")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_size_tier(spark):
    got = column(spark, [s for s, _ in SIZES], T.size_tier)
    assert list(zip([s for s, _ in SIZES], got)) == SIZES


def test_rootstock_tier(spark):
    cases = [
        ("Honeycrisp Apple Dwarf", "dwarf"), ("Honeycrisp Apple Semi-Dwarf", "semi-dwarf"),
        ("Apple Dwarf 7 Gal Potted", "dwarf-potted"), ("Apple semi dwarf potted", "semi-dwarf-potted"),
        ("Plum potted", "potted"), ("X Ultra Supreme bare-root", "ultra-supreme-bareroot"),
        ("X Supreme EZ Start", "supreme-ez-start"), ("Patriot Blueberry", "default"),
        ("X Standard", "standard"),
    ]
    assert column(spark, [c for c, _ in cases], T.rootstock_tier) == [t for _, t in cases]


def test_canonical_label_rank(spark):
    cases = [(" #1-Container ", "1gal"), ("1-galllon", "1gal"), ("bare root", "bareroot"),
             ("variant-12345678", "default"), ("1234567", "default"), ("123456", "123456"), ("5gal", "5gal")]
    assert column(spark, [c for c, _ in cases], T.canonical_tier) == [t for _, t in cases]
    labels = [("qt", "Quart"), ("12-18in", '12-18"'), ("9-10ft", "9 10Ft"), ("odd-name", "Odd Name")]
    assert column(spark, [c for c, _ in labels], T.tier_label) == [t for _, t in labels]
    df = spark.createDataFrame([("zzz",), ("default",), ("quart",), ("aaa",), ("48-54in",)], "v STRING")
    assert [r[0] for r in df.orderBy(T.tier_rank(F.col("v"))).collect()] == [
        "quart", "default", "48-54in", "aaa", "zzz"]


@pytest.mark.parametrize("title,pack", [
    ("3 Plant(s)", True), ("10-Pack", True), ("BOGO / 2 Plant(s)", True), ("Single pack", True),
    ("1 Gallon", False), ("1 Plant(s)", False)])
def test_packs(spark, title, pack):
    assert column(spark, [title], T.is_pack) == [pack]


def test_ships_season(spark):
    assert column(spark, ["X | Ships in spring", "ship in FALL", "1 gal"], T.ships_season) == [
        "Spring", "Fall", None]
