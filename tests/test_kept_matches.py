"""Matches kept over changes of listings and names, and the candidates of the containment join."""
import os
import random

import pytest
from pyspark.sql import functions as F

from offerlens.operators import matching as M
from offerlens.sources import kept_matches as KM

NAME = "entity_id STRING, name STRING, botanical STRING"
PRODUCT = "product_ord LONG, title STRING, handle STRING"
WORDS = ["red", "rose", "maple", "the", "of", "big", "primrose", "oak", "fern", "tree"]


def some(rnd, lo, hi):
    return " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(lo, hi)))


def same(kept, spark, names, products):
    want = M.best_matches(
        spark.createDataFrame([(k, *v) for k, v in names.items()], NAME), spark.createDataFrame([(k, *v) for k, v in products.items()], PRODUCT))
    assert sorted(map(tuple, kept.best_matches().collect())) == sorted(map(tuple, want.collect()))


def test_equals_the_full_match_after_any_changes(spark, tmp_path):
    rnd = random.Random(4)
    kept = KM.KeptMatches(spark, str(tmp_path / "m"), buckets=4)
    names, products = {}, {}
    for step in range(4):
        title = lambda j: "red rose" if j % 3 == 0 else None if j == 7 else some(rnd, 0, 4)
        goods = {j: (title(j), some(rnd, 1, 3).replace(" ", "-")) for j in rnd.sample(range(60), 40 if step == 0 else 8)}
        people = {f"{some(rnd, 1, 3).replace(' ', '-')}-{i}": (some(rnd, 0, 3), some(rnd, 0, 2)) for i in range(15 if step == 0 else 3)}
        drop = [j for j in rnd.sample(range(60), 5) if j not in goods] if step else []
        leave = [k for k in rnd.sample(sorted(names), 2) if k not in people] if step else []
        change = dict(
            products=spark.createDataFrame([(k, *v) for k, v in goods.items()], PRODUCT), gone=spark.createDataFrame([(j,) for j in drop], "product_ord LONG"),
            names=spark.createDataFrame([(k, *v) for k, v in people.items()], NAME), names_gone=spark.createDataFrame([(k,) for k in leave], "entity_id STRING"))
        kept.change(**change)
        if step == 2:
            kept.change(**change)  # sent again
        products = {k: v for k, v in (products | goods).items() if k not in drop}
        names = {k: v for k, v in (names | people).items() if k not in leave}
        same(kept, spark, names, products)
    kept.compact()
    same(kept, spark, names, products)


def test_cut_off_after_the_index(spark, tmp_path, monkeypatch):
    kept = KM.KeptMatches(spark, str(tmp_path / "m"), buckets=4)
    names, products = {"red-rose": ("Red Rose", "")}, {1: ("red rose", "a"), 2: ("big oak", "b")}
    as_names = spark.createDataFrame([(k, *v) for k, v in names.items()], NAME)
    kept.change(spark.createDataFrame([(k, *v) for k, v in products.items()], PRODUCT), names=as_names)
    same(kept, spark, names, products)
    new = spark.createDataFrame([(1, "big oak", "a"), (2, "rose red", "b")], PRODUCT)
    monkeypatch.setattr(KM.KeptMatches, "_best", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        kept.change(new)
    monkeypatch.undo()
    kept.change(new)
    same(kept, spark, names, {1: ("big oak", "a"), 2: ("rose red", "b")})


def test_a_small_change_rewrites_few_buckets(spark, tmp_path):
    kept = KM.KeptMatches(spark, str(tmp_path / "m"), buckets=32)
    listings = spark.range(400).selectExpr("id AS product_ord", "concat('w', id, ' v', id) AS title", "concat('h', id) AS handle")
    kept.change(listings, names=spark.range(200).selectExpr("concat('e', id) AS entity_id", "concat('w', id, ' v', id) AS name", "'' AS botanical"))
    files = lambda: {os.path.join(d, f) for d, _, fs in os.walk(kept.path) for f in fs if f.startswith("part-")}
    before = files()
    kept.change(spark.createDataFrame([(5, "w5 other", "h5")], PRODUCT))
    touched = {os.path.dirname(f) for f in before ^ files()}
    assert 1 <= len([x for x in touched if "/index/" in x]) <= 4 and len([x for x in touched if "/products/" in x]) == 1
    assert len([x for x in touched if "/matches/" in x]) == 1 and not [x for x in touched if "/names/" in x]
    assert kept.best_matches().filter("entity_id = 'e5'").count() == 0 and kept.best_matches().count() == 199


@pytest.mark.parametrize("split", [20_000, 2])
def test_containing_against_all_pairs(spark, monkeypatch, split):
    monkeypatch.setattr(M, "SPLIT", split)
    rnd = random.Random(9)
    made = lambda lo, hi: "".join(rnd.choice("ab-") for _ in range(rnd.randint(lo, hi)))
    long = sorted({made(1, 40) for _ in range(120)} | {"é" * 9, "ab" * 300})
    short = sorted({made(1, 9) for _ in range(60)} | {x[3: 3 + rnd.randint(1, 30)] for x in long if len(x) > 4} | {"é" * 4, "ba" * 250})
    got = M.containing(spark.createDataFrame(list(enumerate(short)), "s_id INT, s_text STRING"), spark.createDataFrame(list(enumerate(long)), "l_id INT, l_text STRING"))
    want = {(i, j) for i, s in enumerate(short) for j, x in enumerate(long) if s in x}
    pairs = [tuple(r) for r in got.collect()]
    assert set(pairs) == want and len(pairs) == len(want)
    assert M.containing(spark.createDataFrame([], "s_id INT, s_text STRING"), spark.createDataFrame([(1, "a")], "l_id INT, l_text STRING")).count() == 0


def test_common_pieces_bring_few_candidates(spark):
    """All texts end alike, and every three letters of the names stand in very many of them."""
    rnd = random.Random(3)
    name = lambda: "".join(rnd.choice("abc") for _ in range(9))
    long = sorted({name() for _ in range(1500)})
    short = spark.createDataFrame([(i, f"{x}-hydrangea") for i, x in enumerate(long[:200])], "s_id INT, s_text STRING")
    listed = spark.createDataFrame([(i, f"{x}-hydrangea-shrub") for i, x in enumerate(long)], "l_id INT, l_text STRING")
    pairs = M.containment_candidates(short, listed)
    found = pairs.filter(F.col("l_text").contains(F.col("s_text"))).count()
    assert found == 200 and pairs.count() < 5 * found
