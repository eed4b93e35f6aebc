"""Kept tables, committed passes and landed files: what is rewritten, repeats, late rows and jobs that are cut off."""
import os
import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from offerlens.operators import compare as A
from offerlens.operators import history as W
from offerlens.plans import jobs
from offerlens.schemas import VARIANT
from offerlens.sources import kept as K
from offerlens.sources import observations as O
from offerlens.sources.passes import Passes
from offerlens.streaming import jobs as T

OFFER = "entity_id STRING, seller_id STRING, obs_date DATE, ord INT, price DOUBLE"


def files(path):
    return {os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.startswith("part-")}


def made(seed, n=120):
    rng = random.Random(seed)
    return [(rng.choice("abcdefgh"), rng.choice("stu"), date(2024, 1, rng.randint(1, 9)), i, float(rng.choice([0, 5, 7, 9]))) for i in range(n)]


def test_latest_by_merges_equals_a_full_scan(spark, tmp_path):
    rows = made(1)
    table = K.KeptTable(spark, str(tmp_path / "t"), ["entity_id", "seller_id"], 8)
    parts = random.Random(2).sample(rows, len(rows))
    for lo in (0, 50, 90, 50):  # late rows, and one append twice
        K.merge_latest(table, spark.createDataFrame(parts[lo: lo + 50], OFFER), ["ord"])
    want = A.latest_per_key(spark.createDataFrame(rows, OFFER), table.key, ["ord"])
    assert sorted(table.read().select(*want.columns).collect()) == sorted(want.collect())


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    table = K.KeptTable(spark, str(tmp_path / "t"), ["entity_id"], 16)
    rows = spark.createDataFrame([(f"e{i}", i) for i in range(200)], "entity_id STRING, v INT")
    table.rebuild(rows)
    before = files(table.path)
    touched = K.replace_keys(table, spark.createDataFrame([("e5", 500), ("new", 1)], "entity_id STRING, v INT"))
    after = files(table.path)
    assert 1 <= len(touched) <= 2 and len({os.path.dirname(f) for f in before ^ after}) <= 2
    got = {r.entity_id: r.v for r in table.read().collect()}
    assert got == {f"e{i}": i for i in range(200)} | {"e5": 500, "new": 1}
    assert K.replace_keys(table, rows.limit(0)) == [] and files(table.path) == after


def test_failed_merge_leaves_the_table(spark, tmp_path):
    table = K.KeptTable(spark, str(tmp_path / "t"), ["entity_id"], 4)
    table.rebuild(spark.createDataFrame([("a", 1)], "entity_id STRING, v INT"))
    new = spark.createDataFrame([("a", 2)], "entity_id STRING, v INT")
    broken = lambda old, new: new.withColumn("v", F.raise_error(F.lit("lost")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        table.merge(new, broken)
    assert [tuple(r) for r in table.read().collect()] == [("a", 1)]
    K.replace_keys(table, new)
    assert [tuple(r) for r in table.read().collect()] == [("a", 2)]


def test_history_by_merges_equals_a_full_scan(spark, tmp_path):
    rows = made(3) + [("once", "s", date(2024, 1, 1), 999, 4.0), ("free", "s", date(2024, 1, 1), 1000, 0.0)]
    kept = K.KeptHistory(spark, str(tmp_path / "h"), 4)
    parts = random.Random(4).sample(rows, len(rows))
    for lo in (60, 0, 60):
        kept.merge(spark.createDataFrame(parts[lo: lo + 62], OFFER))
    sellers = spark.createDataFrame([("s",), ("t",)], "seller_id STRING")
    everything = spark.createDataFrame(rows, OFFER)
    for active in (None, sellers):
        want = W.price_history(everything, active)
        assert sorted(kept.price_history(active).select(*want.columns).collect()) == sorted(want.collect())


SNAPS = "entity_id STRING, seller_id STRING, url STRING, stamp STRING, snapshot_ts TIMESTAMP, yyyymm STRING"


def test_backfill_goes_on_after_it_was_cut_off(spark, tmp_path, monkeypatch):
    stamps = [f"2023{m:02d}10000000" for m in range(1, 9)]
    snaps = spark.createDataFrame([("rose", "s", "u", s, datetime.strptime(s, "%Y%m%d%H%M%S"), s[:6]) for s in stamps], SNAPS)
    label = '<b aria-label="1 Quart - Sale price: 7.50 - List price: $9.00">'
    pages = spark.createDataFrame([("u", s, "page", label) for s in stamps], "url STRING, stamp STRING, kind STRING, html STRING")
    products = spark.createDataFrame([], f"url STRING, stamp STRING, variants ARRAY<{VARIANT}>")
    passes = Passes(spark, str(tmp_path / "p"))
    assert jobs.resume_backfill(passes, snaps, products, pages, portions=3, at_most=1) == 1
    first = jobs.archived_records(passes).count()
    assert 0 < first < 8

    def dies(self, number, status):
        raise RuntimeError("cut off")
    with monkeypatch.context() as m:
        m.setattr(Passes, "commit", dies)
        with pytest.raises(RuntimeError):
            jobs.resume_backfill(passes, snaps, products, pages, portions=3)
    assert jobs.archived_records(passes).count() == first  # written, not committed
    jobs.resume_backfill(passes, snaps, products, pages, portions=3)
    got = [(str(r.obs_date), r.size, r.price) for r in jobs.archived_records(passes).collect()]
    assert sorted(got) == [(f"2023-{m:02d}-10", "quart", 7.5) for m in range(1, 9)]
    assert jobs.resume_backfill(passes, snaps, products, pages, portions=3) == 0


def test_backfill_of_months_with_several_urls(spark, tmp_path, monkeypatch):
    """Snapshots of one month that fall into different portions are in one pass, from pages and product documents, and a pass
    reads the pages of its portion by one join."""
    stamp, at = "20230510000000", datetime(2023, 5, 10)
    urls = [(f"e{i % 6}", f"u{i}") for i in range(18)]
    snaps = spark.createDataFrame([(e, "s", u, stamp, at, "202305") for e, u in urls] + [("none", "s", None, stamp, at, "202305")], SNAPS)
    label = '<b aria-label="1 Quart - Sale price: 7.50 - List price: $9.00">'
    pages = spark.createDataFrame([(u, stamp, "page", label) for _, u in urls[6:]] + [("other", stamp, "page", label)],
                                  "url STRING, stamp STRING, kind STRING, html STRING")
    variants = [("1", "1 Gallon", "20", "25", None, None)]
    products = spark.createDataFrame([(u, stamp, variants) for _, u in urls[:9]], f"url STRING, stamp STRING, variants ARRAY<{VARIANT}>")
    plans, write = [], Passes.write

    def seen(self, number, name, df):
        if name == "records":
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(self, number, name, df)
    monkeypatch.setattr(Passes, "write", seen)
    passes = Passes(spark, str(tmp_path / "p"))
    homes = {r.url: r.home for r in snaps.select("url", jobs._home(4).alias("home")).collect()}
    assert any(homes[u] != homes[v] for (e, u) in urls for (f, v) in urls if e == f)
    assert jobs.resume_backfill(passes, snaps, products, pages, portions=4, at_most=1) == 1
    done = {(r.entity_id, r.seller_id, r.yyyymm) for r in passes.read("progress", jobs.PROGRESS).collect()}
    count = lambda: sorted((r.entity_id, r.archive_url.rsplit("/", 1)[1], r.size, r.price) for r in jobs.archived_records(passes).collect())
    want = sorted((e, u, "1gal", 20.0) if i < 9 else (e, u, "quart", 7.5) for i, (e, u) in enumerate(urls))
    assert done and count() == [r for r in want if (r[0], "s", "202305") in done]
    jobs.resume_backfill(passes, snaps, products, pages, portions=4)
    assert count() == want and passes.read("progress", jobs.PROGRESS).count() == 7
    assert jobs.resume_backfill(passes, snaps, products, pages, portions=4) == 0
    plans.clear()
    jobs.resume_backfill(Passes(spark, str(tmp_path / "lone")), snaps.filter("url = 'u0'"), products, pages, portions=4)
    assert all("pmod(xxhash64(" in p and p.count("Join Inner") == 3 for p in plans) and len(plans) == 1  # documents twice, pages once


def test_collection_runs_build_on_each_other(spark, tmp_path):
    offer = "entity_id STRING, seller_id STRING, tier STRING, price DOUBLE"
    result = "entity_id STRING, seller_id STRING, error STRING"
    passes = Passes(spark, str(tmp_path / "p"))
    handles = spark.createDataFrame([("e", "s"), ("f", "s"), ("g", "t")], "entity_id STRING, seller_id STRING")
    day = lambda rows, res: jobs.run_collection(passes, spark.createDataFrame(rows, offer), spark.createDataFrame(res, result), handles)
    day([("e", "s", "1gal", 40.0), ("g", "t", "1gal", 3.0)], [("e", "s", None), ("g", "t", None), ("f", "s", "HTTP 500")])
    lost = passes.begin()
    passes.write(lost, "history", spark.createDataFrame([("x", "s", "1gal", 1.0)], offer))
    run = day([("e", "s", "1gal", 90.0), ("f", "s", "1gal", 5.0)], [("e", "s", None), ("f", "s", None)])
    assert [r.entity_id for r in run.quarantined.collect()] == ["e"]
    shape = spark.createDataFrame([], offer).schema
    assert {tuple(r) for r in passes.newest("snapshot", shape).collect()} == {("f", "s", "1gal", 5.0), ("g", "t", "1gal", 3.0)}
    assert {r.entity_id for r in passes.read("history", shape).collect()} == {"e", "f", "g"}
    assert {(r.seller_id, r.health) for r in run.stats.collect()} == {("s", "healthy"), ("t", "healthy")}
    assert passes.done() == [0, 1]


def test_files_land_once_and_are_archived(spark, tmp_path):
    line = lambda s, day: f'{{"retailer_id": "{s}", "timestamp": "2024-01-0{day}T10:00:00+00:00", "sizes": {{"1gal": 5}}}}\n'
    src, out, store = tmp_path / "in", str(tmp_path / "out"), tmp_path / "old"
    for seq, name, text in ((0, "rose", line("s", 1) + "{oops\n\n"), (1, "rose", line("s", 2)), (1, "fern", "[1]\n" + line("t", 1))):
        (src / f"seq={seq}").mkdir(parents=True, exist_ok=True)
        (src / f"seq={seq}" / f"{name}.jsonl").write_text(text)
        T.land_observations(spark, str(src), out, str(tmp_path / "ck"), archive=str(store)).trigger(availableNow=True).start().awaitTermination()
    rows = T.landed_observations(spark, out).collect()
    assert sorted((r.entity_id, r.seller_id, r.ord.seq) for r in rows) == [("fern", "t", 1), ("rose", "s", 0), ("rose", "s", 1)]
    bad = {r.entity_id: r.bad_lines for r in T.landed_bad_lines(spark, out).collect()}
    assert bad["rose"] == 1
    assert O.explode_sizes(T.landed_observations(spark, out)).count() == 3
