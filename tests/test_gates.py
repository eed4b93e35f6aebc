"""Gates, checks, ranks and matching, with their exact boundaries and against brute force."""
import random

import pytest
from pyspark.sql import functions as F

from offerlens.functions import names as N
from offerlens.operators import compare as A
from offerlens.operators import matching as M
from offerlens.operators import quality as Q
from offerlens.operators import reconcile as R
from offerlens.operators import windows as W
from offerlens.streaming import jobs as T

OFFER = "entity_id STRING, seller_id STRING, tier STRING, price DOUBLE"


@pytest.mark.parametrize("old,new,flag", [(40, 80, True), (40, 45, False), (40, 60, False), (40, 60.01, True), (40, 20, False), (0, 50, False), (40, 0, False)])
def test_swing_boundary(spark, old, new, flag):
    fresh = spark.createDataFrame([("e", "s", "1gal", float(new))], OFFER)
    snap = spark.createDataFrame([("e", "s", "1gal", float(old))], OFFER)
    assert Q.swing_gate(fresh, snap).first()["is_anomaly"] is flag


def test_one_bad_size_quarantines_listing_and_forgets(spark):
    fresh = spark.createDataFrame([("e", "s", "1gal", 90.0), ("e", "s", "quart", 10.0), ("f", "s", "1gal", 5.0)], OFFER)
    snap = spark.createDataFrame([("e", "s", "1gal", 40.0), ("e", "t", "1gal", 41.0), ("g", "s", "1gal", 1.0)], OFFER)
    gated = Q.swing_gate(fresh, snap)
    assert {(r["entity_id"], r["tier"]) for r in gated.filter("accepted").collect()} == {("f", "1gal")}
    after = {tuple(r) for r in Q.snapshot_after(gated, snap).collect()}
    assert after == {("e", "t", "1gal", 41.0), ("f", "s", "1gal", 5.0)}
    kept = {tuple(r) for r in Q.snapshot_after(gated, snap, keep_baseline=True).collect()}
    assert kept == after | {("e", "s", "1gal", 40.0)}


STREAMED = OFFER + ", obs_ts TIMESTAMP, ord INT"


def _streamed(spark, tmp_path, name, batches, **options):
    out = str(tmp_path / name)
    run = T.gate_batch(out, OFFER, **options)
    for i, rows in enumerate(batches):
        for _ in range(1 + (i == 1)):  # a batch may be repeated
            run(spark.createDataFrame(rows, STREAMED), i)
    T.finish_gate(spark, out, STREAMED, OFFER, **options)
    gated = sorted((r["ord"], r["accepted"], r["reason"]) for r in T.gated_offers(spark, out).collect())
    return gated, {tuple(r) for r in T.newest_version(spark, out + "/snapshot", OFFER).collect()}


@pytest.mark.parametrize("keep_baseline", [False, True])
def test_stream_gate_does_not_depend_on_batches(spark, tmp_path, keep_baseline):
    from datetime import datetime

    rng, rows = random.Random(4), []
    for n in range(45):
        day = n // 15 + 1
        rows.append((rng.choice("abcd"), rng.choice("st"), "1gal", float(rng.choice([10, 12, 20, 40])), datetime(2024, 1, day, n % 15), n))
    cut = lambda size: [rows[i: i + size] for i in range(0, len(rows), size)]
    one = _streamed(spark, tmp_path, "one", [rows], keep_baseline=keep_baseline)
    assert len(one[0]) == len(rows) and not all(a for _, a, _ in one[0])
    for size in (23,):
        assert _streamed(spark, tmp_path, f"cut{size}", cut(size), keep_baseline=keep_baseline) == one
    # plain walk over the runs
    snap, want = {}, []
    for day in range(1, 4):
        run = [r for r in rows if r[4].day == day]
        new, seen = {}, set()
        for e, s, t, p, _, n in run:
            old = snap.get((e, s))
            ok = old is None or abs(p - old) / old * 100 <= 50
            want.append((n, ok, None if ok else "swing"))
            seen.add((e, s))
            if ok:
                new[(e, s)] = p
        sellers = {s for _, s in seen}
        held = {k: v for k, v in snap.items() if keep_baseline and k in seen and k not in new}
        snap = {k: v for k, v in snap.items() if k[1] not in sellers} | held | new
    assert one[0] == want and one[1] == {(*k, "1gal", v) for k, v in snap.items()}


def test_stream_gate_files_late_rows(spark, tmp_path):
    from datetime import datetime

    at = lambda d, n: ("e", "s", "1gal", 10.0, datetime(2024, 1, d), n)
    gated, _ = _streamed(spark, tmp_path, "late", [[at(1, 0)], [at(2, 1)], [at(3, 2), at(1, 3)]])
    assert gated == [(0, True, None), (1, True, None), (2, True, None), (3, False, "late")]


@pytest.mark.parametrize("fresh,status", [(40.5, "PASS"), (40.8, "PASS"), (40.81, "MISMATCH"), (45, "MISMATCH"), (None, "PASS")])
def test_tolerance(spark, fresh, status):
    stored = spark.createDataFrame([("e", "s", "1gal", 40.0), ("e", "s", "quart", 9.0)], OFFER)
    rows = [("e", "s", "quart", 9.0)] + ([("e", "s", "1gal", float(fresh))] if fresh else [])
    assert Q.price_compare(stored, spark.createDataFrame(rows, OFFER)).first()["status"] == status


def test_savings_halves_to_even(spark):
    from offerlens.functions.pricing import savings_pct
    df = spark.createDataFrame([(87.5, 100.0), (86.5, 100.0), (5.0, 5.0)], "lo DOUBLE, hi DOUBLE")
    assert [r[0] for r in df.select(savings_pct(F.col("lo"), F.col("hi"))).collect()] == [12, 14, 0]


@pytest.mark.parametrize("name,title,score", [
    ("Limelight Hydrangea", "Limelight Hydrangea Tree", 1.0), ("Limelight Hydrangea", "Red Knockout Rose", 0.0),
    ("Limelight Hydrangea", "LIMELIGHT® (Hydrangea paniculata)", 0.5), ("Tree", "Tree", 0.0), ("the", "the", 1.0), ("Elm Street", "elm s et", 0.5)])
def test_match_score(spark, name, title, score):
    df = spark.createDataFrame([(name, title)], "n STRING, t STRING")
    assert df.select(N.match_score(F.col("n"), F.col("t"))).first()[0] == score


def brute(spark, entities, products, wide):
    """All pairs, scored one by one."""
    e, p = entities.crossJoin(products), F.col
    ids, handles = N.dashes_to_blanks(p("entity_id")), N.dashes_to_blanks(p("handle"))
    if wide:
        o = lambda a, b: N.overlap_score(N.wide_words(N.slug_text(a)), N.wide_words(N.slug_text(b)))
        i, h = N.slug_text(ids), N.slug_text(handles)
        s = F.greatest(o(p("name"), p("title")), o(p("name"), handles), o(ids, handles), 0.7 * o(p("botanical"), p("title")),
                       F.when(h.contains(i) | i.contains(h), 0.9).otherwise(0.0))
    else:
        s = F.greatest(N.match_score(p("name"), p("title")), N.match_score(p("botanical"), p("title")) * 0.8, N.match_score(ids, handles) * 0.9)
    best = {}
    for r in e.select("entity_id", "product_ord", "handle", s.alias("s")).collect():
        key = (-r["s"], r["product_ord"])
        if r["s"] >= (0.55 if wide else 0.6) and (r["entity_id"] not in best or key < best[r["entity_id"]][0]):
            best[r["entity_id"]] = (key, r["handle"])
    return {k: v[1] for k, v in best.items()}


@pytest.mark.parametrize("wide", [False, True])
@pytest.mark.parametrize("seed,split", [(1, 20_000), (2, 3)])
def test_matching_against_all_pairs(spark, monkeypatch, wide, seed, split):
    monkeypatch.setattr(M, "SPLIT", split)  # a small split puts common words on several parts
    rnd = random.Random(seed)
    vocab = ["red", "rose", "maple", "the", "of", "big", "primrose", "ro", "a", "oak", "fern"]
    some = lambda lo, hi: " ".join(rnd.choice(vocab) for _ in range(rnd.randint(lo, hi)))
    # one title makes up a third of all listings
    ent = [(f"{some(1, 3).replace(' ', '-')}-{i}" if i % 3 else some(1, 2).replace(" ", "-") + "x" * i, some(0, 4), some(0, 3)) for i in range(40)]
    ent = list({e[0]: e for e in ent}.values())
    prod = [(j, "red rose" if j % 3 == 0 else some(0, 4), "" if j == 37 else some(1, 3).replace(" ", "-")) for j in range(90)]
    entities = spark.createDataFrame(ent, "entity_id STRING, name STRING, botanical STRING")
    products = spark.createDataFrame(prod, "product_ord BIGINT, title STRING, handle STRING")
    op = M.best_matches_wide if wide else M.best_matches
    got = {r["entity_id"]: r["handle"] for r in op(entities, products).collect()}
    assert got == brute(spark, entities, products, wide)


def test_similar_against_all_pairs(spark):
    rnd = random.Random(5)
    rows = [(i, "hot" if i % 3 else "c" + str(i % 4), sorted(rnd.sample(range(1, 7), rnd.randint(1, 4))), rnd.choice([None, 1.0, 2.0, 3.0])) for i in range(60)]
    df = spark.createDataFrame(rows, "entity_id INT, category STRING, zones ARRAY<INT>, lowest_price DOUBLE").withColumn("entity_ord", F.col("entity_id"))
    got = {}
    for r in A.similar_entities(df, 5).collect():
        got.setdefault(r["entity_id"], {})[r["similar_rank"]] = r["similar_id"]
    for i, c, z, _ in rows:
        cand = sorted((-len(set(z) & set(z2)), (0, p) if p is not None else (1, 0), j) for j, c2, z2, p in rows if c2 == c and j != i)
        assert [got.get(i, {}).get(k + 1) for k in range(len(cand[:5]))] == [x[2] for x in cand[:5]]


def test_split_rank_and_previous(spark):
    rnd = random.Random(7)
    rows = [("hot" if i % 3 else f"k{i % 5}", round(rnd.uniform(1, 500), 2), i, i // 10) for i in range(300)]
    df = spark.createDataFrame(rows, "k STRING, v DOUBLE, i INT, day INT")
    ranked = W.split_rank(df, ["k"], W.magnitude(F.col("v")), [F.col("v"), F.col("i")], "r")
    for k in {r[0] for r in rows}:
        want = [r[2] for r in sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2]))]
        assert [r["i"] for r in ranked.filter(F.col("k") == k).orderBy("r").collect()] == want
    prev = {r["i"]: r["old_v"] for r in W.with_previous(df, ["k"], F.col("i"), "day", ["v"], "old_").collect()}
    last = {}
    for k, v, i, _ in rows:
        assert prev[i] == last.get(k)
        last[k] = v


def test_reconcile(spark):
    ent = spark.createDataFrame([("e", "E")], "entity_id STRING, name STRING")
    v = lambda field, *values: [("e", field, x, i) for i, x in enumerate(values)]
    votes = spark.createDataFrame(
        v("zones", "6,7", "6,7", "6,7", "5,6") + v("sun", "Full  Sun", "full sun ", None) + v("bloom_time", "May", "June") + v("type", "Shrub"),
        "entity_id STRING, field STRING, value STRING, src_pos INT")
    got = {r["field"]: (r["value"], r["source"], r["flagged"]) for r in R.reconcile(ent, votes).collect()}
    assert got == {"zones": ("6,7", "majority", False), "sun": ("Full  Sun", "majority", False), "bloom_time": ("May", "tiebreak", False),
                   "type": ("Shrub", "fallback", True), "mature_size": (None, "fallback", True)}
    pick = {r["field"]: r["value"] for r in R.reconcile(ent, votes, resolve=lambda f, c, n: F.concat(n, F.lit(":"), F.array_join(c, "/"))).collect()}
    assert pick["bloom_time"] == "E:May/June" and pick["mature_size"] == "E:" and pick["zones"] == "6,7"


def test_seasonality_golden(spark):
    from offerlens.operators import seasonality as H
    s = "STRUCT<monthly_index: ARRAY<INT>, best_buy: STRING, worst_buy: STRING, note: STRING, tip: STRING>"
    w = "MAP<STRING,STRUCT<spring: STRING, fall: STRING, summer: STRING>>"
    rows = [("hydrangeas", 1, ([3, 3, 4, 5, 4, 3, 2, 1, 1, 2, 3, 3], "Aug", None, None, None), {"5": ("May-Jun", "Sep", None)}),
            ("hydrangeas", 2, None, {"5": (None, None, None)}), ("bare", 3, ([9] * 12, None, None, None, None), None),
            ("half", 4, ([1, 2] * 6, None, None, None, None), None), ("half", 5, ([2, 3] * 6, "x", "y", None, "z"), None),
            ("none", 6, None, None), ("short", 7, ([1, 2], None, None, None, None), None)]
    cat = spark.createDataFrame(rows, f"category STRING, entity_ord INT, price_seasonality {s}, planting_seasons {w}")
    idx = {r["category"]: r["monthly_index"] for r in H.monthly_index(cat).collect()}
    assert idx["hydrangeas"] == [3, 3, 4, 5, 4, 3, 2, 1, 1, 2, 3, 3] and idx["bare"] == [5] * 12
    assert idx["half"] == [2, 2] * 6 and idx["short"] == [3] * 12 and "none" not in idx
    months = {(r["category"], r["zone"]): [i + 1 for i, p in enumerate(r["plantable"]) if p] for r in H.planting_windows(cat).collect()}
    assert months[("hydrangeas", 5)] == [5, 6, 9] and months[("hydrangeas", 4)] == [] and len(months) == 7 * 4
    tips = {r["category"]: (r["best_buy"], r["worst_buy"], r["tip"]) for r in H.category_tips(cat).collect()}
    assert tips["hydrangeas"] == ("Aug", "Spring", "") and tips["half"] == ("x", "y", "z") and tips["bare"] == ("Fall", "Spring", "")


def test_stream_gate_takes_few_jobs_for_many_runs(spark, tmp_path):
    """A backfill of 200 days in one batch, several sizes to a listing, a seller that misses days; the jobs don't follow the runs."""
    from datetime import datetime, timedelta

    rng = random.Random(9)

    def jobs(name, days, rows):
        group = f"gate-{name}"
        spark.sparkContext.setJobGroup(group, group)
        got = _streamed(spark, tmp_path, name, [rows])
        spark.sparkContext.setJobGroup("other", "other")
        return got, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    def made(days):
        rows, n = [], 0
        for day in range(days):
            for e in "ab":
                for s in "st":
                    if s == "t" and day % 3 == 0 or rng.random() < 0.2:
                        continue
                    for _ in range(rng.choice([1, 2])):
                        n += 1
                        rows += [(e, s, tier, float(rng.choice([0, 10, 12, 14, 40])), datetime(2024, 1, 1) + timedelta(days=day), n) for tier in ("1gal", "2gal")]
        return rows

    rows = made(200)
    (gated, snapshot), many = jobs("many", 200, rows)
    _, few = jobs("few", 4, made(4))
    assert many <= few + 3
    snap, want = {}, []
    for day in sorted({r[4] for r in rows}):
        run, new = [r for r in rows if r[4] == day], {}
        for n in sorted({r[5] for r in run}):
            sizes = {r[2]: r[3] for r in run if r[5] == n}
            pair = next(r[:2] for r in run if r[5] == n)
            old = snap.get(pair, {})
            ok = not any(old.get(t) and p and abs(p - old[t]) / old[t] * 100 > 50 for t, p in sizes.items())
            want += [(n, ok, None if ok else "swing")] * 2
            if ok:
                new[pair] = sizes
        ran = {r[1] for r in run}
        snap = {k: v for k, v in snap.items() if k[1] not in ran} | new
    assert gated == sorted(want, key=str) or gated == sorted(want)
    assert snapshot == {(*k, t, p) for k, sizes in snap.items() for t, p in sizes.items()}
