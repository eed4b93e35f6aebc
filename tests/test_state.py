"""Link state against a plain fold, and the boundaries of recovery."""
import datetime
import random

import pytest
from pyspark.sql import functions as F

from offerlens.operators import catalog as K
from offerlens.operators import state as S
from offerlens.plans import jobs
from offerlens.schemas import LINK_STATE, VARIANT
from offerlens.streaming import jobs as T

T0 = datetime.datetime(2026, 1, 1)
KINDS = ["broken", "attempt", "redirect", "discovery", "verdict", "confirm_failed", "unrecoverable", "applied"]
FIELDS = ["old_handle", "status", "candidate_handle", "redirect_url", "attempts", "last_discovery_attempt",
          "created_at", "updated_at", "candidate_title", "match_score", "reason"]


def plain_fold(events):
    """The state machine, one event at a time."""
    s = None
    for e in events:
        k, now = e["event"], e["event_ts"]
        base = s or {}
        fresh = dict(candidate_handle=None, redirect_url=None, candidate_title=None, match_score=None, reason=None,
                     created_at=base.get("created_at", now), updated_at=now)
        if k == "applied":
            s = None
        elif k == "broken":
            if base.get("status") in S.IN_FLIGHT:
                continue
            s = dict(fresh, old_handle=e["old_handle"], status="broken", attempts=base.get("attempts", 0),
                     last_discovery_attempt=base.get("last_discovery_attempt"))
        elif k == "redirect":
            s = dict(fresh, old_handle=e["old_handle"], status="redirect_candidate", candidate_handle=e["new_handle"],
                     redirect_url=e["redirect_url"], attempts=0, last_discovery_attempt=None)
        elif k == "discovery":
            s = dict(fresh, old_handle=base.get("old_handle", ""), status="discovery_candidate", candidate_handle=e["new_handle"],
                     attempts=base.get("attempts", 0) + 1, last_discovery_attempt=now,
                     candidate_title=e["candidate_title"], match_score=e["match_score"])
        elif s is None:
            continue
        elif k == "attempt":
            s = dict(s, attempts=s["attempts"] + 1, last_discovery_attempt=now, updated_at=now)
        elif k == "verdict":
            s = dict(s, status=e["verdict"], reason=e["reason"], updated_at=now)
        else:
            status = {"confirm_failed": "confirmation_failed"}.get(k, k)
            s = dict(s, status=status, updated_at=now, reason=S.FAILED_REASON if k == "confirm_failed" else e["reason"])
    return s


def random_events(seed, links=60):
    rnd = random.Random(seed)
    rows = []
    for link in range(links):
        at = T0
        for i in range(rnd.randint(1, 14)):
            at += datetime.timedelta(hours=rnd.choice([0, 1, 5, 30]))
            k = rnd.choice(KINDS)
            rows.append(dict(seller_id="s", entity_id=f"e{link}", event_ord=i, event_ts=at, event=k, old_handle=f"o{i}", new_handle=f"n{i}",
                             redirect_url=f"u{i}", verdict=rnd.choice(["confirmed", "rejected"]), reason=f"r{i}", common_name=f"c{i}",
                             botanical_name=None, candidate_title=f"t{i}", match_score=0.5 + i / 100))
    return rows


def check(df, rows):
    want = {}
    for r in rows:
        want.setdefault(r["entity_id"], []).append(r)
    want = {k: plain_fold(v) for k, v in want.items()}
    want = {k: v for k, v in want.items() if v}
    got = {r["entity_id"]: r.asDict() for r in df.collect()}
    assert set(got) == set(want)
    for k in want:
        assert {f: got[k][f] for f in FIELDS} == {f: want[k][f] for f in FIELDS}, k


@pytest.mark.parametrize("seed", [1, 2])
def test_fold_matches_plain(spark, seed):
    rows = random_events(seed, 150)
    check(S.link_state(spark.createDataFrame(rows, S.EVENT)), rows)


def test_fold_in_two_steps(spark):
    rows = random_events(3)
    df = spark.createDataFrame(rows, S.EVENT)
    early = F.col("event_ord") < 5
    check(S.link_state(df.filter(~early), S.link_state(df.filter(early))), rows)


def test_cooldown_and_limit(spark):
    now = datetime.datetime(2026, 4, 6, 20)
    hours = lambda h: now - datetime.timedelta(hours=h)
    rows = [("a", "broken", 0, None), ("b", "broken", 1, hours(20)), ("c", "broken", 1, hours(19.99)), ("d", "broken", 6, None),
            ("e", "broken", 7, None), ("f", "confirmed", 0, None)]
    df = spark.createDataFrame(rows, "entity_id STRING, status STRING, attempts INT, last_discovery_attempt TIMESTAMP")
    assert {r[0] for r in S.actionable(df, F.lit(now)).collect()} == {"a", "b", "d"}
    full = df.withColumn("updated_at", F.lit(None).cast("timestamp")).withColumn("reason", F.lit(None).cast("string"))
    gone = S.expire(full, F.lit(now)).filter("status = 'unrecoverable'").collect()
    assert [(r["entity_id"], r["reason"]) for r in gone] == [("e", "No candidate found after 7 attempts")]


def test_recovery_run(spark):
    now = F.lit(datetime.datetime(2026, 4, 6)).cast("timestamp")
    blank = {f: None for f in ["candidate_handle", "redirect_url", "last_discovery_attempt", "common_name", "botanical_name",
                               "candidate_title", "match_score", "reason"]}
    link = lambda e, seller="s", n=0: dict(blank, seller_id=seller, entity_id=e, old_handle="old", status="broken", attempts=n, created_at=T0, updated_at=T0)
    state = spark.createDataFrame([link("lime"), link("ghost"), link("lime", "x"), link("tired", n=7), link("odd")], LINK_STATE)
    catalog = spark.createDataFrame([("lime", "Limelight Hydrangea", "Hydrangea paniculata"), ("odd", "Quartz Plum", None)],
                                    "entity_id STRING, name STRING, botanical STRING")
    sellers = spark.createDataFrame([("s", "shopify"), ("x", "custom")], "seller_id STRING, scraper_type STRING")
    v = [("1", "1 Gallon", "39.99", None, True, None)]
    products = spark.createDataFrame(
        [("s", 1, "old", "Limelight Hydrangea", v), ("s", 2, "lime-new", "Limelight Hydrangea Tree", v), ("s", 3, "rose", "Red Rose", v)],
        f"seller_id STRING, product_ord BIGINT, handle STRING, title STRING, variants ARRAY<{VARIANT}>")
    snapshot = spark.createDataFrame([("s", "lime", "1gal", 35.0)], "seller_id STRING, entity_id STRING, tier STRING, price DOUBLE")
    new, events, summary = jobs.recover_links(state, now, catalog, sellers, products, snapshot)
    got = {(r["seller_id"], r["entity_id"]): r for r in new.collect()}
    hit = got[("s", "lime")]
    assert (hit["status"], hit["candidate_handle"], hit["match_score"], hit["attempts"], hit["old_handle"]) == (
        "discovery_candidate", "lime-new", 1.0, 1, "old")
    assert (got[("s", "ghost")]["attempts"], got[("s", "odd")]["attempts"], got[("x", "lime")]["attempts"]) == (1, 1, 0)
    assert got[("s", "tired")]["status"] == "unrecoverable"
    found = {r["entity_id"]: r for r in events.filter("event = 'discovery'").collect()}
    assert found["lime"]["old_prices"] == {"1gal": 35.0} and found["lime"]["candidate_prices"] == {"1 Gallon": 39.99}
    assert summary.first().asDict() == {"entries_processed": 3, "candidates_found": 1, "marked_unrecoverable": 1, "skipped": 1}


def test_apply_validated_and_upsert(spark):
    state = spark.createDataFrame([("s", "a", "confirmed", "h1"), ("s", "b", "confirmed", "h2"), ("s", "c", "confirmed", None),
                                   ("q", "d", "confirmed", "h4"), ("s", "e", "broken", "h5")], "seller_id STRING, entity_id STRING, status STRING, candidate_handle STRING")
    sellers = spark.createDataFrame([("s",)], "seller_id STRING")
    probes = spark.createDataFrame([("s", "a", 200, True), ("s", "b", 404, None), ("s", "c", 200, True), ("q", "d", 200, True), ("s", "e", 200, True)],
                                   "seller_id STRING, entity_id STRING, status_code INT, has_product BOOLEAN")
    handles, events = S.apply_validated(state, sellers, probes, F.current_timestamp())
    assert {(r["entity_id"], r["event"]) for r in events.collect()} == {("a", "applied"), ("b", "confirm_failed")}
    old = spark.createDataFrame([("s", "a", "h0"), ("t", "z", "k")], "seller_id STRING, entity_id STRING, handle STRING")
    assert {tuple(r) for r in K.upsert_mapping(old, handles, S.LINK).collect()} == {("s", "a", "h1"), ("t", "z", "k")}


def test_insert_batch_is_all_or_nothing(spark):
    cat = spark.createDataFrame([("a",)], "id STRING")
    assert K.insert_batch(cat, spark.createDataFrame([("b",)], "id STRING")).count() == 2
    with pytest.raises(Exception, match="already exist"):
        K.insert_batch(cat, spark.createDataFrame([("a",), ("b",)], "id STRING")).collect()


def test_patch_zone(spark):
    w = "STRUCT<spring: STRING, fall: STRING, summer: STRING>"
    cat = spark.createDataFrame([("e", [3, 8], {"3": ("May", "Sep", None)}), ("f", [9], {})], f"id STRING, zones ARRAY<INT>, planting_seasons MAP<STRING,{w}>")
    got = {r["id"]: r for r in K.patch_zone(cat, "e", 9, "Feb-Mar", "Nov-Dec").collect()}
    assert got["e"]["zones"] == [3, 8, 9] and got["e"]["planting_seasons"]["9"]["spring"] == "Feb-Mar" and got["f"]["zones"] == [9]
