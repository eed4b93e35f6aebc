"""Streams with state per key: any cut into batches, repeats, timers, lateness and the size of the state."""
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from offerlens.operators import compare as A
from offerlens.operators import state as S
from offerlens.streaming import jobs as T
from offerlens.streaming import keyed as Y

DAY = datetime(2024, 1, 1)
KINDS = ["broken", "broken", "attempt", "attempt", "redirect", "discovery", "verdict", "confirm_failed", "unrecoverable", "applied"]


def event(seller, entity, n, kind, hours=None):
    at = DAY + timedelta(hours=n if hours is None else hours)
    return (seller, entity, n, at, kind, f"old{n}", f"new{n}", f"to{n}", "confirmed" if n % 2 else "rejected", f"why{n}",
            f"name{n}", None, f"title{n}", 0.5)


class Feed:
    """A folder of files and a stream over it that runs whenever asked."""

    def __init__(self, spark, path, schema, make, mode="update"):
        self.spark, self.base, self.schema, self.make, self.mode, self.query = spark, str(path), schema, make, mode, None
        Y.use_keyed_state(spark)

    def land(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.base + "/in")
        stream = self.spark.readStream.schema(self.schema).parquet(self.base + "/in")

        def write(batch, i):
            batch.write.mode("overwrite").parquet(f"{self.base}/out/b={i}")
        self.query = (self.make(stream).writeStream.outputMode(self.mode).foreachBatch(write)
                      .option("checkpointLocation", self.base + "/state").trigger(availableNow=True).start())
        self.query.awaitTermination()
        return self

    @property
    def state(self):
        return self.base + "/state"

    def out(self):
        return self.spark.read.parquet(self.base + "/out")


def test_link_state_of_any_batches_and_repeats(spark, tmp_path):
    rng = random.Random(6)
    events = [event(rng.choice("st"), rng.choice("abcdef"), n, rng.choice(KINDS)) for n in range(160)]
    feed = Feed(spark, tmp_path, S.EVENT, Y.link_changes)
    for lo, hi in ((0, 50), (50, 51), (51, 160)):
        part = events[lo:hi]
        rng.shuffle(part)
        feed.land(part)
    assert Y.state_size(feed.query)["rows"] >= 1
    want = S.link_state(spark.createDataFrame(events, S.EVENT)).collect()
    got = Y.link_states(spark, feed.state).drop("due")
    assert sorted(map(str, got.collect())) == sorted(map(str, want)) and want
    feed.land(events[60:120])  # delivered once more
    assert sorted(map(str, Y.link_states(spark, feed.state).drop("due").collect())) == sorted(map(str, want))
    touched = feed.out().groupBy("b").count().orderBy("b").collect()
    assert touched[1]["count"] <= 1  # one event, one link


def test_rest_and_expiry_by_timers(spark, tmp_path):
    feed = Feed(spark, tmp_path, S.EVENT, lambda s: Y.link_changes(s, late="0 seconds", cooldown_hours=20, limit=2))
    feed.land([event("s", "rests", 1, "broken"), event("s", "rests", 2, "attempt"), event("s", "spent", 3, "broken"),
               event("s", "spent", 4, "attempt"), event("s", "spent", 5, "attempt"), event("s", "gone", 6, "broken"), event("s", "gone", 7, "applied")])
    feed.land([event("s", "clock", 8, "broken", hours=12)])
    now = {r.entity_id: (r.status, r.due) for r in Y.link_states(spark, feed.state).collect()}
    assert now["rests"] == ("broken", False) and "gone" not in now
    assert now["spent"] == ("unrecoverable", False)
    feed.land([event("s", "clock", 9, "attempt", hours=30)])
    assert {r.entity_id: r.due for r in Y.link_states(spark, feed.state).collect()}["rests"]
    feed.land([event("s", "rests", 10, "attempt", hours=31)])
    links = {r.entity_id: r for r in Y.link_states(spark, feed.state).collect()}
    assert not links["rests"].due and links["rests"].attempts == 2
    assert links["spent"].reason == "No candidate found after 2 attempts"
    kinds = {(r.entity_id, r.change) for r in feed.out().collect()}
    assert {("rests", "due"), ("spent", "expired"), ("gone", "state")} <= kinds or {("rests", "due"), ("spent", "expired")} <= kinds


def test_latest_ignores_older_records(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.choice("abc"), rng.choice("st"), DAY + timedelta(hours=rng.randint(0, 40)), n, float(n)) for n in range(90)] + [("a", "s", None, 500, 1.0)]
    schema = "entity_id STRING, seller_id STRING, obs_ts TIMESTAMP, ord INT, price DOUBLE"
    feed = Feed(spark, tmp_path, schema, lambda s: Y.latest_changes(s, ["price"]))
    jumbled = rng.sample(rows, len(rows))
    for lo in range(0, len(rows), 40):
        feed.land(jumbled[lo: lo + 40])
    columns = ["entity_id", "seller_id", "obs_ts", "ord", "price"]
    want = A.latest_per_key(spark.createDataFrame(rows, schema), ["entity_id", "seller_id"], ["obs_ts", "ord"]).select(*columns)
    assert sorted(Y.latest_records(spark, feed.state).select(*columns).collect()) == sorted(want.collect())
    before = Y.state_size(feed.query)["rows"]
    feed.land(rows[:5])
    assert Y.state_size(feed.query)["rows"] == before and feed.out().filter(f"b = {feed.query.lastProgress['batchId']}").count() == 0


def test_forgotten_after_time_to_live(spark, tmp_path):
    import time

    schema = "entity_id STRING, seller_id STRING, obs_ts TIMESTAMP, ord INT, price DOUBLE"
    feed = Feed(spark, tmp_path, schema, lambda s: Y.latest_changes(s, ["price"], ttl_ms=1))
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # a clock asks for batches for ever
    try:
        feed.land([("a", "s", DAY, 9, 9.0)])
        time.sleep(0.1)
        feed.land([("a", "s", DAY, 1, 1.0)])  # older, but nothing is known any more
    finally:
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    assert sorted(r.price for r in feed.out().collect()) == [1.0, 9.0]


@pytest.mark.parametrize("late,kept", [("1 day", False), ("3 days", True)])
def test_final_rows_late_rows_and_state_size(spark, tmp_path, late, kept):
    schema = "entity_id STRING, seller_id STRING, obs_ts TIMESTAMP, ord INT, price DOUBLE"
    feed = Feed(spark, tmp_path, schema, lambda s: T.stream_daily_low(s, late), mode="append")
    row = lambda day, price, n=0: ("a", "s", DAY + timedelta(days=day, hours=3), n, price)
    for day in range(6):
        feed.land([row(day, 10.0 + day)])
    open_windows = Y.state_size(feed.query)["rows"]
    assert open_windows <= (2 if not kept else 4)  # closed days have left the state
    feed.land([row(2, 1.0)])  # three days late
    assert (Y.state_size(feed.query)["dropped_late"] > 0) is not kept
    feed.land([row(30, 5.0)])
    low = {str(r.day): r.low for r in feed.out().collect()}
    assert low["2024-01-03"] == (1.0 if kept else 12.0)
    assert len(low) == feed.out().count() == 6  # each day once, the last still open
