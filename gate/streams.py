"""Streaming forms over the events table. Results go to a folder beside the checkpoints."""
from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from gate import tables as G
from gate.base import Gate
from gate.history import RUNS, STAMP
from gate.state import STATE_SQL, link_events
from offerlens.session import checkpoint_dir
from offerlens.streaming import jobs as T
from offerlens.streaming import keyed as Y

gate = Gate()
QUERIES, SQL = gate.queries, gate.sql


def event_stream(spark, d):
    schema = G.table(spark, d, "events").schema
    return spark.readStream.schema(schema).parquet(os.path.join(d, "events.parqu*"))


def run_to_table(df, mode):
    """Run a stream over all that is there, then read what its last batch wrote."""
    spark = df.sparkSession
    base = os.path.join(checkpoint_dir(spark), f"stream-{uuid.uuid4().hex}")

    def write(batch, batch_id):
        batch.withColumn("_batch", F.lit(batch_id)).write.mode("overwrite").parquet(os.path.join(base, "out", f"b={batch_id}"))

    q = (df.writeStream.outputMode(mode).foreachBatch(write)
         .option("checkpointLocation", os.path.join(base, "state")).trigger(availableNow=True).start())
    q.awaitTermination()
    out = spark.read.parquet(os.path.join(base, "out"))
    newest = out.agg(F.max("_batch").alias("_batch"))
    return (out.join(newest, "_batch") if mode == "complete" else out).drop("_batch", "b")


def observations(spark, d, events=None):
    return (event_stream(spark, d) if events is None else events).select(
        F.col("user_id").alias("entity_id"), F.col("event_type").alias("seller_id"), F.col("ts").cast("timestamp").alias("obs_ts"),
        F.col("event_id").alias("ord"), F.lit("1gal").alias("tier"), F.col("value").alias("price"))


@gate("stream_latest", """SELECT user_id AS entity_id, event_type AS seller_id, ARG_MAX(value, (ts, event_id)) AS price, MAX(event_id) AS ord FROM events GROUP BY 1, 2""")
def stream_latest(spark, d):
    return run_to_table(T.stream_latest(observations(spark, d), ["price", "ord"]), "update").drop("obs_ts")


@gate("stream_runs", f"""WITH {RUNS} SELECT entity_id, {STAMP.format('MIN(obs_ts)')} AS run_start, {STAMP.format('MAX(obs_ts)')} AS run_end,
  COUNT(*) AS n_obs, ARRAY_TO_STRING(LIST_SORT(LIST(DISTINCT seller_id)), ',') AS sellers FROM runs GROUP BY entity_id, run""")
def stream_runs(spark, d):
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return run_to_table(T.stream_runs(observations(spark, d)), "complete").select(
        "entity_id", stamp("run_start"), stamp("run_end"), "n_obs", F.array_join("sellers", ",").alias("sellers"))


@gate("stream_daily_low", "SELECT user_id AS entity_id, event_type AS seller_id, STRFTIME(ts, '%Y-%m-%d') AS day, MIN(value) AS low FROM events WHERE value > 0 GROUP BY 1, 2, 3")
def stream_daily_low(spark, d):
    return run_to_table(T.stream_daily_low(observations(spark, d)), "complete").withColumn("day", F.col("day").cast("string"))


STEPS = 4


def in_steps(spark, df, step, steps, query):
    """Land ``df`` in ``steps`` parts, by the column ``step``, and run the stream over each part as it lands; it stops
    after each and goes on from its checkpoint. ``query`` makes the writer of a stream. Returns the base folder."""
    base = os.path.join(checkpoint_dir(spark), f"stream-{uuid.uuid4().hex}")
    landed, parts = os.path.join(base, "landed"), df.withColumn("_step", F.coalesce(step, F.lit(0)))
    for i in range(steps):
        parts.filter(F.col("_step") == i).drop("_step").write.mode("append").parquet(landed)
        stream = spark.readStream.schema(df.schema).parquet(landed)
        q = query(stream, base).option("checkpointLocation", os.path.join(base, "state")).trigger(availableNow=True).start()
        q.awaitTermination()
    return base


def to_folder(df, base, mode):
    """Each batch in a folder of its own, which a repeated batch overwrites."""
    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(os.path.join(base, "out", f"b={batch_id}"))

    return df.writeStream.outputMode(mode).foreachBatch(write)


def by_time(ts, first, last, steps):
    """Number of the equal stretch of time that ``ts`` lies in."""
    at = F.floor((F.unix_seconds(ts) - F.lit(first)) * steps / F.lit(last - first + 1))
    return at.cast("int")


def bounds(df, ts):
    return df.agg(F.min(F.unix_seconds(ts)), F.max(F.unix_seconds(ts))).first()


def _links(spark, d, **options):
    """The state of links after their events came in four steps, by date."""
    Y.use_keyed_state(spark)
    e = link_events(spark, d)
    step = by_time(F.col("event_ts"), *bounds(e, "event_ts"), STEPS)
    base = in_steps(spark, e, step, STEPS, lambda s, base: to_folder(Y.link_changes(s, **options), base, "update"))
    return base, Y.link_states(spark, os.path.join(base, "state"))


@gate("stream_link_state", f"WITH {STATE_SQL} SELECT seller_id, entity_id, old_handle, status, candidate_handle, attempts, STRFTIME(created, '%Y-%m-%d %H:%M:%S') AS created, reason FROM links")
def stream_link_state(spark, d):
    """State kept per link; the stream stops and goes on three times."""
    return _links(spark, d)[1].select(
        "seller_id", "entity_id", "old_handle", "status", "candidate_handle", "attempts",
        F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created"), "reason")


@gate("stream_link_changes", f"WITH {STATE_SQL} SELECT seller_id, entity_id, status, attempts, reason FROM links")
def stream_link_changes(spark, d):
    """The last change of every link, from what the batches wrote."""
    rows = spark.read.parquet(os.path.join(_links(spark, d)[0], "out"))
    last = rows.groupBy("seller_id", "entity_id").agg(F.max_by(F.struct("change", "status", "attempts", "reason"), "b").alias("r"))
    return last.select("seller_id", "entity_id", "r.*").filter("change <> 'removed'").drop("change")


@gate("stream_link_due", f"""WITH {STATE_SQL}, w AS (SELECT MAX(ts) - INTERVAL 2 HOUR AS mark FROM events)
SELECT seller_id, entity_id, attempts, COALESCE(status = 'broken' AND COALESCE(attempted + INTERVAL 20 HOUR, updated) <= mark, FALSE) AS due FROM links, w""")
def stream_link_due(spark, d):
    """Broken links whose last attempt has rested once the watermark stands two hours before the last event."""
    return _links(spark, d, late="2 hours", limit=1 << 30)[1].select("seller_id", "entity_id", "attempts", "due")


@gate("stream_latest_keyed", """SELECT user_id AS entity_id, event_type AS seller_id, ARG_MAX(value, (ts, event_id)) AS price, MAX(event_id) AS ord FROM events GROUP BY 1, 2""")
def stream_latest_keyed(spark, d):
    """The last record of every pair from the kept state; records come in no order over four steps."""
    Y.use_keyed_state(spark)
    obs = observations(spark, d, G.table(spark, d, "events"))
    step = F.pmod(F.xxhash64("ord"), F.lit(STEPS)).cast("int")
    base = in_steps(spark, obs, step, STEPS, lambda s, base: to_folder(Y.latest_changes(s, ["price"]), base, "update"))
    return Y.latest_records(spark, os.path.join(base, "state")).drop("obs_ts")


LATE = 86_400  # seconds that a record may come late
#: Seconds that a record is held up before it lands, less than LATE. Every 101st comes with the last step.
HELD, VERY_LATE = "(event_id * 7919) % 86400", "event_id % 101 = 0"
FAR = "TIMESTAMP '2030-01-01 00:00:00'"  # the closing record's time


def _jumbled(spark, d, very_late):
    """Observations in the order they land: held up by less than the allowed lateness, some much later; then one record
    far in the future, which closes all windows."""
    e = G.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    first, last = bounds(e, "ts")
    step = by_time(F.timestamp_seconds(F.unix_seconds("ts") + F.expr(HELD)), first, last + LATE, STEPS)
    if very_late:
        step = F.when(F.expr(VERY_LATE), STEPS - 1).otherwise(step)
    obs = observations(spark, d, e)
    steps = e.select(F.col("event_id").alias("ord"), step.alias("_step"))
    closing = obs.limit(1).select(
        F.lit(-1).cast("bigint").alias("entity_id"), "seller_id", F.expr(FAR).alias("obs_ts"), F.lit(-1).cast("bigint").alias("ord"), "tier", "price")
    rows = obs.join(steps, "ord").unionByName(closing.withColumn("_step", F.lit(STEPS)))
    return rows.select("entity_id", "seller_id", "obs_ts", "ord", "tier", "price", "_step")


def _closed(spark, d, stream, very_late=False):
    rows = _jumbled(spark, d, very_late)
    base = in_steps(spark, rows, F.col("_step"), STEPS + 1, lambda s, base: to_folder(stream(s.drop("_step")), base, "append"))
    return spark.read.parquet(os.path.join(base, "out")).drop("b")


@gate("stream_runs_final", f"""WITH {RUNS} SELECT entity_id, {STAMP.format('MIN(obs_ts)')} AS run_start, {STAMP.format('MAX(obs_ts)')} AS run_end,
  COUNT(*) AS n_obs, ARRAY_TO_STRING(LIST_SORT(LIST(DISTINCT seller_id)), ',') AS sellers FROM runs GROUP BY entity_id, run""")
def stream_runs_final(spark, d):
    """Runs as they become final, each once, from records out of order."""
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return _closed(spark, d, T.stream_runs).select(
        "entity_id", stamp("run_start"), stamp("run_end"), "n_obs", F.array_join("sellers", ",").alias("sellers"))


@gate("stream_daily_low_final", f"""WITH e AS (SELECT *, CAST(FLOOR(EPOCH(ts)) AS BIGINT) AS sec FROM events), b AS (SELECT MIN(sec) AS lo, MAX(sec) + {LATE} AS hi FROM e),
s AS (SELECT e.*, {VERY_LATE} AS held, CASE WHEN {VERY_LATE} THEN {STEPS - 1} ELSE (sec + {HELD} - lo) * {STEPS} // (hi - lo + 1) END AS step FROM e, b),
w AS (SELECT MAX(ts) - INTERVAL {LATE} SECOND AS mark FROM s WHERE step < {STEPS - 1})
SELECT user_id AS entity_id, event_type AS seller_id, STRFTIME(ts, '%Y-%m-%d') AS day, MIN(value) AS low FROM s, w
WHERE value > 0 AND NOT (held AND CAST(CAST(ts AS DATE) + 1 AS TIMESTAMP) <= mark) GROUP BY 1, 2, 3""")
def stream_daily_low_final(spark, d):
    """Daily lows as they become final; what comes after its day was closed is dropped."""
    return _closed(spark, d, T.stream_daily_low, very_late=True).withColumn("day", F.col("day").cast("string"))


SNAPSHOT = "entity_id BIGINT, seller_id STRING, tier STRING, price DOUBLE"
RUN_DAYS = 5  # a run is five days of events
RUN = f"lpad(CAST(floor((unix_date(to_date(obs_ts)) - 19723) / {RUN_DAYS}) AS STRING), 6, '0')"
#: A pair's baseline is the last accepted price of the run before; a run without any leaves none.
GATE_SQL = f"""RECURSIVE e AS (SELECT user_id AS entity_id, event_type AS seller_id, event_id AS ord, value AS price,
  CAST(FLOOR(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) / {RUN_DAYS}) AS INT) AS run FROM events),
runs AS (SELECT DISTINCT run FROM e), pairs AS (SELECT DISTINCT entity_id, seller_id FROM e),
lists AS (SELECT p.entity_id, p.seller_id, r.run, COALESCE(LIST(e.price ORDER BY e.ord) FILTER (e.ord IS NOT NULL), []) AS prices
  FROM pairs p CROSS JOIN runs r LEFT JOIN e ON e.entity_id = p.entity_id AND e.seller_id = p.seller_id AND e.run = r.run GROUP BY 1, 2, 3),
base AS (
  SELECT entity_id, seller_id, MIN(run) AS run, NULL::DOUBLE AS old, ARG_MIN(prices, run) AS prices FROM lists GROUP BY 1, 2
  UNION ALL
  SELECT l.entity_id, l.seller_id, l.run,
    LIST_FILTER(b.prices, lambda x: b.old IS NULL OR b.old <= 0 OR x <= 0 OR ABS(x - b.old) / b.old * 100 <= 50)[-1], l.prices
  FROM base b JOIN lists l ON l.entity_id = b.entity_id AND l.seller_id = b.seller_id AND l.run = b.run + 1)"""


def _gated(spark, d, files):
    """Run the gate over the events as they land in ``files`` parts by time."""
    offers = observations(spark, d, G.table(spark, d, "events"))
    step = by_time(F.col("obs_ts"), *bounds(offers, "obs_ts"), files)
    gated = lambda s, base: T.stream_gate(s, base, os.path.join(base, "state"), SNAPSHOT, run=RUN)
    base = in_steps(spark, offers, step, files, gated)
    T.finish_gate(spark, base, offers.schema, SNAPSHOT, run=RUN)
    return base


@gate("stream_gate", f"""WITH {GATE_SQL}
SELECT e.ord, e.entity_id, e.seller_id, '1gal' AS tier, e.price, b.old AS old_price,
  NOT COALESCE(b.old > 0 AND e.price > 0 AND ABS(e.price - b.old) / b.old * 100 > 50, FALSE) AS accepted
FROM e JOIN base b USING (entity_id, seller_id, run)""")
def stream_gate(spark, d):
    """Events in several batches: every one is filed, accepted or quarantined against the run before."""
    return T.gated_offers(spark, _gated(spark, d, 4)).select(
        "ord", "entity_id", "seller_id", "tier", "price", "old_price", "accepted")


@gate("stream_gate_snapshot", f"""WITH {GATE_SQL}, after AS (SELECT entity_id, seller_id,
  LIST_FILTER(prices, lambda x: old IS NULL OR old <= 0 OR x <= 0 OR ABS(x - old) / old * 100 <= 50)[-1] AS price
  FROM base WHERE run = (SELECT MAX(run) FROM runs))
SELECT entity_id, seller_id, '1gal' AS tier, price FROM after WHERE price IS NOT NULL""")
def stream_gate_snapshot(spark, d):
    """The price snapshot after the last run."""
    return T.newest_version(spark, os.path.join(_gated(spark, d, 3), "snapshot"), SNAPSHOT)
