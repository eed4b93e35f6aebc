"""Runs, availability, price history and price moves."""
from __future__ import annotations

from pyspark.sql import functions as F

from gate import tables as G
from gate.base import Gate
from offerlens.operators import history as W

gate = Gate()
QUERIES, SQL = gate.queries, gate.sql


def event_obs(spark, d):
    """Events as observations: the user is the entity, the event type the seller."""
    return G.table(spark, d, "events").select(
        F.col("user_id").alias("entity_id"),
        F.col("event_type").alias("seller_id"),
        F.col("ts").alias("obs_ts"),
        F.col("ts").cast("date").alias("obs_date"),
        F.col("event_id").alias("ord"),
        F.lit("1gal").alias("tier"),
        F.col("value").alias("price"),
    )


RUNS = "ev AS (SELECT user_id AS entity_id, event_type AS seller_id, ts AS obs_ts, event_id AS ord, value AS price FROM events)," + G.RUNS_SQL.replace("OBS", "ev")
STAMP = "STRFTIME({}, '%Y-%m-%d %H:%M:%S')"


@gate("cluster_runs", f"""WITH {RUNS}
SELECT entity_id, CAST(run AS INT) AS run, {STAMP.format('MIN(obs_ts)')} AS run_start, {STAMP.format('MAX(obs_ts)')} AS run_end,
  COUNT(*) AS n_obs, COUNT(DISTINCT seller_id) AS n_sellers FROM runs GROUP BY 1, 2""")
def cluster_runs(spark, d):
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return W.cluster_runs(event_obs(spark, d)).select(
        "entity_id", "run", stamp("run_start"), stamp("run_end"), "n_obs", "n_sellers")


@gate("assign_runs", f"WITH {RUNS} SELECT entity_id, ord, CAST(run AS INT) AS run FROM runs")
def assign_runs(spark, d):
    return W.assign_runs(event_obs(spark, d)).select("entity_id", "ord", "run")


@gate("consecutive_misses", f"WITH {RUNS} SELECT entity_id, seller_id, misses, misses >= 3 AS unavailable FROM misses")
def consecutive_misses(spark, d):
    return W.availability(W.consecutive_misses(event_obs(spark, d)))


@gate("offer_availability", f"WITH {G.OFFERS_SQL},{G.RUNS_SQL.replace('OBS', 'offers')} SELECT entity_id, seller_id, misses, misses >= 3 AS unavailable FROM misses")
def offer_availability(spark, d):
    return W.availability(W.consecutive_misses(G.offers(spark, d)))


HISTORY = """hist AS (
  SELECT entity_id, obs_date, seller_id, price FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY entity_id, obs_date, seller_id ORDER BY ord DESC, price) AS rn FROM src
    WHERE price > 0 AND entity_id IN (SELECT entity_id FROM src GROUP BY 1 HAVING COUNT(DISTINCT ord) >= 2)
      AND KEEP) WHERE rn = 1)"""
OFFER_SRC = f"{G.OFFERS_SQL},{G.SELLERS_SQL}, src AS (SELECT * FROM offers)"
ACTIVE = "seller_id IN (SELECT seller_id FROM sellers WHERE COALESCE(active, TRUE))"


def _active(spark, d):
    return G.sellers(spark, d).filter(F.coalesce("active", F.lit(True)))


@gate("price_history", f"""WITH {OFFER_SRC}, {HISTORY.replace('KEEP', ACTIVE)}
SELECT entity_id, seller_id, STRFTIME(obs_date, '%Y-%m-%d') AS obs_date, price FROM hist""")
def price_history(spark, d):
    return W.price_history(G.offers(spark, d), _active(spark, d)).withColumn("obs_date", F.col("obs_date").cast("string"))


@gate("price_history_events", f"""WITH src AS (SELECT user_id AS entity_id, event_type AS seller_id, CAST(ts AS DATE) AS obs_date, event_id AS ord, value AS price FROM events),
{HISTORY.replace('KEEP', 'TRUE')} SELECT entity_id, seller_id, STRFTIME(obs_date, '%Y-%m-%d') AS obs_date, price FROM hist""")
def price_history_events(spark, d):
    return W.price_history(event_obs(spark, d)).withColumn("obs_date", F.col("obs_date").cast("string"))


@gate("history_matrix", f"""WITH src AS (SELECT user_id AS entity_id, event_type AS seller_id, CAST(ts AS DATE) AS obs_date, event_id AS ord, value AS price FROM events),
{HISTORY.replace('KEEP', 'TRUE')},
days AS (SELECT DISTINCT entity_id, obs_date FROM hist), seen AS (SELECT DISTINCT entity_id, seller_id FROM src)
SELECT entity_id, seller_id, STRING_AGG(STRFTIME(obs_date, '%Y-%m-%d'), ',' ORDER BY obs_date) AS dates,
  STRING_AGG(COALESCE(printf('%.2f', price), '-'), ',' ORDER BY obs_date) AS prices
FROM days JOIN seen USING (entity_id) LEFT JOIN hist USING (entity_id, obs_date, seller_id) GROUP BY 1, 2""")
def history_matrix(spark, d):
    o = event_obs(spark, d)
    out = W.history_matrix(W.price_history(o), o)
    return out.select(
        "entity_id", "seller_id", F.array_join(F.transform("dates", lambda x: x.cast("string")), ",").alias("dates"),
        F.array_join(F.transform("prices", lambda p: F.when(p.isNull(), "-").otherwise(F.format_string("%.2f", p))), ",").alias("prices"))


@gate("monthly_first_snapshot", """SELECT 'u' || user_id AS url, STRFTIME(ts, '%Y%m') AS yyyymm, MIN(event_id) AS event_id FROM events GROUP BY 1, 2""")
def monthly_first_snapshot(spark, d):
    snaps = G.table(spark, d, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("url"), F.date_format("ts", "yyyyMM").alias("yyyymm"),
        F.col("ts").alias("snapshot_ts"), "event_id")
    return W.monthly_first_snapshot(snaps).select("url", "yyyymm", "event_id")


MOVES = f"""{G.OFFERS_SQL}, moves AS (
  SELECT entity_id, seller_id, raw_tier AS tier, ord, price, LAG(price) OVER (PARTITION BY entity_id, seller_id, raw_tier ORDER BY ord) AS old_price FROM offers)"""


@gate("price_moves", f"WITH {MOVES} SELECT * FROM moves")
def price_moves(spark, d):
    o = G.offers(spark, d).withColumn("tier", F.col("raw_tier"))
    return W.price_moves(o).select("entity_id", "seller_id", "tier", "ord", "price", "old_price")


@gate("price_drops", f"""WITH {MOVES}
SELECT entity_id, seller_id, tier, old_price, price, CAST(ROUND_EVEN((1 - price / old_price) * 100, 0) AS INT) AS drop_pct
FROM moves WHERE price < old_price
ORDER BY ROUND_EVEN((1 - price / old_price) * 100, 0) DESC, old_price - price DESC, entity_id, seller_id, tier, ord LIMIT 6""")
def price_drops(spark, d):
    o = G.offers(spark, d).withColumn("tier", F.col("raw_tier"))
    return W.price_drops(o).select("entity_id", "seller_id", "tier", "old_price", "price", "drop_pct")


@gate("observed_index", f"""WITH {G.OFFERS_SQL}, priced AS (
  SELECT p_type AS category, MONTH(obs_date) AS month, CAST(price AS DECIMAL(18, 2)) AS price FROM offers JOIN part ON p_partkey = entity_id),
m AS (SELECT category, month, CAST(SUM(price) AS DOUBLE) AS s, COUNT(*) AS n FROM priced GROUP BY 1, 2),
r AS (SELECT category, month, ROUND((s / n) / (SUM(s) OVER (PARTITION BY category) / SUM(n) OVER (PARTITION BY category)), 6) AS ratio FROM m)
SELECT category, month, ratio, CAST(NTILE(5) OVER (PARTITION BY category ORDER BY ratio, month) AS INT) AS level FROM r""")
def observed_index(spark, d):
    parts = G.table(spark, d, "part").select(F.col("p_partkey").alias("entity_id"), F.col("p_type").alias("category"))
    return W.observed_index(G.offers(spark, d).join(parts, "entity_id"))
