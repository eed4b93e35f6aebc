"""Filters, gates and checks."""
from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from gate import tables as G
from gate.base import Gate
from offerlens.operators import catalog as K
from offerlens.operators import joins as J
from offerlens.operators import quality as Q

gate = Gate()
QUERIES, SQL = gate.queries, gate.sql


@gate("active_only", "SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 > 0")
def active_only(spark, d):
    key = F.col("s_suppkey")
    s = G.table(spark, d, "supplier").withColumn("active", F.when(key % 3 == 0, F.lit(False)).when(key % 3 == 1, F.lit(True)))
    return Q.active_only(s).select("s_suppkey")


@gate("active_or_missing_inactive", "SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 = 1")
def active_strict(spark, d):
    key = F.col("s_suppkey")
    s = G.table(spark, d, "supplier").withColumn("active", F.when(key % 3 == 0, F.lit(False)).when(key % 3 == 1, F.lit(True)))
    return Q.active_only(s, missing_is_active=False).select("s_suppkey")


@gate("drop_stale", f"WITH {G.OFFERS_SQL} SELECT entity_id, seller_id, ord, pos FROM offers WHERE date_diff('day', obs_date, DATE '2001-11-05') <= 30")
def drop_stale(spark, d):
    return Q.drop_stale(G.offers(spark, d), G.AS_OF, 30).select("entity_id", "seller_id", "ord", "pos")


@gate("positive_price", "SELECT event_id, value - 5 AS price FROM events WHERE value > 5")
def positive_price(spark, d):
    e = G.table(spark, d, "events").select("event_id", (F.col("value") - 5).alias("price"))
    return Q.positive_price(e)


# A run against the snapshot: the snapshot holds the first prices of the years before 2000, the run
# the last prices since.
RUN_SQL = f"""{G.OFFERS_SQL},
snap AS (SELECT entity_id, seller_id, raw_tier AS tier, ARG_MIN(price, ord) AS price FROM offers WHERE obs_date < DATE '2000-01-01' GROUP BY 1, 2, 3),
fresh AS (SELECT entity_id, seller_id, raw_tier AS tier, ARG_MAX(price, ord) AS price FROM offers WHERE obs_date >= DATE '2000-01-01' GROUP BY 1, 2, 3),
flags AS (
  SELECT f.*, s.price AS old_price, ABS(f.price - s.price) / s.price * 100 AS change_pct,
    COALESCE(ABS(f.price - s.price) / s.price * 100 > 50, FALSE) AS is_anomaly
  FROM fresh f LEFT JOIN snap s USING (entity_id, seller_id, tier)),
gated AS (SELECT *, NOT BOOL_OR(is_anomaly) OVER (PARTITION BY entity_id, seller_id) AS accepted FROM flags)"""


def _run(spark, d):
    o = G.offers(spark, d).withColumn("tier", F.col("raw_tier"))
    key = ["entity_id", "seller_id", "tier"]
    snap = o.filter("obs_date < '2000-01-01'").groupBy(*key).agg(F.min_by("price", "ord").alias("price"))
    fresh = o.filter("obs_date >= '2000-01-01'").groupBy(*key).agg(F.max_by("price", "ord").alias("price"))
    return fresh, snap


def gated(spark, d):
    return Q.swing_gate(*_run(spark, d))


@gate("swing_gate", f"WITH {RUN_SQL} SELECT entity_id, seller_id, tier, price, old_price, ROUND(change_pct, 6) AS change_pct, is_anomaly, accepted FROM gated")
def swing_gate(spark, d):
    return gated(spark, d).withColumn("change_pct", F.round("change_pct", 6))


@gate("with_snapshot", f"WITH {RUN_SQL} SELECT entity_id, seller_id, tier, price, old_price FROM flags")
def with_snapshot(spark, d):
    return J.with_snapshot(*_run(spark, d))


AFTER = "SELECT * FROM snap WHERE seller_id NOT IN (SELECT seller_id FROM fresh) UNION ALL SELECT entity_id, seller_id, tier, price FROM gated WHERE accepted"


@gate("snapshot_after", f"WITH {RUN_SQL} {AFTER}")
def snapshot_after(spark, d):
    return Q.snapshot_after(gated(spark, d), _run(spark, d)[1])


@gate("snapshot_after_keep_baseline", f"""WITH {RUN_SQL} {AFTER} UNION ALL
SELECT * FROM snap WHERE (entity_id, seller_id) IN (SELECT (entity_id, seller_id) FROM gated WHERE NOT accepted)""")
def snapshot_keep(spark, d):
    return Q.snapshot_after(gated(spark, d), _run(spark, d)[1], keep_baseline=True)


@gate("snapshot_after_empty_run", f"""WITH {RUN_SQL} SELECT * FROM snap WHERE seller_id NOT IN ('0', '1', '2') UNION ALL
SELECT entity_id, seller_id, tier, price FROM gated WHERE accepted AND seller_id = '0'""")
def snapshot_after_empty_run(spark, d):
    """Sellers 0 to 2 ran, only 0 found anything: 1 and 2 lose their old prices."""
    g = gated(spark, d).filter("seller_id = '0'")
    ran = G.sellers(spark, d).filter("seller_id IN ('0', '1', '2')")
    return Q.snapshot_after(g, _run(spark, d)[1], ran=ran)


@gate("anomaly_lines", f"""WITH {RUN_SQL} SELECT entity_id, seller_id, tier,
 'ANOMALY: ' || entity_id || ' at ' || seller_id || ' tier=' || tier || ': $' || printf('%.2f', old_price) || ' -> $' || printf('%.2f', price)
 || ' (' || CAST(CAST(ROUND_EVEN(change_pct, 0) AS BIGINT) AS VARCHAR) || '% change)' AS line FROM gated WHERE is_anomaly""")
def anomaly_lines(spark, d):
    return K.anomaly_lines(gated(spark, d))


STATS_SQL = f"""{RUN_SQL},
expected AS (SELECT DISTINCT seller_id, entity_id FROM offers),
ex AS (SELECT seller_id, COUNT(*) AS expected FROM expected GROUP BY 1),
fe AS (SELECT seller_id, COUNT_IF(entity_id % 4 > 0) AS found, COUNT_IF(entity_id % 4 = 0) AS errors FROM (SELECT DISTINCT entity_id, seller_id FROM fresh) GROUP BY 1),
pr AS (SELECT seller_id, COUNT(*) AS prices, COUNT_IF(is_anomaly) AS anomalies FROM gated GROUP BY 1),
stats AS (
  SELECT seller_id, expected, COALESCE(found, 0) AS found, COALESCE(errors, 0) AS errors, COALESCE(prices, 0) AS prices, COALESCE(anomalies, 0) AS anomalies
  FROM ex LEFT JOIN fe USING (seller_id) LEFT JOIN pr USING (seller_id))"""


def stats(spark, d):
    """Expected: every entity a seller ever listed."""
    fresh, _ = _run(spark, d)
    listed = G.offers(spark, d).select("entity_id", "seller_id").distinct()
    results = fresh.select("entity_id", "seller_id").distinct().withColumn(
        "error", F.when(F.col("entity_id") % 4 == 0, "HTTP 500"))
    return K.run_stats(listed, results, gated(spark, d))


@gate("run_stats", f"WITH {STATS_SQL} SELECT *, found < expected * 0.8 AS few_found FROM stats")
def run_stats(spark, d):
    return stats(spark, d)


HEALTH = "health AS (SELECT *, found / expected AS hit_rate, CASE WHEN found / expected < 0.8 THEN 'degraded' ELSE 'healthy' END AS health FROM stats)"


@gate("run_health", f"WITH {STATS_SQL}, {HEALTH} SELECT seller_id, ROUND(hit_rate, 6) AS hit_rate, health FROM health")
def run_health(spark, d):
    return K.run_health(stats(spark, d)).select("seller_id", F.round("hit_rate", 6).alias("hit_rate"), "health")


@gate("pipeline_health", f"""WITH {STATS_SQL}, {HEALTH} SELECT COUNT_IF(health = 'degraded') AS degraded_sellers,
 CASE WHEN COUNT_IF(health = 'degraded') > 0 THEN 'degraded' ELSE 'healthy' END AS pipeline_status FROM health""")
def pipeline_health(spark, d):
    return K.pipeline_health(K.run_health(stats(spark, d)))


@gate("snapshot_totals", f"WITH {STATS_SQL} SELECT CAST(SUM(prices) AS BIGINT) AS total_prices, CAST(SUM(anomalies) AS BIGINT) AS total_anomalies FROM stats")
def snapshot_totals(spark, d):
    return K.snapshot_totals(stats(spark, d))


@gate("merged_run_status", f"""WITH {STATS_SQL}, before AS (SELECT seller_id, expected, 0 AS found, errors, prices + 1 AS prices, anomalies FROM stats),
merged AS (SELECT * FROM before WHERE seller_id NOT IN ('0', '1') UNION ALL SELECT * FROM stats WHERE seller_id IN ('0', '1'))
SELECT COUNT_IF(found < expected * 0.8) AS degraded_sellers, CASE WHEN COUNT_IF(found < expected * 0.8) > 0 THEN 'degraded' ELSE 'healthy' END AS pipeline_status,
 CAST(SUM(prices) AS BIGINT) AS total_prices, CAST(SUM(anomalies) AS BIGINT) AS total_anomalies FROM merged""")
def merged_run_status(spark, d):
    """Sellers 0 and 1 ran anew, all others keep the stats of the run before, where they found nothing."""
    now = stats(spark, d)
    before = now.withColumns({"found": F.lit(0).cast("long"), "prices": F.col("prices") + 1})
    merged = K.merge_stats(before, now.filter("seller_id IN ('0', '1')"))
    totals = K.snapshot_totals(merged)
    return K.pipeline_health(K.run_health(merged)).withColumns({c: totals.select(c).scalar() for c in totals.columns})


# Verification: stored = latest price, fresh = the same a little off, with sizes missing.
CHECK_SQL = f"""{G.OFFERS_SQL},
stored AS (SELECT entity_id, seller_id, raw_tier AS tier, ARG_MAX(price, ord) AS price FROM offers GROUP BY 1, 2, 3),
fresh AS (SELECT entity_id, seller_id, tier, price * (1 + (entity_id % 5) / 100.0::DOUBLE) AS fresh_price FROM stored WHERE entity_id % 7 > 0 AND tier <> 'quart'),
both_sides AS (SELECT s.*, fresh_price, ABS(fresh_price - price) / price AS diff FROM stored s LEFT JOIN fresh USING (entity_id, seller_id, tier)),
checked AS (
  SELECT entity_id, seller_id, COUNT(*) AS stored_tiers, COUNT_IF(fresh_price IS NOT NULL AND diff <= 0.02) AS matches,
    COUNT_IF(COALESCE(diff > 0.02, FALSE)) AS mismatches, COUNT(fresh_price) AS fresh_tiers,
    STRING_AGG(CASE WHEN diff > 0.02 THEN tier END, ',' ORDER BY tier) AS off_tiers,
    CASE WHEN COUNT(fresh_price) = 0 THEN 'error' WHEN COUNT_IF(diff > 0.02) > 0 THEN 'MISMATCH' ELSE 'PASS' END AS status
  FROM both_sides GROUP BY 1, 2)"""
# Targets beyond the stored listings: every part asked for at seller x (no stored price) or, for every
# ninth, at no seller.
TARGETS_SQL = f"""{CHECK_SQL},
full_checked AS (
  SELECT entity_id, seller_id, stored_tiers, status FROM checked
  UNION ALL SELECT p_partkey, CASE WHEN p_partkey % 9 > 0 THEN 'x' END, 0, CASE WHEN p_partkey % 9 > 0 THEN 'no_data' ELSE 'skip' END FROM part)"""


def _stored_fresh(spark, d):
    o = G.offers(spark, d).withColumn("tier", F.col("raw_tier"))
    stored = o.groupBy("entity_id", "seller_id", "tier").agg(F.max_by("price", "ord").alias("price"))
    fresh = stored.filter((F.col("entity_id") % 7 > 0) & (F.col("tier") != "quart")).withColumn(
        "price", F.col("price") * (1 + (F.col("entity_id") % 5) / 100.0))
    return stored, fresh


def checks(spark, d):
    return Q.price_compare(*_stored_fresh(spark, d))


def full_checks(spark, d):
    key = F.col("p_partkey")
    asked = G.table(spark, d, "part").select(key.alias("entity_id"), F.when(key % 9 > 0, "x").alias("seller_id"))
    return Q.price_compare(*_stored_fresh(spark, d), targets=asked)


@gate("price_compare_targets", f"WITH {TARGETS_SQL} SELECT entity_id, seller_id, stored_tiers, status FROM full_checked")
def price_compare_targets(spark, d):
    return full_checks(spark, d).select("entity_id", "seller_id", "stored_tiers", "status")


@gate("eligible_seller", f"""WITH {G.OFFERS_SQL}, usable AS (SELECT DISTINCT entity_id, seller_id FROM offers WHERE seller_id < '4'),
ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY entity_id ORDER BY MD5(entity_id || '|' || seller_id || '|7'), seller_id) AS r FROM usable)
SELECT p_partkey AS entity_id, seller_id FROM part LEFT JOIN ranked ON entity_id = p_partkey AND r = 1""")
def eligible_seller(spark, d):
    o = G.offers(spark, d)
    parts = G.table(spark, d, "part").select(F.col("p_partkey").alias("entity_id"))
    return Q.eligible_seller(o, o.filter("seller_id < '4'"), parts, 7)


@gate("price_compare", f"WITH {CHECK_SQL} SELECT entity_id, seller_id, stored_tiers, fresh_tiers, matches, mismatches, COALESCE(off_tiers, '') AS off_tiers, status FROM checked")
def price_compare(spark, d):
    return checks(spark, d).select(
        "entity_id", "seller_id", "stored_tiers", "fresh_tiers", "matches", "mismatches",
        F.array_join("details.tier", ",").alias("off_tiers"), "status")


@gate("stored_and_fresh", f"WITH {CHECK_SQL} SELECT entity_id, seller_id, tier, price, fresh_price FROM both_sides WHERE fresh_price IS NOT NULL")
def stored_and_fresh(spark, d):
    return J.stored_and_fresh(*_stored_fresh(spark, d))


@gate("verification_summary", f"""WITH {TARGETS_SQL} SELECT COUNT(*) AS checked, COUNT_IF(status = 'PASS') AS passed, COUNT_IF(status = 'MISMATCH') AS failed,
 COUNT_IF(status = 'error') AS errors, COUNT_IF(status IN ('no_data', 'skip')) AS skipped, COUNT_IF(status = 'MISMATCH') > 0 AS is_failure FROM full_checked""")
def verification_summary(spark, d):
    return Q.verification_summary(full_checks(spark, d))


@gate("halt_decision", f"""WITH {CHECK_SQL} SELECT ROUND(AVG(CASE WHEN status = 'MISMATCH' THEN 1.0 ELSE 0.0 END), 9) AS failed_share,
 AVG(CASE WHEN status = 'MISMATCH' THEN 1.0 ELSE 0.0 END) > 0.2 AS halt FROM checked""")
def halt_decision(spark, d):
    return Q.halt_decision(checks(spark, d)).withColumn("failed_share", F.round("failed_share", 9))


@gate("verification_sample", f"""WITH {G.OFFERS_SQL}, one AS (SELECT entity_id, ARG_MIN(seller_id, MD5(entity_id || '|' || seller_id || '|7') || seller_id) AS seller_id FROM offers GROUP BY 1)
SELECT entity_id, seller_id FROM one ORDER BY MD5(entity_id || '|7'), entity_id LIMIT 10""")
def verification_sample(spark, d):
    return Q.verification_sample(G.offers(spark, d), 10, 7)


@gate("sanity_flags", f"""WITH {G.OFFERS_SQL}, f AS (
  SELECT entity_id, seller_id, ord, pos, price / 100 AS price, CASE WHEN pos = 7 THEN 'variant-1' ELSE raw_tier END AS tier,
    CASE WHEN pos = 2 THEN price / 200 ELSE was_price / 100 END AS was, p_type IN ('ECONOMY', 'PROMO') AS large
  FROM offers JOIN part ON p_partkey = entity_id),
g AS (SELECT entity_id, seller_id, ord, pos, ARRAY_TO_STRING(LIST_FILTER([
  CASE WHEN NOT large AND price > 500 THEN 'price_over_500' END, CASE WHEN price > 1000 THEN 'price_over_1000' END,
  CASE WHEN price < 3 THEN 'price_under_3' END, CASE WHEN was <= price THEN 'was_not_above_price' END,
  CASE WHEN STARTS_WITH(tier, 'variant-') THEN 'unresolved_tier' END], lambda x: x IS NOT NULL), ',') AS flags FROM f)
SELECT * FROM g WHERE flags <> ''""")
def sanity_flags(spark, d):
    parts = G.table(spark, d, "part").select(F.col("p_partkey").alias("entity_id"), F.col("p_type").isin("ECONOMY", "PROMO").alias("large"))
    o = G.offers(spark, d).join(parts, "entity_id").select(
        "entity_id", "seller_id", "ord", "pos", (F.col("price") / 100).alias("price"), "large",
        F.when(F.col("pos") == 7, "variant-1").otherwise(F.col("raw_tier")).alias("tier"),
        F.when(F.col("pos") == 2, F.col("price") / 200).otherwise(F.col("was_price") / 100).alias("was_price"))
    return Q.sanity_flags(o, F.col("large")).select("entity_id", "seller_id", "ord", "pos", F.array_join("flags", ",").alias("flags"))
