"""Comparison-table queries."""
from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from gate import tables as G
from gate.base import Gate
from offerlens.operators import compare as A
from offerlens.operators import history as W

DAYS = 365


def _misses(spark, d):
    return W.availability(W.consecutive_misses(G.offers(spark, d)))


def _listings(spark, d, days=DAYS):
    return A.current_listings(
        G.stocked_offers(spark, d), G.sellers(spark, d), G.AS_OF, days, _misses(spark, d)
    )


def _current(spark, d, days=DAYS):
    return A.priced(_listings(spark, d, days))


CUR = G.current_sql(DAYS)
gate = Gate()
QUERIES, SQL = gate.queries, gate.sql


@gate("latest_per_key", """
SELECT user_id, CAST(event_id AS BIGINT) AS event_id, event_type, value FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn
  FROM events) WHERE rn = 1""")
def latest_per_key(spark, d):
    e = G.table(spark, d, "events")
    return A.latest_per_key(e, ["user_id", "event_type"], ["ts", "event_id"]).select(
        "user_id", "event_id", "event_type", "value"
    )


OFFER_COLS = ["entity_id", "seller_id", "tier", "raw_tier", "price", "was_price", "first_price",
              "in_stock", "unavailable", "variant_id"]
OFFER_SQL = ", ".join(OFFER_COLS)


@gate("current_offers", f"WITH {CUR} SELECT {OFFER_SQL} FROM cur")
def current_offers(spark, d):
    return _current(spark, d).select(*OFFER_COLS)


@gate("current_offers_30_days", f"WITH {G.current_sql(30)} SELECT {OFFER_SQL} FROM cur")
def current_offers_30_days(spark, d):
    return _current(spark, d, 30).select(*OFFER_COLS)


BEST_SQL = """
best AS (
  SELECT entity_id, tier, seller_id, price FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY entity_id, tier ORDER BY price, ord DESC, seller_id) AS rn
    FROM cur WHERE in_stock IS DISTINCT FROM FALSE AND NOT unavailable AND tier <> 'default')
  WHERE rn = 1)"""


@gate("best_per_tier", f"WITH {CUR},{BEST_SQL} SELECT * FROM best")
def best_per_tier(spark, d):
    return A.best_per_tier(_current(spark, d)).select("entity_id", "tier", "seller_id", "price")


@gate("mark_best", f"""WITH {CUR},{BEST_SQL}
SELECT entity_id, seller_id, tier, price, is_best,
       BOOL_OR(is_best) OVER (PARTITION BY entity_id, seller_id) AS has_best_price
FROM (SELECT c.*, b.seller_id IS NOT NULL AS is_best
      FROM cur c LEFT JOIN best b USING (entity_id, seller_id, tier))""")
def mark_best(spark, d):
    return A.mark_best(_current(spark, d)).select(
        "entity_id", "seller_id", "tier", "price", "is_best", "has_best_price"
    )


@gate("price_summary", f"""WITH {CUR}
SELECT entity_id, MIN(price) AS lowest_price, MAX(first_price) AS highest_price,
       COUNT(DISTINCT seller_id) AS offer_count,
       BOOL_OR(in_stock IS DISTINCT FROM FALSE) AS any_in_stock,
       BOOL_OR(NOT has_affiliate) AS has_non_affiliate,
       CAST(CASE WHEN MAX(first_price) > MIN(price)
            THEN ROUND_EVEN((1 - MIN(price) / MAX(first_price)) * 100, 0) ELSE 0 END AS INT) AS savings_pct
FROM cur GROUP BY entity_id""")
def price_summary(spark, d):
    return A.price_summary(_listings(spark, d))


SPREAD_SQL = """
open_offers AS (SELECT entity_id, tier, tier_pos, price FROM cur WHERE in_stock IS DISTINCT FROM FALSE),
tops AS (
  SELECT *, COUNT(*) OVER (PARTITION BY entity_id, tier) AS n,
         ROW_NUMBER() OVER (PARTITION BY entity_id, tier ORDER BY price DESC) AS rn,
         LEAD(price) OVER (PARTITION BY entity_id, tier ORDER BY price DESC) AS next_price
  FROM open_offers),
trimmed AS (
  SELECT * FROM tops WHERE n >= 2 AND NOT (n >= 3 AND rn = 1 AND price / next_price >= 3.0)),
spread AS (
  SELECT entity_id, tier, tier_pos, COUNT(*) AS seller_count, MIN(price) AS low, MAX(price) AS high,
         CAST(CASE WHEN MAX(price) > MIN(price)
              THEN ROUND_EVEN((1 - MIN(price) / MAX(price)) * 100, 0) ELSE 0 END AS INT) AS pct
  FROM trimmed GROUP BY 1, 2, 3),
picked AS (
  SELECT *, CASE tier WHEN 'quart' THEN 'Quart' WHEN '1gal' THEN '1 Gallon' WHEN '2gal' THEN '2 Gallon'
       WHEN '3gal' THEN '3 Gallon' ELSE 'Best Available' END AS tier_label
  FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY entity_id ORDER BY seller_count DESC, pct DESC, tier_pos) AS rn
        FROM spread) WHERE rn = 1)"""


@gate("same_tier_spread", f"""WITH {CUR},{SPREAD_SQL}
SELECT entity_id, tier, tier_label, seller_count, low, high, pct FROM picked""")
def same_tier_spread(spark, d):
    return A.same_tier_spread(_current(spark, d)).select(
        "entity_id", "tier", "tier_label", "seller_count", "low", "high", "pct"
    )


@gate("drop_top_outlier", f"""WITH {CUR}, ranked AS (
  SELECT *, COUNT(*) OVER (PARTITION BY entity_id, tier) AS n,
         ROW_NUMBER() OVER (PARTITION BY entity_id, tier ORDER BY price DESC) AS rn,
         LEAD(price) OVER (PARTITION BY entity_id, tier ORDER BY price DESC) AS next_price FROM cur)
SELECT entity_id, seller_id, tier, price FROM ranked
WHERE NOT COALESCE(n >= 3 AND rn = 1 AND price / next_price >= 3.0, FALSE)""")
def drop_top_outlier(spark, d):
    from offerlens.operators.quality import drop_top_outlier as op

    return op(_current(spark, d), ["entity_id", "tier"]).select(
        "entity_id", "seller_id", "tier", "price"
    )


@gate("seller_order", f"""WITH {CUR}, per_seller AS (
  SELECT DISTINCT entity_id, seller_id, seller_class, shown_price, ord FROM classed)
SELECT entity_id, seller_id, seller_class, shown_price,
       CAST(ROW_NUMBER() OVER (PARTITION BY entity_id
            ORDER BY seller_class, shown_price NULLS LAST, ord DESC, seller_id) AS INT) AS seller_rank
FROM per_seller""")
def seller_order(spark, d):
    return A.seller_order(_listings(spark, d))


DEAL_SQL = """
deals AS (
  SELECT *, base || '?variant=' || variant_id AS deal_url, COALESCE(was_price <> 0, FALSE) AS sale_flag
  FROM classed WHERE in_stock IS DISTINCT FROM FALSE AND tier <> 'default')"""


@gate("tier_deals", f"""WITH {CUR},{DEAL_SQL}
SELECT entity_id, tier, seller_id, price, deal_url, sale_flag,
       CASE tier WHEN 'quart' THEN 'Quart' WHEN '1gal' THEN '1 Gallon' WHEN '2gal' THEN '2 Gallon'
       ELSE '3 Gallon' END AS label
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY entity_id, tier
        ORDER BY price, seller_class, shown_price NULLS LAST, ord DESC, seller_id) AS rn FROM deals)
WHERE rn = 1""")
def tier_deals(spark, d):
    return A.tier_deals(_listings(spark, d)).select(
        "entity_id", "tier", "seller_id", "price", "deal_url", "sale_flag", "label"
    )


@gate("best_deal_and_runner_ups", f"""WITH {CUR},{DEAL_SQL}
SELECT entity_id, CAST(rn AS INT) AS deal_rank, seller_id, tier, price, deal_url
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY entity_id
        ORDER BY price, tier_pos, seller_class, shown_price NULLS LAST, ord DESC, seller_id) AS rn FROM deals)
WHERE rn <= 3""")
def best_deal_and_runner_ups(spark, d):
    return A.best_deals(_listings(spark, d)).select(
        "entity_id", "deal_rank", "seller_id", "tier", "price", "deal_url"
    )


@gate("default_variant", f"""WITH {CUR}
SELECT entity_id, seller_id, variant_id AS default_variant_id
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY entity_id, seller_id ORDER BY price, first_pos) AS rn FROM cur)
WHERE rn = 1""")
def default_variant(spark, d):
    return A.default_variant(_current(spark, d))


@gate("comparison_matrix", f"""WITH {CUR}
SELECT entity_id, seller_id,
       MIN(price) FILTER (tier = 'quart') AS "quart", MIN(price) FILTER (tier = '1gal') AS "1gal",
       MIN(price) FILTER (tier = '2gal') AS "2gal", MIN(price) FILTER (tier = '3gal') AS "3gal"
FROM cur GROUP BY 1, 2""")
def comparison_matrix(spark, d):
    return A.comparison_matrix(_current(spark, d), ["quart", "1gal", "2gal", "3gal"])


def _catalog(spark, d):
    return G.table(spark, d, "part").select(
        F.col("p_partkey").alias("entity_id"),
        F.col("p_partkey").alias("entity_ord"),
        F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("name"),
        F.col("p_type").alias("category"),
        F.sequence(F.col("p_size") % 9 + 1, F.col("p_size") % 9 + 4).alias("zones"),
    )


SUMMARY_SQL = """
summary AS (
  SELECT entity_id, MIN(price) AS lowest_price, MAX(first_price) AS highest_price,
         CAST(CASE WHEN MAX(first_price) > MIN(price)
            THEN ROUND_EVEN((1 - MIN(price) / MAX(first_price)) * 100, 0) ELSE 0 END AS INT) AS savings_pct
  FROM cur GROUP BY 1)"""


@gate("category_summary", f"""WITH {CUR},{SUMMARY_SQL}
SELECT p_type AS category, COUNT(*) AS entity_count, MIN(lowest_price) AS range_low, MAX(highest_price) AS range_high
FROM part LEFT JOIN summary ON p_partkey = entity_id GROUP BY 1""")
def category_summary(spark, d):
    return A.category_summary(_catalog(spark, d), A.price_summary(_listings(spark, d)))


@gate("hero_offer", f"""WITH {CUR},{SPREAD_SQL}
SELECT entity_id, tier, low, high, pct FROM picked JOIN part ON p_partkey = entity_id
WHERE high > low AND pct > 0 ORDER BY pct DESC, entity_id LIMIT 1""")
def hero_offer(spark, d):
    return A.hero_offer(A.same_tier_spread(_current(spark, d)), _catalog(spark, d)).select(
        "entity_id", "tier", "low", "high", "pct"
    )


PRE_SQL = f"""{G.STOCKED_SQL},
newest AS (SELECT entity_id, seller_id, MAX(ord) AS ord FROM stocked GROUP BY 1, 2),
pre AS (SELECT entity_id, MIN(price) AS lowest_price
        FROM stocked JOIN newest USING (entity_id, seller_id, ord) WHERE price > 0 GROUP BY 1)"""


@gate("pre_lowest", f"WITH {PRE_SQL} SELECT * FROM pre")
def pre_lowest(spark, d):
    return A.pre_lowest(G.offers(spark, d))


@gate("similar_entities", f"""WITH {PRE_SQL}, cat AS (
  SELECT p_partkey AS entity_id, p_type AS category, p_size % 9 AS z, lowest_price
  FROM part LEFT JOIN pre ON p_partkey = entity_id),
pairs AS (
  SELECT a.entity_id, b.entity_id AS similar_id, GREATEST(0, 4 - ABS(a.z - b.z)) AS zone_overlap,
         b.lowest_price AS similar_price,
         ROW_NUMBER() OVER (PARTITION BY a.entity_id ORDER BY GREATEST(0, 4 - ABS(a.z - b.z)) DESC,
                            b.lowest_price NULLS LAST, b.entity_id) AS similar_rank
  FROM cat a JOIN cat b ON a.category = b.category AND a.entity_id <> b.entity_id)
SELECT entity_id, CAST(similar_rank AS INT) AS similar_rank, similar_id, CAST(zone_overlap AS INT) AS zone_overlap, similar_price
FROM pairs WHERE similar_rank <= 5""")
def similar_entities(spark, d):
    entities = _catalog(spark, d).join(A.pre_lowest(G.offers(spark, d)), "entity_id", "left")
    return A.similar_entities(entities, 5)


def _browse(sort, spark, d):
    cards = _catalog(spark, d).join(A.price_summary(_listings(spark, d)), "entity_id", "left")
    return A.browse(cards, "ECONOMY", 5, sort).select(
        "entity_id", "name", "lowest_price", "savings_pct"
    )


for _name, _sort in [("browse_by_name", "name"), ("browse_by_price", "price-low"),
                     ("browse_by_price_desc", "price-high"), ("browse_by_savings", "savings")]:
    QUERIES[_name] = partial(_browse, _sort)
    SQL[_name] = f"""WITH {CUR},{SUMMARY_SQL}
SELECT p_partkey AS entity_id, p_name || ' ' || p_partkey AS name, lowest_price, savings_pct
FROM part LEFT JOIN summary ON p_partkey = entity_id
WHERE p_type = 'ECONOMY' AND 5 BETWEEN p_size % 9 + 1 AND p_size % 9 + 4"""
