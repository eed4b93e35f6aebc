"""The driver's tables seen as price-comparison data, in Spark and in SQL.

``lineitem`` rows are offers: part = entity, supplier (modulo 10) = seller, ship date = time,
line number = size. Several rows of one (entity, seller, day, size) are one offer: the cheapest.
"""
from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = date(2001, 11, 5)
# Raw size of line numbers 1..7. Lines 1 and 3 mean the same tier, and so do 6 and 7.
RAW_TIERS = ["1-gallon", "quart", "#1-container", "2gal", "3-gallon-pot", "default", "12345678"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")
    sizes = F.array(*[F.lit(t) for t in RAW_TIERS])
    rows = (
        l.groupBy(
            F.col("l_partkey").alias("entity_id"),
            (F.col("l_suppkey") % 10).cast("string").alias("seller_id"),
            F.col("l_shipdate").alias("obs_ts"),
            F.col("l_linenumber").alias("pos"),
        )
        .agg(
            F.min("l_extendedprice").alias("price"),
            F.max(
                F.when(
                    F.col("l_discount") > 0, F.col("l_extendedprice") * (1 + F.col("l_discount"))
                )
            ).alias("was_price"),
            F.bool_or(F.col("l_linestatus") == "O").alias("_open"),
            F.bool_or(F.col("l_returnflag") == "N").alias("_unknown"),
            F.min("l_orderkey").cast("string").alias("variant_id"),
        )
    )
    days = F.datediff(F.to_date("obs_ts"), F.lit("1990-01-01").cast("date"))
    stock = F.when(F.col("_open"), F.lit(True)).when(F.col("_unknown"), F.lit(None)).otherwise(False)
    return rows.select(
        "entity_id",
        "seller_id",
        "obs_ts",
        F.to_date("obs_ts").alias("obs_date"),
        (days * 10 + F.col("seller_id").cast("int")).alias("ord"),
        F.get(sizes, F.col("pos") - 1).alias("raw_tier"),
        "pos",
        "price",
        F.when(F.col("was_price") > F.col("price"), F.col("was_price")).alias("was_price"),
        stock.alias("available"),
        "variant_id",
    )


def stocked_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers with the stock state and url of their observation. Of five days in a row a seller
    says no on one, nothing on one, and yes on the others."""
    seller = F.col("seller_id").cast("int")
    turn = (F.floor(F.col("ord") / 10) + seller) % 5
    state = F.when(turn == 0, F.lit(False)).when(turn > 1, F.lit(True))
    url = F.concat(F.lit("https://shop"), "seller_id", F.lit("/products/p"), "entity_id", F.lit("?variant=1"))
    return offers(spark, sf_dir).withColumn("in_stock", state).withColumn("url", url)


def sellers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per seller (supplier key modulo 10), named after its first supplier. Seller 7 is
    inactive, 3 has no partner program, 5 is kept for trust."""
    s = table(spark, sf_dir, "supplier")
    s = s.groupBy((F.col("s_suppkey") % 10).alias("k")).agg(F.min("s_name").alias("s_name"))
    key = F.col("k")
    return s.select(
        key.cast("string").alias("seller_id"),
        F.col("s_name").alias("seller_name"),
        F.when(key == 7, F.lit(False)).when(key < 5, F.lit(True)).alias("active"),
        (~key.isin(3, 5)).alias("has_affiliate"),
    )


# SQL for the same tables. Used as the head of a WITH list.
SIZE_LIST = ", ".join(f"'{t}'" for t in RAW_TIERS)
OFFERS_SQL = f"""
raw_rows AS (
  SELECT l_partkey AS entity_id, CAST(l_suppkey % 10 AS VARCHAR) AS seller_id, l_shipdate AS obs_ts,
         l_linenumber AS pos, MIN(l_extendedprice) AS price,
         MAX(CASE WHEN l_discount > 0 THEN l_extendedprice * (1 + l_discount) END) AS was0,
         BOOL_OR(l_linestatus = 'O') AS is_open, BOOL_OR(l_returnflag = 'N') AS is_unknown,
         CAST(MIN(l_orderkey) AS VARCHAR) AS variant_id
  FROM lineitem GROUP BY 1, 2, 3, 4),
offers AS (
  SELECT entity_id, seller_id, obs_ts, CAST(obs_ts AS DATE) AS obs_date,
         date_diff('day', DATE '1990-01-01', CAST(obs_ts AS DATE)) * 10 + CAST(seller_id AS INT) AS ord,
         ([{SIZE_LIST}])[pos] AS raw_tier, pos, price,
         CASE WHEN was0 > price THEN was0 END AS was_price,
         CASE WHEN is_open THEN TRUE WHEN is_unknown THEN NULL ELSE FALSE END AS available, variant_id
  FROM raw_rows)"""
STOCKED_SQL = OFFERS_SQL + """,
stocked AS (
  SELECT *, CASE (ord // 10 + CAST(seller_id AS INT)) % 5 WHEN 0 THEN FALSE WHEN 1 THEN NULL ELSE TRUE END AS in_stock,
         'https://shop' || seller_id || '/products/p' || entity_id AS base
  FROM offers)"""
SELLERS_SQL = """
sellers AS (
  SELECT CAST(k AS VARCHAR) AS seller_id, seller_name,
         CASE WHEN k = 7 THEN FALSE WHEN k < 5 THEN TRUE END AS active,
         k NOT IN (3, 5) AS has_affiliate
  FROM (SELECT s_suppkey % 10 AS k, MIN(s_name) AS seller_name FROM supplier GROUP BY 1))"""
RUNS_SQL = """
gaps AS (
  SELECT *, CASE WHEN obs_ts - LAG(obs_ts) OVER w <= INTERVAL 12 HOUR THEN 0 ELSE 1 END AS starts
  FROM OBS WINDOW w AS (PARTITION BY entity_id ORDER BY obs_ts)),
runs AS (SELECT *, SUM(starts) OVER (PARTITION BY entity_id ORDER BY obs_ts) AS run FROM gaps),
misses AS (
  SELECT entity_id, seller_id,
         CAST(ANY_VALUE(newest) - MAX(run) AS INT) AS misses
  FROM (SELECT *, MAX(run) OVER (PARTITION BY entity_id) AS newest FROM runs) GROUP BY 1, 2)"""


def current_sql(stale_days: int, with_misses: bool = True) -> str:
    """offers -> latest -> folded current listings, the way the comparison table defines them."""
    missed = "COALESCE(m.misses >= 3, FALSE)" if with_misses else "FALSE"
    join = "LEFT JOIN misses m USING (entity_id, seller_id)" if with_misses else ""
    runs = "," + RUNS_SQL.replace("OBS", "offers") if with_misses else ""
    return f"""{STOCKED_SQL},{SELLERS_SQL}{runs},
newest AS (SELECT entity_id, seller_id, MAX(ord) AS ord FROM stocked GROUP BY 1, 2),
latest AS (SELECT s.* FROM stocked s JOIN newest USING (entity_id, seller_id, ord)),
kept AS (
  SELECT l.*, s.seller_name, s.has_affiliate, {missed} AS unavailable
  FROM latest l JOIN sellers s USING (seller_id) {join}
  WHERE COALESCE(s.active, TRUE)
    AND date_diff('day', l.obs_date, DATE '{AS_OF}') <= {stale_days}),
named AS (
  SELECT *, CASE raw_tier WHEN '1-gallon' THEN '1gal' WHEN '#1-container' THEN '1gal'
    WHEN '3-gallon-pot' THEN '3gal' WHEN '12345678' THEN 'default' ELSE raw_tier END AS tier,
    ROW_NUMBER() OVER (PARTITION BY entity_id, seller_id,
      CASE raw_tier WHEN '1-gallon' THEN '1gal' WHEN '#1-container' THEN '1gal'
      WHEN '3-gallon-pot' THEN '3gal' WHEN '12345678' THEN 'default' ELSE raw_tier END
      ORDER BY price, pos) AS cheap_rank
  FROM kept WHERE price > 0),
firsts AS (
  SELECT entity_id, seller_id, tier, ARG_MIN(price, pos) AS first_price, MIN(pos) AS first_pos
  FROM named GROUP BY 1, 2, 3),
cur AS (
  SELECT n.*, f.first_price, f.first_pos,
         CASE tier WHEN 'quart' THEN 1 WHEN '1gal' THEN 2 WHEN '2gal' THEN 3 WHEN '3gal' THEN 4 ELSE 38 END AS tier_pos,
         MIN(CASE WHEN tier <> 'default' THEN price END) OVER (PARTITION BY entity_id, seller_id) AS low_shown
  FROM named n JOIN firsts f USING (entity_id, seller_id, tier) WHERE cheap_rank = 1),
classed AS (
  SELECT *, CASE WHEN unavailable THEN 3 WHEN in_stock IS NOT DISTINCT FROM FALSE THEN 2
                 WHEN low_shown IS NULL THEN 1 ELSE 0 END AS seller_class,
         CASE WHEN NOT unavailable AND in_stock IS DISTINCT FROM FALSE THEN low_shown END AS shown_price
  FROM cur)"""
