"""Scalar functions over columns built from the part and supplier tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from gate import tables as G
from gate.base import Gate
from offerlens.functions import calendar as C
from offerlens.functions import pricing as P
from offerlens.functions import tiers as T
from offerlens.functions import urls as U
from offerlens.operators import catalog as K

gate = Gate()
QUERIES, SQL = gate.queries, gate.sql


def part_key():
    return F.col("p_partkey")


def size_text():
    return F.col("p_size").cast("string")


def part(spark, d):
    return G.table(spark, d, "part")


def pick(*options):
    """One of several columns, by part key."""
    return F.get(F.array(*options), (part_key() % len(options)).cast("int"))


def ints(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


@gate("canonical_tier", """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '1gal' WHEN 1 THEN '3gal' WHEN 2 THEN 'bareroot'
 WHEN 3 THEN 'default' WHEN 4 THEN LOWER(p_type) ELSE 'quart' END AS tier,
 CASE p_partkey % 6 WHEN 0 THEN '1 Gallon' WHEN 1 THEN '3 Gallon' WHEN 2 THEN 'Bare Root'
 WHEN 3 THEN 'Best Available' WHEN 4 THEN UPPER(p_type[1]) || LOWER(p_type[2:]) ELSE 'Quart' END AS label FROM part""")
def canonical_tier(spark, d):
    raw = pick(F.lit(" #1-Container"), F.lit("3-gallons"), F.lit("dormant"), F.concat(F.lit("variant-7654321"), size_text()),
               F.col("p_type"), F.lit("QT "))
    return part(spark, d).select("p_partkey", T.canonical_tier(raw).alias("tier"), T.tier_label(raw).alias("label"))


@gate("tier_rank", """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 9 WHEN 2 THEN 38 WHEN 3 THEN 43 ELSE 44 END AS pos,
 CASE p_partkey % 5 WHEN 0 THEN TRUE WHEN 1 THEN TRUE WHEN 2 THEN FALSE ELSE TRUE END AS is_visible FROM part""")
def tier_rank(spark, d):
    tier = pick(F.lit("quart"), F.lit("bareroot"), F.lit("default"), F.lit("48-54in"), F.col("p_name"))
    return part(spark, d).select(
        "p_partkey", T.tier_rank(tier).pos.alias("pos"), T.is_visible_tier(tier).alias("is_visible")
    )


@gate("rootstock_tier", """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'semi-dwarf-potted' WHEN 1 THEN 'ultra-supreme-bareroot'
 WHEN 2 THEN 'supreme-ez-start' WHEN 3 THEN 'dwarf' WHEN 4 THEN 'default' ELSE 'potted' END AS tier FROM part""")
def rootstock_tier(spark, d):
    name = F.col("p_name")
    desc = pick(F.concat(name, F.lit(" Semi Dwarf 7 Gal")), F.concat(name, F.lit(" Ultra Supreme Bare-Root")),
                F.concat(name, F.lit(" Supreme EZ Start")), F.concat(name, F.lit(" Dwarf")), name,
                F.concat(name, F.lit(" potted standard")))
    return part(spark, d).select("p_partkey", T.rootstock_tier(desc).alias("tier"))


@gate("effective_was_price", """SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice,
  CASE WHEN l_discount > 0.02 THEN l_extendedprice * (0.98 + l_discount) END AS was_price, l_discount > 0.02 AS on_sale
FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_discount FROM lineitem)""")
def effective_was_price(spark, d):
    l = G.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_discount").distinct()
    price = F.col("l_extendedprice")
    text = F.when(F.col("l_discount") > 0.02, (price * (0.98 + F.col("l_discount"))).cast("string")).when(
        F.col("l_discount") > 0.01, price.cast("string")).otherwise("n/a")
    was = P.effective_was_price(price, text)
    return l.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", was.alias("was_price")).withColumn(
        "on_sale", P.sale_flag(F.col("was_price")))


@gate("ships_season", """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Spring' WHEN 1 THEN 'Fall' WHEN 2 THEN NULL ELSE 'Winter' END AS season FROM part""")
def ships_season(spark, d):
    name = F.col("p_name")
    raw = pick(F.concat(name, F.lit(" | Ships in Spring")), F.concat(F.lit("SHIP  IN FALL "), name), name, F.lit("ships in winter"))
    return part(spark, d).select("p_partkey", T.ships_season(raw).alias("season"))


@gate("month_range", """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '11,12,1' WHEN 1 THEN '3,4,5' WHEN 2 THEN '9' WHEN 3 THEN '10,11,12,1,2' ELSE '' END AS months FROM part""")
def month_range(spark, d):
    text = pick(F.lit("Nov-Jan"), F.lit("March – may"), F.lit(" Sept "), F.lit("Oct-Feb"), F.col("p_name"))
    return part(spark, d).select("p_partkey", ints(C.month_range(text)).alias("months"))


@gate("zone_list", """SELECT p_partkey, z, CASE p_partkey % 4
  WHEN 0 THEN z || ',' || (z + 1) || ',' || (z + 2) WHEN 1 THEN z || ',' || (z + 4) WHEN 2 THEN CAST(z AS VARCHAR) END AS zones
FROM (SELECT p_partkey, p_size % 9 + 1 AS z FROM part)""")
def zone_list(spark, d):
    z = F.col("z")
    s = lambda c: c.cast("string")
    text = pick(F.concat(s(z), F.lit(" to "), s(z + 2)), F.concat(s(z + 4), F.lit(", "), s(z), F.lit(", x")), F.concat(F.lit(" "), s(z)),
                F.concat(s(z + 13), F.lit("-"), s(z)))
    return part(spark, d).select("p_partkey", (F.col("p_size") % 9 + 1).alias("z")).select(
        "p_partkey", "z", ints(C.zone_list(text)).alias("zones"))


@gate("mature_size", """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size || '-' || (p_size + 2) || ' ft tall x 3 ft wide'
 WHEN 1 THEN p_size || ' ft' WHEN 2 THEN p_size || '-9 ft wide' END AS size FROM part""")
def mature_size(spark, d):
    none = F.lit(None).cast("string")
    upto = F.concat(size_text(), F.lit(" to "), (F.col("p_size") + 2).cast("string"), F.lit(" feet tall"))
    height = pick(upto, F.concat(size_text(), F.lit("'")), F.lit(""), none)
    width = pick(F.lit("3 ft."), none, F.concat(size_text(), F.lit(" – 9 ft wide")), none)
    return part(spark, d).select("p_partkey", C.mature_size(height, width).alias("size"))


@gate("handle_from_url", """SELECT p_partkey, CASE p_partkey % 5 WHEN 3 THEN NULL WHEN 4 THEN NULL ELSE 'p' || p_partkey END AS handle FROM part""")
def handle_from_url(spark, d):
    k = part_key().cast("string")
    url = pick(F.concat(F.lit("https://x.com/products/p"), k, F.lit(".json")), F.concat(F.lit("/products/old/products/p"), k, F.lit("/?a=/products/b#c")),
               F.concat(F.lit("https://x.com/collections/y/products/p"), k, F.lit("#top")), F.concat(F.lit("https://x.com/p"), k), F.lit("/products/"))
    return part(spark, d).select("p_partkey", U.handle_from_url(url).alias("handle"))


@gate("product_urls", """SELECT p_partkey, 'https://x.com/p' || p_partkey AS base_url,
 CASE WHEN p_size % 2 = 0 THEN 'https://x.com/p' || p_partkey || '?variant=' || p_size ELSE 'https://x.com/p' || p_partkey END AS variant_url,
 CASE p_partkey % 3 WHEN 0 THEN 'https://x.com/products/' || p_type || '/p' || p_partkey WHEN 1 THEN 'https://x.com/products/p' || p_partkey END AS product_url FROM part""")
def product_urls(spark, d):
    k = F.concat(F.lit("p"), part_key().cast("string"))
    url = F.concat(F.lit("https://x.com/"), k, F.lit("?variant=1"))
    variant = F.when(F.col("p_size") % 2 == 0, size_text())
    handle = F.when(part_key() % 3 != 2, k)
    return part(spark, d).select(
        "p_partkey", U.base_url(url).alias("base_url"), U.variant_url(url, variant).alias("variant_url"),
        U.product_url(F.lit("https://x.com"), handle, F.when(part_key() % 3 == 0, F.col("p_type"))).alias("product_url"))


@gate("has_affiliate", """SELECT s_suppkey, s_suppkey % 3 > 0 AND NOT COALESCE(s_suppkey % 5 = 0, FALSE) AS has_affiliate FROM supplier""")
def has_affiliate(spark, d):
    s = G.table(spark, d, "supplier")
    key = F.col("s_suppkey")
    return s.select("s_suppkey", P.has_affiliate(
        F.when(key % 3 > 0, F.struct(F.col("s_name"))), F.when(key % 5 == 0, F.lit(True))).alias("has_affiliate"))


@gate("shipping_text", """SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'Check site' WHEN 1 THEN 'Free' WHEN 2 THEN 'Free over $99.0'
  WHEN 3 THEN '$12.50 flat' ELSE 'Varies' END AS shipping FROM supplier""")
def shipping_text(spark, d):
    k = F.col("s_suppkey") % 5
    return G.table(spark, d, "supplier").select("s_suppkey", P.shipping_text(
        k != 0, k == 1, F.when(k == 2, 99.0).otherwise(0.0), F.when(k == 3, 12.5)).alias("shipping"))


@gate("stock_text", """SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'Currently Unavailable' WHEN 1 THEN 'In Stock (Ships Fall)'
  WHEN 2 THEN 'In Stock' WHEN 3 THEN '—' ELSE 'Sold Out' END AS stock FROM supplier""")
def stock_text(spark, d):
    k = F.col("s_suppkey") % 5
    there = F.when(k.isin(0, 1, 2), F.lit(True)).when(k == 4, F.lit(False))
    return G.table(spark, d, "supplier").select("s_suppkey", P.stock_text(k == 0, there, F.when(k == 1, "Fall")).alias("stock"))


@gate("season_calendar", """WITH s AS (SELECT UNNEST([3,4,5,6,7,8,9,10,11]) AS zone,
  UNNEST(['May-Jun','Apr-May','Apr-May','Mar-May','Mar-Apr','Feb-Apr','Feb-Mar','Jan-Mar','Jan-Feb']) AS spring,
  UNNEST(['Sep','Sep-Oct','Sep-Oct','Sep-Nov','Oct-Nov','Oct-Dec','Nov-Dec','Nov-Dec','Nov-Dec']) AS fall)
SELECT p_partkey, CAST(zone AS VARCHAR) AS zone, spring, fall FROM part JOIN s ON zone BETWEEN p_size % 9 + 1 AND p_size % 9 + 4""")
def season_calendar(spark, d):
    zones = F.sequence(F.col("p_size") % 9 + 1, F.col("p_size") % 9 + 4)
    return part(spark, d).select("p_partkey", F.explode(C.season_calendar(zones)).alias("zone", "w")).select(
        "p_partkey", "zone", "w.spring", "w.fall")


def feedback(spark, d):
    """Conversations as a feedback board: first turns are items, an answer is a response."""
    c = G.table(spark, d, "conversations")
    first = c.groupBy("conv_id").agg(
        F.min_by("text", "turn").alias("body"), F.max("turn").alias("turns"),
        F.min_by("text", F.when(F.col("role") == "assistant", F.col("turn"))).alias("answer"))
    key = F.col("conv_id")
    day = F.concat(F.lit("2026-0"), (key % 9 + 1).cast("string"), F.lit("-1"), (key % 10).cast("string"))
    get = lambda *v: F.get(F.array(*[F.lit(x) for x in v]), (key % len(v)).cast("int"))
    response = F.struct(F.lit("team").alias("author"), F.col("answer").alias("body"), F.concat(day, F.lit("T10:00:00+02:00")).alias("responded_at"))
    return first.select(
        key.cast("string").alias("id"), get("bug", "price-data", "unheard", None).alias("category"), F.lit("t").alias("title"), "body",
        F.when(key % 7 == 0, "soon").otherwise(F.concat(day, F.lit("T23:30:00-05:00"))).alias("submitted_at"),
        get("planned", "done", None).alias("status"), F.col("turns").cast("int").alias("upvotes"),
        F.when((key % 2 == 0) & F.col("answer").isNotNull(), response).alias("response"))


FEEDBACK_SQL = """f AS (
  SELECT conv_id, MAX(turn) AS turns, MIN(turn) FILTER (role = 'assistant') AS answered,
    MAKE_DATE(2026, CAST(conv_id % 9 + 1 AS INT), CAST(10 + conv_id % 10 AS INT)) AS day FROM conversations GROUP BY 1),
items AS (
  SELECT CAST(conv_id AS VARCHAR) AS id, (['bug', 'price-data', 'unheard', 'other'])[conv_id % 4 + 1] AS category,
    (['Bug', 'Price Data', 'Other', 'Other'])[conv_id % 4 + 1] AS category_label,
    CASE WHEN conv_id % 7 = 0 THEN '' ELSE STRFTIME(day, '%B %d, %Y') END AS submitted_date,
    CASE WHEN conv_id % 7 = 0 THEN 'soon' ELSE STRFTIME(day, '%Y-%m-%d') || 'T23:30:00-05:00' END AS submitted_at,
    (['planned', 'done', 'reviewing'])[conv_id % 3 + 1] AS status,
    (['Planned', 'Done ✓', 'Under Review'])[conv_id % 3 + 1] AS status_label, CAST(turns AS INT) AS upvotes,
    conv_id % 2 = 0 AND answered IS NOT NULL AS has_response,
    CASE WHEN conv_id % 2 = 0 AND answered IS NOT NULL THEN STRFTIME(day, '%B %d, %Y') ELSE '' END AS response_date FROM f)"""
BOARD = ["id", "category", "category_label", "submitted_date", "status", "status_label", "upvotes", "response_date"]


@gate("feedback_enrich", f"WITH {FEEDBACK_SQL} SELECT {', '.join(BOARD)} FROM items")
def feedback_enrich(spark, d):
    return K.feedback_enrich(feedback(spark, d)).select(*BOARD)


@gate("feedback_board", f"WITH {FEEDBACK_SQL} SELECT id, status, upvotes FROM items WHERE status = 'done'")
def feedback_board(spark, d):
    return K.feedback_board(K.feedback_enrich(feedback(spark, d)), "done", "responded").select("id", "status", "upvotes")


@gate("feedback_counts", f"WITH {FEEDBACK_SQL} SELECT COUNT(*) AS submissions, COUNT_IF(has_response) AS responded, COUNT_IF(status = 'done') AS done FROM items")
def feedback_counts(spark, d):
    return K.feedback_counts(K.feedback_enrich(feedback(spark, d)))
