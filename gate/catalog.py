"""Catalog, seasonality, mapping and reconciliation queries; entries are parts."""
from __future__ import annotations

from pyspark.sql import functions as F

from gate import tables as G
from gate.base import Gate
from offerlens.functions import calendar as C
from offerlens.operators import catalog as K
from offerlens.operators import joins as J
from offerlens.operators import quality as Q
from offerlens.operators import reconcile as R
from offerlens.operators import seasonality as H
from offerlens.operators import state as S

gate = Gate()
QUERIES, SQL = gate.queries, gate.sql


def catalog(spark, d):
    """Parts as catalog entries. Every seventh has no price pattern, every eleventh a short one;
    every fifth no planting windows."""
    key, z = F.col("p_partkey"), F.col("p_size") % 9 + 1
    months = F.transform(F.sequence(F.lit(1), F.when(key % 11 == 0, 10).otherwise(12)), lambda m: ((key + m * m) % 7).cast("int"))
    text = lambda n: F.when(key % n != 0, F.concat(F.lit("t"), (key % 4).cast("string")))
    pattern = F.struct(
        months.alias("monthly_index"), text(2).alias("best_buy"), text(3).alias("worst_buy"), F.lit("n").alias("note"), text(4).alias("tip"))
    windows = F.transform_values(
        C.season_calendar(F.sequence(z, z + 3)),
        lambda k, w: F.struct(w.spring.alias("spring"), w.fall.alias("fall"), F.lit(None).cast("string").alias("summer")))
    return G.table(spark, d, "part").select(
        key.cast("string").alias("id"), key.alias("entity_id"), key.alias("entity_ord"), "p_name",
        F.col("p_name").alias("name"), F.col("p_type").alias("category"), F.sequence(z, z + 3).alias("zones"),
        F.when(key % 7 != 0, pattern).alias("price_seasonality"),
        F.when(key % 5 != 0, windows).alias("planting_seasons"))


SEASONAL_SQL = """cat AS (
  SELECT p_partkey AS k, p_type AS category, p_size % 9 + 1 AS z, p_partkey % 7 <> 0 AS has_price, p_partkey % 5 <> 0 AS has_windows,
    p_partkey % 11 = 0 AS is_short FROM part),
seasonal AS (SELECT * FROM cat WHERE has_price OR has_windows),
levels AS (
  SELECT category, m, CAST(LEAST(5, GREATEST(1, ROUND_EVEN(AVG((k + m * m) % 7), 0))) AS INT) AS level
  FROM seasonal, (SELECT UNNEST(RANGE(1, 13)) AS m) WHERE has_price AND NOT is_short GROUP BY 1, 2),
seasons AS (SELECT UNNEST([3,4,5,6,7,8,9]) AS zone,
  UNNEST([[5,6,9],[4,5,9,10],[4,5,9,10],[3,4,5,9,10,11],[3,4,10,11],[2,3,4,10,11,12],[2,3,11,12]]) AS months),
windows AS (
  SELECT DISTINCT category, zone, UNNEST(months) AS m FROM seasonal JOIN seasons ON zone BETWEEN z AND z + 3 WHERE has_windows),
grid AS (SELECT DISTINCT category, zone FROM seasonal, (SELECT UNNEST([3,4,5,6,7,8,9]) AS zone))"""


@gate("monthly_index", f"WITH {SEASONAL_SQL} SELECT category, STRING_AGG(level, ',' ORDER BY m) AS monthly_index FROM levels GROUP BY 1")
def monthly_index(spark, d):
    return H.monthly_index(catalog(spark, d)).withColumn("monthly_index", F.array_join(F.transform("monthly_index", lambda x: x.cast("string")), ","))


@gate("category_tips", f"""WITH {SEASONAL_SQL}, firsts AS (SELECT category, MIN(k) FILTER (has_price AND k % 2 <> 0) AS k FROM seasonal GROUP BY 1)
SELECT category, COALESCE('t' || k % 4, 'Fall') AS best_buy, CASE WHEN k % 3 <> 0 THEN 't' || k % 4 ELSE 'Spring' END AS worst_buy,
 CASE WHEN k % 4 <> 0 THEN 't' || k % 4 ELSE '' END AS tip FROM firsts""")
def category_tips(spark, d):
    return H.category_tips(catalog(spark, d))


@gate("planting_windows", f"""WITH {SEASONAL_SQL}
SELECT g.category, g.zone, COALESCE(STRING_AGG(m, ',' ORDER BY m), '') AS months FROM grid g LEFT JOIN windows w ON g.category = w.category AND g.zone = w.zone GROUP BY 1, 2""")
def planting_windows(spark, d):
    out = H.planting_windows(catalog(spark, d))
    months = F.filter(F.transform("plantable", lambda p, i: F.when(p, (i + 1).cast("string"))), lambda x: x.isNotNull())
    return out.select("category", "zone", F.array_join(months, ",").alias("months"))


@gate("best_opportunity", f"""WITH {SEASONAL_SQL}
SELECT l.category, l.m AS month, level, CASE WHEN level <= 2 THEN 'Low' WHEN level = 3 THEN 'Avg' ELSE 'High' END AS label,
 w.m IS NOT NULL AS plantable, level <= 2 AND w.m IS NOT NULL AS is_best
FROM levels l LEFT JOIN windows w ON w.category = l.category AND w.m = l.m AND w.zone = 7""")
def best_opportunity(spark, d):
    return H.best_opportunity(catalog(spark, d), 7)


@gate("coverage_per_seller", f"WITH {G.OFFERS_SQL} SELECT seller_id, COUNT(*) AS prices, COUNT(DISTINCT entity_id) AS entities FROM offers GROUP BY 1")
def coverage_per_seller(spark, d):
    return K.coverage_per_seller(G.offers(spark, d))


@gate("coverage_levels", f"""WITH {G.OFFERS_SQL}, n AS (SELECT entity_id, COUNT(DISTINCT seller_id) AS n FROM offers GROUP BY 1)
SELECT COUNT_IF(COALESCE(n, 0) >= 5) AS at_5_or_more, COUNT_IF(COALESCE(n, 0) >= 3) AS at_3_or_more, COUNT_IF(COALESCE(n, 0) >= 1) AS at_1_or_more,
 COUNT_IF(n IS NULL) AS at_none FROM part LEFT JOIN n ON p_partkey = entity_id""")
def coverage_levels(spark, d):
    return K.coverage_levels(catalog(spark, d).select("entity_id"), G.offers(spark, d))


def handle_map(spark, d, later=False):
    """(Supplier modulo 10, part) pairs: those with a returned item, or those with an open one."""
    l = G.table(spark, d, "lineitem").filter("l_linestatus = 'O'" if later else "l_returnflag <> 'N'")
    pairs = l.select((F.col("l_suppkey") % 10).cast("string").alias("seller_id"), F.col("l_partkey").alias("entity_id")).distinct()
    return pairs.withColumn("handle", F.concat(F.lit("new-" if later else "old-"), F.col("entity_id").cast("string")))


MAP_SQL = """pairs AS (SELECT DISTINCT CAST(l_suppkey % 10 AS VARCHAR) AS seller_id, l_partkey AS entity_id, l_returnflag, l_linestatus FROM lineitem),
old_map AS (SELECT DISTINCT seller_id, entity_id, 'old-' || entity_id AS handle FROM pairs WHERE l_returnflag <> 'N'),
new_map AS (SELECT DISTINCT seller_id, entity_id, 'new-' || entity_id AS handle FROM pairs WHERE l_linestatus = 'O')"""
PAIR = ["seller_id", "entity_id"]


@gate("insert_if_absent", f"WITH {MAP_SQL} SELECT * FROM old_map UNION ALL SELECT * FROM new_map WHERE (seller_id, entity_id) NOT IN (SELECT (seller_id, entity_id) FROM old_map)")
def insert_if_absent(spark, d):
    return K.insert_if_absent(handle_map(spark, d), handle_map(spark, d, True), PAIR)[0].select(*PAIR, "handle")


@gate("insert_if_absent_stats", f"""WITH {MAP_SQL} SELECT COUNT_IF(o.handle IS NULL) AS added, COUNT_IF(o.handle IS NOT NULL) AS skipped
FROM new_map n LEFT JOIN old_map o USING (seller_id, entity_id)""")
def insert_if_absent_stats(spark, d):
    return K.insert_if_absent(handle_map(spark, d), handle_map(spark, d, True), PAIR)[1]


@gate("upsert_mapping", f"WITH {MAP_SQL} SELECT seller_id, entity_id, COALESCE(n.handle, o.handle) AS handle FROM old_map o FULL JOIN new_map n USING (seller_id, entity_id)")
def upsert_mapping(spark, d):
    return K.upsert_mapping(handle_map(spark, d), handle_map(spark, d, True), PAIR)


@gate("replace_by_key", f"WITH {MAP_SQL} SELECT * FROM old_map WHERE CAST(seller_id AS INT) < 5 UNION ALL SELECT * FROM new_map WHERE CAST(seller_id AS INT) >= 5")
def replace_by_key(spark, d):
    new = handle_map(spark, d, True).filter(F.col("seller_id").cast("int") >= 5)
    return S.replace_by_key(handle_map(spark, d), new, ["seller_id"]).select(*PAIR, "handle")


@gate("unmapped_entities", f"WITH {MAP_SQL} SELECT seller_id, entity_id FROM new_map WHERE (seller_id, entity_id) NOT IN (SELECT (seller_id, entity_id) FROM old_map)")
def unmapped(spark, d):
    return J.unmapped(handle_map(spark, d, True).select(*PAIR), handle_map(spark, d), PAIR)


@gate("handles_for_seller", f"WITH {MAP_SQL} SELECT seller_id, entity_id, p_name, handle FROM old_map JOIN part ON p_partkey = entity_id")
def handles_for(spark, d):
    return J.handles_for(catalog(spark, d), handle_map(spark, d)).select("seller_id", "entity_id", "p_name", "handle")


@gate("with_sellers", f"WITH {G.OFFERS_SQL},{G.SELLERS_SQL} SELECT entity_id, seller_id, ord, pos, seller_name, has_affiliate FROM offers JOIN sellers USING (seller_id) WHERE COALESCE(active, TRUE)")
def with_sellers(spark, d):
    return J.with_sellers(G.offers(spark, d), G.sellers(spark, d)).select("entity_id", "seller_id", "ord", "pos", "seller_name", "has_affiliate")


def promos(spark, d):
    key = F.col("s_suppkey")
    none = F.array().cast("array<string>")
    return G.table(spark, d, "supplier").select(
        key.cast("string").alias("seller_id"),
        F.when(key % 3 == 0, F.array(F.concat(F.lit("SAVE"), key.cast("string")))).otherwise(none).alias("codes"),
        F.when(key % 4 == 0, F.array(F.col("s_name"))).when(key % 4 == 1, none).alias("banners"))


@gate("attach_promos", """SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, CAST(l_suppkey AS VARCHAR) AS seller_id,
  CASE WHEN l_suppkey % 3 = 0 THEN 'SAVE' || l_suppkey WHEN l_suppkey % 4 = 0 THEN '' END AS codes,
  CASE WHEN l_suppkey % 4 = 0 THEN s_name WHEN l_suppkey % 3 = 0 AND l_suppkey % 4 = 1 THEN '' END AS banners
FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_suppkey FROM lineitem) LEFT JOIN supplier ON s_suppkey = l_suppkey""")
def attach_promos(spark, d):
    l = G.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", F.col("l_suppkey").cast("string").alias("seller_id")).distinct()
    return J.attach_promos(l, promos(spark, d)).withColumn("codes", F.array_join("codes", ",")).withColumn("banners", F.array_join("banners", ","))


@gate("promo_count", "SELECT COUNT_IF(s_suppkey % 3 = 0 OR s_suppkey % 4 = 0) AS sellers_with_promos FROM supplier")
def promo_count(spark, d):
    return K.promo_count(promos(spark, d))


@gate("unprocessed_snapshots", """SELECT user_id AS entity_id, event_type AS seller_id, STRFTIME(ts, '%Y%m') AS yyyymm, event_id FROM events
WHERE (user_id, event_type, STRFTIME(ts, '%Y%m')) NOT IN (SELECT (user_id, event_type, STRFTIME(ts, '%Y%m')) FROM events WHERE ts < TIMESTAMP '2024-01-04')""")
def unprocessed(spark, d):
    snaps = G.table(spark, d, "events").select(
        F.col("user_id").alias("entity_id"), F.col("event_type").alias("seller_id"), F.date_format("ts", "yyyyMM").alias("yyyymm"), "event_id", "ts")
    return J.unprocessed(snaps, snaps.filter("ts < '2024-01-04'")).drop("ts")


@gate("stale_pages", "SELECT p_partkey AS entity_id, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_linestatus = 'O' AND l_returnflag = 'N')")
def stale_pages(spark, d):
    sold = G.table(spark, d, "lineitem").filter("l_linestatus = 'O' AND l_returnflag = 'N'").select(F.col("l_partkey").alias("entity_id"))
    return J.stale_pages(catalog(spark, d).select("entity_id", "p_name"), sold)


@gate("id_conflicts", "SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name FROM supplier WHERE s_suppkey IN (SELECT p_partkey FROM part WHERE p_size > 10)")
def id_conflicts(spark, d):
    batch = G.table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), "s_name")
    known = G.table(spark, d, "part").filter("p_size > 10").select(F.col("p_partkey").cast("string").alias("id"))
    return J.id_conflicts(known, batch)


@gate("insert_batch", "SELECT 'p' || p_partkey AS id, p_name AS name FROM part UNION ALL SELECT 's' || s_suppkey, s_name FROM supplier")
def insert_batch(spark, d):
    old = G.table(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.col("p_name").alias("name"))
    new = G.table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return K.insert_batch(old, new)


def guides(spark, d):
    """Nations as guides; the guide of nation 0 is the fallback. A guide's category is a part type."""
    n = G.table(spark, d, "nation")
    key = F.col("n_nationkey")
    slug = F.when(key == 0, "cheapest-places-to-buy-online").otherwise(F.lower("n_name"))
    types = ["ECONOMY", "STANDARD", "PROMO", "MEDIUM"]
    category = F.when(key > 20, F.get(F.array(*[F.lit(t) for t in types]), key - 21))
    return n.select(slug.alias("slug"), F.col("n_name").alias("title"), category.alias("category"))


GUIDES_SQL = """guides AS (
  SELECT CASE WHEN n_nationkey = 0 THEN 'cheapest-places-to-buy-online' ELSE LOWER(n_name) END AS slug, n_name AS title,
    CASE WHEN n_nationkey > 20 THEN (['ECONOMY', 'STANDARD', 'PROMO', 'MEDIUM'])[n_nationkey - 20] END AS category FROM nation)"""


@gate("guide_for_category", f"""WITH {GUIDES_SQL}, own AS (SELECT category, slug, title FROM guides WHERE category IS NOT NULL),
fb AS (SELECT slug, title FROM guides WHERE slug = 'cheapest-places-to-buy-online')
SELECT c.category, COALESCE(own.slug, fb.slug) AS guide_slug, COALESCE(own.title, fb.title) AS guide_title
FROM (SELECT DISTINCT p_type AS category FROM part) c LEFT JOIN own USING (category) CROSS JOIN fb""")
def guide_for_category(spark, d):
    g = guides(spark, d)
    return J.guide_for_category(catalog(spark, d), g.select("slug", "title"), g.select("slug", "category"))


@gate("related_entities", f"""WITH {GUIDES_SQL}, ranked AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY p_type ORDER BY p_partkey) AS rc, ROW_NUMBER() OVER (ORDER BY p_partkey) AS ra FROM part)
SELECT slug, p_partkey AS entity_id FROM guides JOIN ranked ON (category IS NULL AND ra <= 10) OR (category = p_type AND rc <= 10)""")
def related_entities(spark, d):
    return J.related_entities(guides(spark, d).select("slug", "category"), catalog(spark, d)).select("slug", "entity_id")


@gate("url_inventory", f"""WITH {GUIDES_SQL}
SELECT path, '2026-04-06' AS lastmod FROM (
  SELECT UNNEST(['/', '/my-list.html', '/heat-map.html', '/improve.html', '/guides/index.html', '/disclosure.html', '/privacy.html', '/about.html']) AS path
  UNION SELECT '/plants/' || p_partkey || '.html' FROM part UNION SELECT '/category/' || p_type || '.html' FROM part
  UNION SELECT '/guides/' || slug || '.html' FROM guides)""")
def url_inventory(spark, d):
    c = catalog(spark, d)
    return K.url_inventory(c.select("entity_id"), c.select("category"), guides(spark, d), F.lit("2026-04-06"))


VOTES_SQL = """cheapest AS (
  SELECT l_partkey AS entity_id, CAST(l_suppkey % 10 AS INT) AS src_pos,
    ARG_MIN(CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag ELSE LOWER(l_returnflag) || ' ' END, (l_extendedprice, l_orderkey, l_linenumber)) AS sun,
    CASE WHEN MIN(l_quantity) < 25 THEN '5,6' ELSE '6,7' END AS zones, CASE WHEN MAX(l_quantity) > 48 THEN 'Tree' END AS type
  FROM lineitem GROUP BY 1, 2),
votes2 AS (
  SELECT entity_id, 'sun' AS field, sun AS value, src_pos FROM cheapest UNION ALL SELECT entity_id, 'zones', zones, src_pos FROM cheapest
  UNION ALL SELECT entity_id, 'type', type, src_pos FROM cheapest WHERE type IS NOT NULL),
norms AS (SELECT *, CASE WHEN field = 'zones' THEN value ELSE TRIM(LOWER(value)) END AS norm FROM votes2 v),
spell AS (SELECT entity_id, field, norm, COUNT(*) AS n, MIN(src_pos) AS pos, ARG_MIN(value, src_pos) AS value FROM norms GROUP BY 1, 2, 3),
tops AS (SELECT entity_id, field, SUM(n) AS total, ARG_MIN(value, pos) AS first_value,
  FIRST(value ORDER BY n DESC, pos) AS top_value, MAX(n) AS top_n FROM spell GROUP BY 1, 2),
grid AS (SELECT p_partkey AS entity_id, UNNEST(['zones', 'sun', 'mature_size', 'bloom_time', 'type']) AS field FROM part),
decided AS (
  SELECT g.entity_id, g.field, COALESCE(total, 0) < 2 AS flagged, COALESCE(total >= 2 AND (top_n >= 3 OR top_n = total), FALSE) AS is_majority, top_value, first_value
  FROM grid g LEFT JOIN tops t ON g.entity_id = t.entity_id AND g.field = t.field),
reconciled AS (
  SELECT entity_id, field, CASE WHEN is_majority THEN top_value ELSE first_value END AS value,
    CASE WHEN flagged THEN 'fallback' WHEN is_majority THEN 'majority' ELSE 'tiebreak' END AS source, flagged FROM decided)"""


def votes(spark, d):
    """Every seller of a part votes: with the flag of its cheapest item, and with its quantities."""
    flag = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_returnflag")).otherwise(F.concat(F.lower("l_returnflag"), F.lit(" ")))
    ballots = G.table(spark, d, "lineitem").groupBy(
        F.col("l_partkey").alias("entity_id"), (F.col("l_suppkey") % 10).cast("int").alias("src_pos")).agg(
        F.min_by(flag, F.struct("l_extendedprice", "l_orderkey", "l_linenumber")).alias("sun"),
        F.when(F.min("l_quantity") < 25, "5,6").otherwise("6,7").alias("zones"),
        F.when(F.max("l_quantity") > 48, "Tree").alias("type"))
    return ballots.unpivot(["entity_id", "src_pos"], ["sun", "zones", "type"], "field", "value")


@gate("majority_value", f"WITH {VOTES_SQL} SELECT entity_id, field, total AS n_sources, first_value, CASE WHEN top_n >= 3 OR (top_n = total AND total >= 2) THEN top_value END AS majority FROM tops")
def majority_value(spark, d):
    return R.majority_value(votes(spark, d), ["entity_id", "field"], F.col("field") == "zones").drop("candidates")


@gate("reconcile", f"WITH {VOTES_SQL} SELECT * FROM reconciled")
def reconcile(spark, d):
    return R.reconcile(catalog(spark, d), votes(spark, d))


@gate("reconcile_resolver", f"""WITH {VOTES_SQL}, lasts AS (SELECT entity_id, field, ARG_MAX(value, pos) AS last_value FROM spell GROUP BY 1, 2)
SELECT r.entity_id, r.field, CASE WHEN source = 'majority' THEN r.value ELSE last_value END AS value, source, flagged
FROM reconciled r LEFT JOIN lasts l ON r.entity_id = l.entity_id AND r.field = l.field""")
def reconcile_resolver(spark, d):
    last = lambda field, values, name: F.try_element_at(values, F.lit(-1))
    return R.reconcile(catalog(spark, d), votes(spark, d), resolve=last)


@gate("draft_entries", f"""WITH {VOTES_SQL}
SELECT p_partkey AS entity_id, p_type AS category, MAX(value) FILTER (field = 'zones') AS zones, MAX(value) FILTER (field = 'sun') AS sun,
  CASE WHEN p_type = 'PROMO' THEN 6 ELSE 5 END AS n_tiers, FALSE AS active,
  STRING_AGG(CASE WHEN flagged THEN field END, ',' ORDER BY CASE field WHEN 'zones' THEN 1 WHEN 'sun' THEN 2 WHEN 'mature_size' THEN 3 WHEN 'bloom_time' THEN 4 ELSE 5 END) AS review_flags
FROM reconciled JOIN part ON p_partkey = entity_id GROUP BY p_partkey, p_type""")
def draft_entries(spark, d):
    c = catalog(spark, d).select("entity_id", "name", F.col("name").alias("botanical"),
                                 F.when(F.col("category") == "PROMO", "shade-trees").otherwise(F.col("category")).alias("category"))
    out = R.draft_entries(c, R.reconcile(c, votes(spark, d)))
    return out.select("entity_id", F.when(F.col("category") == "shade-trees", "PROMO").otherwise(F.col("category")).alias("category"), "zones", "sun",
                      F.size("size_tiers").alias("n_tiers"), "active", F.array_join("review_flags", ",").alias("review_flags"))


@gate("field_diff", """WITH c AS (SELECT p_partkey AS id, p_type, p_size, CASE WHEN p_size > 20 THEN p_brand END AS brand FROM part),
x AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN LOWER(p_type) ELSE p_type END AS p_type, p_size + CAST(p_partkey % 2 AS INT) AS p_size,
  CASE WHEN p_size > 25 THEN p_brand END AS brand FROM part),
u AS (SELECT id, 'p_type' AS field, c.p_type AS a, x.p_type AS b FROM c JOIN x USING (id)
  UNION ALL SELECT id, 'p_size', CAST(c.p_size AS VARCHAR), CAST(x.p_size AS VARCHAR) FROM c JOIN x USING (id)
  UNION ALL SELECT id, 'brand', c.brand, x.brand FROM c JOIN x USING (id))
SELECT id, field, a AS current_value, b AS extracted_value, CASE WHEN a IS NOT DISTINCT FROM b THEN 'MATCH' ELSE 'DIFF' END AS verdict FROM u""")
def field_diff(spark, d):
    p, key = G.table(spark, d, "part"), F.col("p_partkey")
    c = p.select(key.alias("id"), "p_type", "p_size", F.when(F.col("p_size") > 20, F.col("p_brand")).alias("brand"))
    x = p.select(key.alias("id"), F.when(key % 3 == 0, F.lower("p_type")).otherwise(F.col("p_type")).alias("p_type"),
                 (F.col("p_size") + (key % 2).cast("int")).alias("p_size"), F.when(F.col("p_size") > 25, F.col("p_brand")).alias("brand"))
    return J.field_diff(c, x, ["p_type", "p_size", "brand"])


@gate("catalog_checks", f"""WITH n AS (SELECT l_partkey AS k, COUNT(DISTINCT l_suppkey % 10) AS n FROM lineitem GROUP BY 1),
c AS (SELECT p_partkey AS k, p_name, CASE WHEN p_size % 9 = 0 THEN 'x_' ELSE 'a-' END || p_partkey AS id, p_type, p_size % 9 + 1 AS z FROM part)
SELECT id, UNNEST(LIST_FILTER([
  CASE WHEN k % 13 = 0 THEN 'missing_sun' END, CASE WHEN STARTS_WITH(id, 'x_') THEN 'id_not_kebab' END,
  CASE WHEN p_type = 'PROMO' THEN 'unknown_category' END, CASE WHEN k % 6 = 0 THEN 'zones_not_sorted' END,
  CASE WHEN z < 3 OR z + 3 > 11 OR k % 5 = 0 THEN 'season_missing_for_zone' END,
  CASE WHEN k % 7 = 0 OR k % 11 = 0 THEN 'index_not_12' END,
  CASE WHEN k % 7 <> 0 AND LEN(LIST_FILTER(RANGE(1, CASE WHEN k % 11 = 0 THEN 11 ELSE 13 END), lambda m: (k + m * m) % 7 NOT BETWEEN 1 AND 5)) > 0 THEN 'index_out_of_range' END,
  CASE WHEN COALESCE(n, 0) < 9 THEN 'mapped_at_few_sellers' END], lambda v: v IS NOT NULL)) AS violation
FROM c LEFT JOIN n USING (k)""")
def catalog_checks(spark, d):
    key = F.col("entity_id")
    cid = F.concat(F.when(F.array_contains("zones", 1), "x_").otherwise("a-"), key.cast("string"))
    c = catalog(spark, d).select(
        cid.alias("id"), F.col("name").alias("common_name"), F.col("name").alias("botanical_name"), "category",
        F.when(key % 13 != 0, F.lit("Full sun")).alias("sun"), F.lit("1 ft").alias("mature_size"), F.lit("t").alias("type"),
        F.when(key % 6 == 0, F.reverse("zones")).otherwise(F.col("zones")).alias("zones"), "price_seasonality", "planting_seasons", "entity_id")
    sold = G.table(spark, d, "lineitem").select(F.col("l_partkey").alias("entity_id"), (F.col("l_suppkey") % 10).alias("seller_id")).distinct()
    handles = sold.join(c.select("entity_id", "id"), "entity_id").select(F.col("id").alias("entity_id"), "seller_id")
    known = G.table(spark, d, "part").filter("p_type <> 'PROMO'").select(F.col("p_type").alias("category")).distinct()
    return Q.catalog_checks(c, handles, known, min_sellers=9)


@gate("keep_first_distinct", """WITH v AS (SELECT lang, doc_id, CASE WHEN doc_id % 2 = 0 THEN UPPER(source) ELSE source END AS v FROM documents)
SELECT lang, ARG_MIN(v, doc_id) AS v, MIN(doc_id) AS doc_id FROM v GROUP BY lang, LOWER(v)""")
def keep_first_distinct(spark, d):
    v = F.when(F.col("doc_id") % 2 == 0, F.upper("source")).otherwise(F.col("source"))
    return K.keep_first_distinct(G.table(spark, d, "documents").select("lang", "doc_id", v.alias("v")), ["lang"], "v", "doc_id")
