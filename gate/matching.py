"""Name-matching queries: part names as catalog entries, parts as store listings."""
from __future__ import annotations

from pyspark.sql import functions as F

from gate import tables as G
from gate.base import Gate
from offerlens.functions import names as N
from offerlens.functions.pricing import confidence_band
from offerlens.operators import matching as M

gate = Gate()
QUERIES, SQL = gate.queries, gate.sql


def entities(spark, d):
    """Distinct part names; the id is the name with dashes, the botanical name names a type."""
    p = G.table(spark, d, "part")
    return p.groupBy("p_name").agg(F.min("p_type").alias("p_type")).select(
        F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-tree")).alias("entity_id"),
        F.concat("p_name", F.lit(" Tree")).alias("name"),
        F.concat_ws(" ", F.lower("p_type"), F.split("p_name", " ")[1]).alias("botanical"),
    )


def products(spark, d):
    """Parts as listings. Every third title turns its words round, every fifth handle is a code."""
    p = G.table(spark, d, "part")
    words, key = F.split("p_name", " "), F.col("p_partkey")
    turned = F.concat_ws(" ", words[1], F.lit("of"), words[0], F.lit("(sale)"), F.lower("p_type"))
    plain = F.concat_ws(" ", F.initcap(words[0]), F.lower("p_type"), F.lower("p_brand"))
    return p.select(
        (F.col("p_partkey") % 10).cast("string").alias("seller_id"),
        key.alias("product_ord"),
        F.when(key % 3 == 0, turned).otherwise(plain).alias("title"),
        F.when(key % 5 == 0, F.concat(F.lit("sku-"), key.cast("string")))
        .otherwise(F.concat_ws("-", words[0], words[1], F.lower("p_type"))).alias("handle"),
    )


NAMES_SQL = """
ents AS (
  SELECT REPLACE(p_name, ' ', '-') || '-tree' AS entity_id, p_name || ' Tree' AS name,
         LOWER(MIN(p_type)) || ' ' || SPLIT_PART(p_name, ' ', 2) AS botanical
  FROM part GROUP BY p_name),
prods AS (
  SELECT CAST(p_partkey % 10 AS VARCHAR) AS seller_id, p_partkey AS product_ord,
         CASE WHEN p_partkey % 3 = 0
              THEN SPLIT_PART(p_name, ' ', 2) || ' of ' || SPLIT_PART(p_name, ' ', 1) || ' (sale) ' || LOWER(p_type)
              ELSE UPPER(SPLIT_PART(p_name, ' ', 1)[1]) || SPLIT_PART(p_name, ' ', 1)[2:] || ' ' || LOWER(p_type) || ' ' || LOWER(p_brand) END AS title,
         CASE WHEN p_partkey % 5 = 0 THEN 'sku-' || p_partkey
              ELSE SPLIT_PART(p_name, ' ', 1) || '-' || SPLIT_PART(p_name, ' ', 2) || '-' || LOWER(p_type) END AS handle
  FROM part)"""


def match_text_sql(c):
    out = f"LOWER(TRIM({c}))"
    for sub in ["proven winners", "proven winners®", "endless summer®", "knock out®", "encore®",
                "for sale", "buy", "online", "tree", "shrub", "bush", "plant", "bare root", "bareroot"]:
        out = f"REPLACE({out}, '{sub}', '')"
    out = rf"REGEXP_REPLACE(REGEXP_REPLACE({out}, '[®™©]', '', 'g'), '\([^)]*\)', '', 'g')"
    return rf"TRIM(REGEXP_REPLACE({out}, '\s+', ' ', 'g'))"


def slug_text_sql(c):
    out = f"REGEXP_REPLACE(LOWER(TRIM({c})), '[®™©'']', '', 'g')"
    return rf"TRIM(REGEXP_REPLACE(REGEXP_REPLACE(REPLACE({out}, '&', 'and'), '[^a-z0-9 ]', ' ', 'g'), '\s+', ' ', 'g'))"


NOISE = "['the','a','an','of','for','and','or','in','at','to','by']"
WIDE_NOISE = "['the','a','an','of','for','and','or','in','at','to','by','tree','shrub','bush','plant','buy','sale','online','live']"


def words_sql(c, noise=NOISE):
    return f"LIST_FILTER(LIST_DISTINCT(STRING_SPLIT({c}, ' ')), lambda w: w <> '' AND NOT LIST_CONTAINS({noise}, w))"


def score_sql(nw, tw, nt, tt):
    return f"""CASE WHEN {nt} = '' OR {tt} = '' THEN 0.0 WHEN {nt} = {tt} THEN 1.0
      WHEN LEN({nw}) = 0 THEN 0.0 ELSE CAST(LEN(LIST_INTERSECT({nw}, {tw})) AS DOUBLE) / LEN({nw}) END"""


@gate("match_text", f"SELECT p_partkey, {match_text_sql('t')} AS normal FROM (SELECT p_partkey, 'Buy ' || p_name || ' Tree® (' || p_type || ')  ' || p_brand AS t FROM part)")
def match_text(spark, d):
    t = F.concat(F.lit("Buy "), "p_name", F.lit(" Tree® ("), "p_type", F.lit(")  "), "p_brand")
    return G.table(spark, d, "part").select("p_partkey", N.match_text(t).alias("normal"))


@gate("slug_text", f"SELECT p_partkey, {slug_text_sql('t')} AS normal FROM (SELECT p_partkey, p_name || '’s & ' || p_brand || '™ ''x''' AS t FROM part)")
def slug_text(spark, d):
    t = F.concat("p_name", F.lit("’s & "), "p_brand", F.lit("™ 'x'"))
    return G.table(spark, d, "part").select("p_partkey", N.slug_text(t).alias("normal"))


PAIR_SQL = f"""{NAMES_SQL}, e AS (
  SELECT *, {match_text_sql('name')} AS nt, {match_text_sql('botanical')} AS bt,
         {match_text_sql("REPLACE(entity_id, '-', ' ')")} AS it FROM ents),
p AS (SELECT *, {match_text_sql('title')} AS tt, {match_text_sql("REPLACE(handle, '-', ' ')")} AS ht FROM prods),
ew AS (SELECT *, {words_sql('nt')} AS nw, {words_sql('bt')} AS bw, {words_sql('it')} AS iw FROM e),
pw AS (SELECT *, {words_sql('tt')} AS tw, {words_sql('ht')} AS hw FROM p),
pairs AS (
  SELECT entity_id, seller_id, product_ord, title, handle,
    {score_sql('nw', 'tw', 'nt', 'tt')} AS s1, 0.8::DOUBLE * {score_sql('bw', 'tw', 'bt', 'tt')} AS s2,
    0.9::DOUBLE * {score_sql('iw', 'hw', 'it', 'ht')} AS s3
  FROM ew CROSS JOIN pw)"""


@gate("match_score", f"""WITH x AS (SELECT p_partkey, p_name || ' Tree' AS n, SPLIT_PART(p_name, ' ', 1) || ' ' || p_type || ' the tree' AS t FROM part),
y AS (SELECT *, {match_text_sql('n')} AS nt, {match_text_sql('t')} AS tt FROM x),
z AS (SELECT *, {words_sql('nt')} AS nw, {words_sql('tt')} AS tw FROM y)
SELECT p_partkey, {score_sql('nw', 'tw', 'nt', 'tt')} AS score FROM z""")
def match_score(spark, d):
    t = F.concat(F.split("p_name", " ")[0], F.lit(" "), "p_type", F.lit(" the tree"))
    return G.table(spark, d, "part").select(
        "p_partkey", N.match_score(F.concat("p_name", F.lit(" Tree")), t).alias("score")
    )


BAND = "CASE WHEN score >= 0.8 THEN 'HIGH' WHEN score >= 0.6 THEN 'MED' ELSE 'LOW' END"


@gate("best_matches", f"""WITH {PAIR_SQL}, ranked AS (
  SELECT *, GREATEST(s1, s2, s3) AS raw,
    ROW_NUMBER() OVER (PARTITION BY entity_id ORDER BY GREATEST(s1, s2, s3) DESC, product_ord) AS rn FROM pairs)
SELECT *, {BAND} AS band FROM (
SELECT entity_id, handle, title, ROUND_EVEN(raw, 2) AS score FROM ranked WHERE rn = 1 AND raw >= 0.6)""")
def best_matches(spark, d):
    return M.best_matches(entities(spark, d), products(spark, d))


@gate("confidence_band", f"SELECT p_partkey, {BAND} AS band FROM (SELECT p_partkey, (p_size % 11) / 10.0::DOUBLE AS score FROM part)")
def confidence(spark, d):
    return G.table(spark, d, "part").select(
        "p_partkey", confidence_band((F.col("p_size") % 11) / 10.0).alias("band")
    )


def _per_seller(spark, d):
    e, p = entities(spark, d), products(spark, d)
    unmapped = e.withColumn("seller_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: i.cast("string"))))
    return M.best_matches(unmapped, p, group=["seller_id"])


SELLER_MATCH_SQL = f"""{PAIR_SQL}, ranked AS (
  SELECT *, GREATEST(s1, s2, s3) AS raw,
    ROW_NUMBER() OVER (PARTITION BY entity_id, seller_id ORDER BY GREATEST(s1, s2, s3) DESC, product_ord) AS rn FROM pairs),
per_seller AS (SELECT * FROM ranked WHERE rn = 1 AND raw >= 0.6)"""


@gate("best_matches_per_seller", f"""WITH {SELLER_MATCH_SQL}
SELECT seller_id, entity_id, handle, title, ROUND_EVEN(raw, 2) AS score FROM per_seller""")
def best_matches_per_seller(spark, d):
    return _per_seller(spark, d).drop("band")


@gate("coverage_cut", f"""WITH {SELLER_MATCH_SQL}
SELECT entity_id, COUNT(seller_id) AS seller_count, COALESCE(STRING_AGG(seller_id, ',' ORDER BY seller_id), '') AS sellers,
       CASE WHEN COUNT(seller_id) >= 2 THEN 'PASS' ELSE 'FAIL' END AS verdict
FROM ents LEFT JOIN per_seller USING (entity_id) GROUP BY 1""")
def coverage_cut(spark, d):
    out = M.coverage_cut(entities(spark, d), _per_seller(spark, d))
    return out.withColumn("sellers", F.array_join("sellers", ","))


def wscore(nw, tw):
    return f"CASE WHEN LEN({nw}) = 0 THEN 0.0 ELSE CAST(LEN(LIST_INTERSECT({nw}, {tw})) AS DOUBLE) / LEN({nw}) END"


@gate("best_matches_wide", f"""WITH {NAMES_SQL}, e AS (
  SELECT *, {slug_text_sql('name')} AS nt, {slug_text_sql('botanical')} AS bt, {slug_text_sql("REPLACE(entity_id, '-', ' ')")} AS it FROM ents),
p AS (SELECT *, {slug_text_sql('title')} AS tt, {slug_text_sql("REPLACE(handle, '-', ' ')")} AS ht FROM prods),
ew AS (SELECT *, {words_sql('nt', WIDE_NOISE)} AS nw, {words_sql('bt', WIDE_NOISE)} AS bw, {words_sql('it', WIDE_NOISE)} AS iw FROM e),
pw AS (SELECT *, {words_sql('tt', WIDE_NOISE)} AS tw, {words_sql('ht', WIDE_NOISE)} AS hw FROM p),
pairs AS (
  SELECT entity_id, product_ord, title, handle, GREATEST({wscore('nw', 'tw')}, {wscore('nw', 'hw')}, {wscore('iw', 'hw')},
    0.7::DOUBLE * {wscore('bw', 'tw')}, CASE WHEN CONTAINS(ht, it) OR CONTAINS(it, ht) THEN 0.9::DOUBLE ELSE 0 END) AS raw
  FROM ew CROSS JOIN pw),
ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY entity_id ORDER BY raw DESC, product_ord) AS rn FROM pairs)
SELECT entity_id, handle, title, ROUND_EVEN(raw, 3) AS score FROM ranked WHERE rn = 1 AND raw >= 0.55""")
def best_matches_wide(spark, d):
    return M.best_matches_wide(entities(spark, d), products(spark, d))


# A broken link per (entity, seller): the handle of the seller's first part of that name.
@gate("best_replacement", f"""WITH {PAIR_SQL},
broken AS (
  SELECT CAST(p_partkey % 10 AS VARCHAR) AS seller_id, REPLACE(p_name, ' ', '-') || '-tree' AS entity_id,
         ARG_MIN(handle, p_partkey) AS old_handle
  FROM part JOIN prods ON p_partkey = product_ord GROUP BY 1, 2),
again AS (
  SELECT b.seller_id, b.entity_id, b.old_handle, p.handle, p.title, GREATEST(p.s1, p.s2) AS raw,
    ROW_NUMBER() OVER (PARTITION BY b.entity_id, b.seller_id ORDER BY GREATEST(p.s1, p.s2) DESC, p.product_ord) AS rn
  FROM broken b JOIN pairs p ON p.entity_id = b.entity_id AND p.seller_id = b.seller_id AND p.handle <> b.old_handle)
SELECT seller_id, entity_id, old_handle, handle AS candidate_handle, title AS candidate_title, ROUND_EVEN(raw, 2) AS match_score
FROM again WHERE rn = 1 AND raw >= 0.6""")
def best_replacement(spark, d):
    p = products(spark, d)
    parts = G.table(spark, d, "part").select("p_name", F.col("p_partkey").alias("product_ord"))
    broken = (
        p.join(parts, "product_ord")
        .groupBy("seller_id", F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-tree")).alias("entity_id"))
        .agg(F.min_by("handle", "product_ord").alias("old_handle"))
    )
    snapshot = broken.select("seller_id", "entity_id", F.lit("1gal").alias("tier"), F.lit(1.0).alias("price"))
    prices = p.groupBy("seller_id", "handle").agg(
        F.create_map(F.lit("1 Gallon"), F.min("product_ord").cast("double")).alias("variant_prices")
    )
    return M.best_replacement(broken, entities(spark, d), p, snapshot, prices).select(
        "seller_id", "entity_id", "old_handle", "candidate_handle", "candidate_title", "match_score"
    )
