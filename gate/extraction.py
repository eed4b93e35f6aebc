"""Extraction queries. Product documents and pages are written by Spark from every part, line item
or document, and read back by the operators; the SQL computes what should come out."""
from __future__ import annotations

from pyspark.sql import functions as F

from gate import tables as G
from gate.base import Gate
from gate.matching import match_text_sql, score_sql, words_sql
from offerlens.functions import tiers as T
from offerlens.operators import documents as D
from offerlens.operators import pages as X
from offerlens.operators import promos as PR
from offerlens.operators import quality as Q
from offerlens.operators import store_products as SP
from offerlens.schemas import VARIANT
from offerlens.sources import records as R

gate = Gate()
QUERIES, SQL = gate.queries, gate.sql


def money(c):
    return F.format_string("%.2f", c)


def _lines(spark, d):
    """Line items with a row key that is unique: duplicates of (order, line, part, ...) collapse."""
    l = G.table(spark, d, "lineitem")
    return l.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_discount").distinct()


LINES = "l AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_discount FROM lineitem)"
KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_discount"]
KEY_SQL = ", ".join(KEYS)


def store_products(spark, d):
    """One product per line item: five variants, among them a pack, two of one tier and a bad price."""
    price = F.col("l_extendedprice")
    v = lambda i, title, p, was, there: F.struct(
        F.concat("l_orderkey", F.lit(f"0{i}")).alias("id"),
        F.lit(title).alias("title"),
        (F.lit(p) if isinstance(p, str) else p.cast("string")).alias("price"),
        (F.lit(was).cast("string") if was is None else was.cast("string")).alias("compare_at_price"),
        F.lit(there).cast("boolean").alias("available"),
        F.lit(title).alias("option1"),
    )
    variants = F.array(
        v(1, "1 Gallon", price, price * (1 + F.col("l_discount")), None),
        v(2, "3-Pack", price * 2, None, True),
        v(3, "#1 Container", price + 1, price, None),
        v(4, "Quart | Ships in Spring", price / 2, None, None),
        v(5, "3-4 feet", "n/a", None, True),
        v(6, "5 Gallon", price * 3, price * 4, False),
    )
    return _lines(spark, d).select(
        *KEYS,
        F.concat(F.lit("p"), "l_partkey").alias("handle"),
        F.lit("https://shop").alias("base_url"),
        variants.cast(f"ARRAY<{VARIANT}>").alias("variants"),
    )


PROD_SQL = f"""WITH {LINES}, v AS (
  SELECT *, 1 AS pos, '1gal' AS tier, l_extendedprice + 1 AS price, NULL::DOUBLE AS was_price, NULL::BOOLEAN AS available, '#1 Container' AS raw_size, l_orderkey || '03' AS variant_id FROM l
  UNION ALL SELECT *, 2, 'quart', l_extendedprice / 2, NULL, TRUE, 'Quart | Ships in Spring', l_orderkey || '04' FROM l
  UNION ALL SELECT *, 3, '5gal', l_extendedprice * 3, l_extendedprice * 4, FALSE, '5 Gallon', l_orderkey || '06' FROM l)"""


@gate("offers_from_products", f"{PROD_SQL} SELECT {KEY_SQL}, tier, price, was_price, available, raw_size, variant_id FROM v")
def offers_from_products(spark, d):
    return SP.offers_from_products(store_products(spark, d), KEYS).drop("pos")


@gate("product_rollup", f"WITH {LINES} SELECT {KEY_SQL}, 3 AS n_sizes, TRUE AS in_stock, 'https://shop/products/p' || l_partkey || '?variant=' || l_orderkey || '04' AS url FROM l")
def product_rollup(spark, d):
    return SP.product_rollup(store_products(spark, d), KEYS)


@gate("variant_price_map", f"""WITH {LINES}
SELECT {KEY_SQL}, UNNEST(['1 Gallon', '3-Pack', '#1 Container', 'Quart | Ships in Spring', '5 Gallon']) AS title,
  UNNEST([l_extendedprice, l_extendedprice * 2, l_extendedprice + 1, l_extendedprice / 2, l_extendedprice * 3]) AS price FROM l""")
def variant_price_map(spark, d):
    return SP.variant_price_map(store_products(spark, d), KEYS).select(
        *KEYS, F.explode("variant_prices").alias("title", "price")
    )


@gate("drop_packs", f"WITH {LINES} SELECT {KEY_SQL}, title FROM l, (SELECT UNNEST(['1 Gallon', '#1 Container', 'Quart | Ships in Spring', '3-4 feet', '5 Gallon']) AS title)")
def drop_packs(spark, d):
    rows = store_products(spark, d).select(*KEYS, F.explode("variants.title").alias("title"))
    return Q.drop_packs(rows, "title")


def _store_page():
    """Store page of a line item, in four themes by line number."""
    p = F.col("l_extendedprice")
    sku = F.concat(F.lit("44"), F.lpad(F.col("l_orderkey").cast("string"), 8, "0"))
    offer = lambda tail, price, stock: F.concat(
        F.lit('{"@type":"Offer","sku":"'), sku, F.lit(f'{tail}","price":"'), money(price),
        F.lit(f'","availability":"https://schema.org/{stock}"}}\n'),
    )
    head = F.concat(F.lit("<html><head><title>Item "), F.col("l_partkey").cast("string"), F.lit(" | Shop</title></head>"))
    labels = F.concat(
        F.lit('<button aria-label="1 Quart - Sale price: '), money(p), F.lit(" - List price: $"), money(p + 5),
        F.lit('">1 Quart</button><button aria-label="1 Gallon - Sale price: '), money(p + 10),
        F.lit(" - List price: $"), money(p + 10),
        F.lit('">1 Gallon</button><button aria-label="3-Pack - Sale price: 9.99 - List price: $9.99">3-Pack</button>'),
        offer("", p, "InStock"),
    )
    script = F.concat(
        F.lit('"gid://shopify/ProductVariant/'), sku, F.lit('1","1 Gallon" "gid://shopify/ProductVariant/'), sku,
        F.lit('2","Quart Container" "color","Red"\n'),
        offer("1", p, "InStock"), offer("2", p + 3, "OutOfStock"), offer("3-4PACK", p * 4, "InStock"),
        F.lit('"sku":"'), sku, F.lit('1" "StrikethroughPrice" "price":"'), money(p * 2), F.lit('"\n'),
    )
    by_price = F.concat(
        F.lit('<a aria-label="x" class="b">3-4 feet</a><a aria-label="y">5-6 ft</a>\n'),
        offer("2", p + 20, "InStock"), offer("1", p, "InStock"), offer("3", p + 10, "OutOfStock"),
    )
    option = F.concat(
        F.lit('{"variants":[{"id":'), sku, F.lit('1,"option1":"3 Gallon"},{"id":'), sku,
        F.lit('2,"option1":"Default Title"}]}\n'),
        offer("1", p, "OutOfStock"), offer("2", p + 1, "OutOfStock"),
    )
    theme = F.col("l_linenumber") % 4
    body = F.when(theme == 0, labels).when(theme == 1, script).when(theme == 2, by_price).otherwise(option)
    return F.concat(head, body)


def html_pages(spark, d):
    """Store pages: one per line item."""
    return _lines(spark, d).select(*KEYS, _store_page().alias("html"))


def cents(e):
    return f"CAST(CAST(printf('%.2f', {e}) AS VARCHAR) AS DOUBLE)"


PAGE_SQL = f"""WITH {LINES}, m AS (SELECT *, l_linenumber % 4 AS theme, l_extendedprice AS p FROM l), found AS (
  SELECT {KEY_SQL}, 'label' AS strategy, 'quart' AS tier, {cents('p')} AS price, {cents('p + 5')} AS was_price, TRUE AS available, '1 Quart' AS raw_size, TRUE AS in_stock FROM m WHERE theme = 0
  UNION ALL SELECT {KEY_SQL}, 'label', '1gal', {cents('p + 10')}, NULL, TRUE, '1 Gallon', TRUE FROM m WHERE theme = 0
  UNION ALL SELECT {KEY_SQL}, 'script', '1gal', {cents('p')}, {cents('p * 2')}, TRUE, '1 Gallon', TRUE FROM m WHERE theme = 1
  UNION ALL SELECT {KEY_SQL}, 'script', 'quart', {cents('p + 3')}, NULL, FALSE, 'Quart Container', TRUE FROM m WHERE theme = 1
  UNION ALL SELECT {KEY_SQL}, 'price_order', '3-4ft', {cents('p')}, NULL, TRUE, '3-4 feet', TRUE FROM m WHERE theme = 2
  UNION ALL SELECT {KEY_SQL}, 'price_order', '5-6ft', {cents('p + 20')}, NULL, TRUE, '5-6 ft', TRUE FROM m WHERE theme = 2
  UNION ALL SELECT {KEY_SQL}, 'price_order', 'default', {cents('p + 10')}, NULL, FALSE, 'variant-44' || LPAD(CAST(l_orderkey AS VARCHAR), 8, '0') || '3', TRUE FROM m WHERE theme = 2
  UNION ALL SELECT {KEY_SQL}, 'script', '3gal', {cents('p')}, NULL, FALSE, '3 Gallon', FALSE FROM m WHERE theme = 3
  UNION ALL SELECT {KEY_SQL}, 'script', 'default', {cents('p + 1')}, NULL, FALSE, 'variant-44' || LPAD(CAST(l_orderkey AS VARCHAR), 8, '0') || '2', FALSE FROM m WHERE theme = 3)"""


@gate("offers_from_html", f"{PAGE_SQL} SELECT *, 'Item ' || l_partkey AS title FROM found")
def offers_from_html(spark, d):
    return X.offers_from_html(html_pages(spark, d), KEYS).drop("pos")


def _layer_page():
    """Page with a data layer (even lines) or structured data only (odd lines)."""
    p = F.col("l_extendedprice")
    layer = F.concat(
        F.lit('<script>dataLayer.push({"productFamilyList":[{"productFamily":{"name":"Item","nameWithCategoryType":"Item Tree"},"lowestPrice":'),
        money(p), F.lit(',"lowestRegularPrice":'), money(p + 10),
        F.lit(',"availableProducts":[{"productDescription":"Item Dwarf","price":'), money(p),
        F.lit('},{"productDescription":"Item Dwarf 7 Gal Potted","price":'), money(p * 2),
        F.lit('},{"productDescription":"gone","price":0}]}]});</script>'),
    )
    jsonld = F.concat(
        F.lit('<script type="application/ld+json">\n{"@type":"Product","offers":{"@type":"AggregateOffer","lowPrice":"'),
        money(p), F.lit('","availability":"https://schema.org/InStock"}}\n</script>'),
    )
    body = F.when(F.col("l_linenumber") % 2 == 0, layer).otherwise(jsonld)
    return F.concat(F.lit("<html>"), body, F.lit("</html>"))


def layer_pages(spark, d):
    return _lines(spark, d).select(*KEYS, F.lit("layer").alias("kind"), _layer_page().alias("html"))


def archived_pages(spark, d):
    """The store page and the layer page of each line item. One pass: the parts of a union get half the tasks each."""
    both = [F.struct(F.lit(kind).alias("kind"), page.alias("html")) for kind, page in (("page", _store_page()), ("layer", _layer_page()))]
    return _lines(spark, d).select(*KEYS, F.inline(F.array(*both)))


@gate("offers_from_datalayer", f"""WITH {LINES}, m AS (SELECT *, l_extendedprice AS p FROM l)
SELECT {KEY_SQL}, 'Item Tree' AS title, 'dwarf' AS tier, {cents('p')} AS price, {cents('p + 10')} AS was_price, TRUE AS available, 'Item Dwarf' AS raw_size FROM m WHERE l_linenumber % 2 = 0
UNION ALL SELECT {KEY_SQL}, 'Item Tree', 'dwarf-potted', {cents('p * 2')}, NULL, TRUE, 'Item Dwarf 7 Gal Potted' FROM m WHERE l_linenumber % 2 = 0
UNION ALL SELECT {KEY_SQL}, NULL, 'default', {cents('p')}, NULL, TRUE, 'Best available' FROM m WHERE l_linenumber % 2 = 1""")
def offers_from_datalayer(spark, d):
    return X.offers_from_datalayer(layer_pages(spark, d), KEYS).drop("pos")


@gate("archive_offers", f"""{PAGE_SQL}
SELECT {KEY_SQL}, tier AS size, price, was_price AS regular_price, 'medium' AS confidence FROM found WHERE strategy = 'label'
UNION ALL SELECT {KEY_SQL}, tier, price, NULL, 'medium' FROM found WHERE strategy = 'script' AND l_linenumber % 4 = 1
UNION ALL SELECT {KEY_SQL}, 'default', {cents("CASE WHEN l_linenumber % 4 = 2 THEN p + 10 ELSE p + 1 END")}, NULL, 'medium' FROM m WHERE theme IN (2, 3)
UNION ALL SELECT {KEY_SQL}, 'dwarf', {cents('p')}, NULL, 'high' FROM m WHERE l_linenumber % 2 = 0
UNION ALL SELECT {KEY_SQL}, 'dwarf-potted', {cents('p * 2')}, NULL, 'high' FROM m WHERE l_linenumber % 2 = 0
UNION ALL SELECT {KEY_SQL}, 'default', {cents('p')}, NULL, 'medium' FROM m WHERE l_linenumber % 2 = 1""")
def archive_offers(spark, d):
    return X.archive_offers(archived_pages(spark, d), KEYS)


def promo_pages(spark, d):
    """Each document as a page with a promotion about it. Two pages per seller key and more."""
    doc = F.col("doc_id").cast("string")
    return G.table(spark, d, "documents").select(
        "doc_id",
        (F.col("doc_id") % 50).cast("string").alias("seller_id"),
        F.concat(
            F.lit('<div class="announcement-bar"><b>Use code</b> SAVE'), doc, F.lit(" today</div><p>Get "),
            (F.col("doc_id") % 50 + 5).cast("string"), F.lit("% off with CODE"),
            F.lit(" BLOOM"), (F.col("doc_id") % 7).cast("string"),
            F.lit(" now</p><p>Free shipping on orders over $"), (F.col("doc_id") % 3 + 50).cast("string"),
            F.lit("!</p><i>FLASH sale</i> and flash  sale<article>"),
            F.col("text"), F.lit("</article>"),
        ).alias("html"),
    )


@gate("promo_signals", """SELECT doc_id, 'SAVE' || doc_id || ',' || 'BLOOM' || doc_id % 7 AS codes,
 'Free shipping on orders over $' || (doc_id % 3 + 50) || ',FLASH sale' AS banners FROM documents""")
def promo_signals(spark, d):
    out = PR.promo_signals(promo_pages(spark, d))
    return out.select(
        "doc_id", F.array_join("codes", ",").alias("codes"), F.array_join("banners", ",").alias("banners")
    )


CONTEXT_SQL = r"""WITH h AS (
  SELECT doc_id, '<div class="announcement-bar"><b>Use code</b> SAVE' || doc_id || ' today</div><p>Get ' || (doc_id % 50 + 5)
    || '% off with CODE BLOOM' || doc_id % 7 || ' now</p><p>Free shipping on orders over $' || (doc_id % 3 + 50)
    || '!</p><i>FLASH sale</i> and flash  sale<article>' || text || '</article>' AS html FROM documents),
t AS (SELECT doc_id, 'Use code ' || REGEXP_REPLACE(html, '<[^>]+>', ' ', 'g') AS x FROM h),
c AS (SELECT doc_id, UNNEST(LIST_CONCAT(LIST_CONCAT(LIST_CONCAT(LIST_CONCAT(
  REGEXP_EXTRACT_ALL(x, '(?:use|enter|apply)\s+(?:code\s+)?([A-Z][A-Z0-9]{2,19})\b', 1, 'i'),
  REGEXP_EXTRACT_ALL(x, 'promo(?:\s+code)?[:\s]+([A-Z][A-Z0-9]{2,19})\b', 1, 'i')),
  REGEXP_EXTRACT_ALL(x, 'coupon(?:\s+code)?[:\s]+([A-Z][A-Z0-9]{2,19})\b', 1, 'i')),
  REGEXP_EXTRACT_ALL(x, 'discount(?:\s+code)?[:\s]+([A-Z][A-Z0-9]{2,19})\b', 1, 'i')),
  REGEXP_EXTRACT_ALL(x, 'code[:\s]+([A-Z][A-Z0-9]{2,19})\b', 1, 'i'))) AS code FROM t)
SELECT DISTINCT doc_id, UPPER(code) AS code, 'text-pattern' AS source FROM c
WHERE UPPER(code) NOT IN ('HTTP', 'HTML', 'FREE', 'SHIP', 'SALE', 'BEST', 'MORE', 'SHOP', 'VIEW')"""


@gate("promo_signals_context", CONTEXT_SQL)
def promo_signals_context(spark, d):
    out = PR.promo_signals_context(promo_pages(spark, d).select("doc_id", "html"))
    return out.select("doc_id", "code", "source")


@gate("merge_page_promos", """WITH c AS (
  SELECT doc_id % 50 AS s, doc_id AS o, 1 AS i, 'SAVE' || doc_id AS v FROM documents
  UNION ALL SELECT doc_id % 50, doc_id, 2, 'BLOOM' || doc_id % 7 FROM documents),
f AS (SELECT s, v, MIN((o, i)) AS o FROM c GROUP BY 1, 2),
b AS (SELECT doc_id % 50 AS s, doc_id AS o, 1 AS i, 'Free shipping on orders over $' || (doc_id % 3 + 50) AS v FROM documents
  UNION ALL SELECT doc_id % 50, doc_id, 2, 'FLASH sale' FROM documents),
g AS (SELECT s, v, MIN((o, i)) AS o FROM b GROUP BY 1, 2)
SELECT CAST(s AS VARCHAR) AS seller_id, STRING_AGG(v, ',' ORDER BY o) AS codes,
  (SELECT STRING_AGG(g.v, ',' ORDER BY g.o) FROM g WHERE g.s = f.s) AS banners FROM f GROUP BY s""")
def merge_page_promos(spark, d):
    out = PR.merge_page_promos(PR.promo_signals(promo_pages(spark, d)), "doc_id", ["seller_id"])
    return out.select(
        "seller_id", F.array_join("codes", ",").alias("codes"), F.array_join("banners", ",").alias("banners")
    )


def described(spark, d):
    """Product descriptions of parts, in three layouts."""
    lo = F.col("p_size") % 7 + 2
    z = lambda sep, word="": F.concat(lo.cast("string"), F.lit(sep), (lo + 3).cast("string"))
    listed = F.array_join(F.transform(F.sequence(lo, lo + 3), lambda x: x.cast("string")), ", ")
    table = F.concat(
        F.lit("<table><tr><td><b>Growing Zones</b></td><td>"), z("-"),
        F.lit("</td></tr><tr><td>Sun Exposure</td><td>Full Sun</td></tr><tr><td>Mature Height</td><td>"), z("-"),
        F.lit(" feet</td></tr><tr><td>Mature Width</td><td>3'</td></tr><tr><td>Plant Type</td><td>Tree</td></tr></table>"),
    )
    items = F.concat(
        F.lit("<ul><li>Hardiness Zones: "), listed, F.lit("</li><li>Sun: full sun to part shade</li><li>Height: "),
        z(" to "), F.lit(" ft.</li><li>Bloom Time: Late Spring, Summer</li></ul>"),
    )
    text = F.concat(F.lit("<p>Zones "), z("-"), F.lit("</p>"))
    kind = F.col("p_partkey") % 3
    return G.table(spark, d, "part").select(
        "p_partkey", F.when(kind == 0, table).when(kind == 1, items).otherwise(text).alias("body_html")
    )


ZONES_SQL = "(p_size % 7 + 2) || ',' || (p_size % 7 + 3) || ',' || (p_size % 7 + 4) || ',' || (p_size % 7 + 5)"


@gate("attributes_from_html", f"""SELECT p_partkey, {ZONES_SQL} AS zones,
  CASE p_partkey % 3 WHEN 0 THEN 'Full Sun' WHEN 1 THEN 'full sun to part shade' END AS sun,
  CASE p_partkey % 3 WHEN 0 THEN (p_size % 7 + 2) || '-' || (p_size % 7 + 5) || ' ft tall x 3 ft wide'
    WHEN 1 THEN (p_size % 7 + 2) || '-' || (p_size % 7 + 5) || ' ft' END AS mature_size,
  CASE p_partkey % 3 WHEN 1 THEN 'Late Spring, Summer' END AS bloom_time,
  CASE p_partkey % 3 WHEN 0 THEN 'Tree' END AS type FROM part""")
def attributes_from_html(spark, d):
    out = D.attributes_from_html(described(spark, d), ["p_partkey"])
    return out.withColumn("zones", F.array_join(F.transform("zones", lambda x: x.cast("string")), ","))


@gate("document_outline", r"""WITH t AS (SELECT doc_id, lang, source, STRING_SPLIT(text, chr(10)) AS lines FROM documents),
x AS (SELECT doc_id, lang, source, LIST_FILTER(lines, lambda l: TRIM(l, ' ' || chr(9) || chr(13)) <> '' AND NOT STARTS_WITH(l, '*') AND NOT STARTS_WITH(l, '#')) AS plain FROM t),
y AS (SELECT *, COALESCE(LEFT(TRIM(plain[1], ' ' || chr(9) || chr(13)), 200), 'Last words') AS excerpt FROM x)
SELECT doc_id, 'Guide ' || doc_id AS title, 'guide-' || doc_id AS slug, 'part-' || lang || ';the-end' AS toc_ids,
  'Part ' || lang || ';The End' AS toc_texts, excerpt, LEFT(excerpt, 160) AS description FROM y""")
def document_outline(spark, d):
    doc = F.col("doc_id").cast("string")
    docs = G.table(spark, d, "documents").select(
        "doc_id",
        F.concat(F.lit("07-guide-"), doc, F.lit(".md")).alias("file_name"),
        F.concat(
            F.lit("# Guide "), doc, F.lit("\n*by the shop*\n\n"), F.col("text"),
            F.lit("\n## Part "), "lang", F.lit(" (notes)\nLast words\n## The End\n"),
        ).alias("value"),
    )
    out = D.document_outline(docs)
    return out.select(
        "doc_id", "title", "slug", F.array_join("toc.id", ";").alias("toc_ids"),
        F.array_join("toc.text", ";").alias("toc_texts"), "excerpt", "description",
    )


SITE_LINKS = r"""links AS (
  SELECT url, UNNEST(REGEXP_EXTRACT_ALL(html, 'href="([^"]*)"', 1)) AS href FROM pages),
inside AS (SELECT url, SPLIT_PART(SPLIT_PART(href, '#', 1), '?', 1) AS path FROM links WHERE STARTS_WITH(href, '/'))"""


def _known_paths(spark, d):
    return G.table(spark, d, "pages").select(
        F.concat(F.lit("/"), F.regexp_extract("html", r'<html lang="([^"]*)"', 1)).alias("path")
    ).unionByName(G.table(spark, d, "nation").select(F.concat(F.lit("/"), F.lower("n_name")).alias("path"))).unionByName(
        G.table(spark, d, "region").select(F.lit("/the").alias("path")))


@gate("broken_internal_links", rf"""WITH {SITE_LINKS}, known AS (
  SELECT '/' || REGEXP_EXTRACT(html, '<html lang="([^"]*)"', 1) AS path FROM pages
  UNION SELECT '/' || LOWER(n_name) FROM nation UNION SELECT '/the')
SELECT url, path, COUNT(*) AS n_links FROM inside WHERE path NOT IN (SELECT path FROM known) GROUP BY 1, 2""")
def broken_internal_links(spark, d):
    return Q.broken_internal_links(G.table(spark, d, "pages"), _known_paths(spark, d))


@gate("page_titles", r"""SELECT page_id, TRIM(REGEXP_REPLACE(
 REPLACE(REPLACE(REPLACE(REPLACE(REPLACE(SPLIT_PART(REGEXP_EXTRACT(html, '<title>([^<]+)</title>', 1), '|', 1), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) AS title
FROM pages WHERE REGEXP_MATCHES(html, '<title>([^<]+)</title>')""")
def page_titles(spark, d):
    return G.table(spark, d, "pages").select("page_id", Q.page_title(F.col("html")).alias("title")).filter(
        F.col("title").isNotNull()
    )


@gate("product_sitemap", """SELECT p_partkey AS handle_key, 'p' || p_partkey AS handle, p_name AS title FROM part WHERE p_partkey % 4 > 0""")
def product_sitemap(spark, d):
    key = F.col("p_partkey").cast("string")
    entries = G.table(spark, d, "part").select(
        F.concat(F.lit("https://shop"), F.when(F.col("p_partkey") % 4 > 0, F.lit("/products/p")).otherwise("/blog/p"),
                 key, F.lit("?x=1#top")).alias("loc"),
        F.concat(F.lit(" "), "p_name", F.lit("\n")).alias("title"),
    )
    return R.sitemap_products(entries).select(
        F.regexp_extract("handle", r"p(\d+)", 1).cast("long").alias("handle_key"), "handle", "title"
    )


@gate("archive_index", """SELECT DISTINCT 'u' || user_id AS url, STRFTIME(ts, '%Y%m%d%H%M%S') AS stamp, STRFTIME(ts, '%Y%m') AS yyyymm,
 STRFTIME(ts, '%Y-%m-%d %H:%M:%S') AS seen FROM events WHERE event_type <> 'error'""")
def archive_index(spark, d):
    rows = G.table(spark, d, "events").select(
        F.array(
            F.date_format("ts", "yyyyMMddHHmmss"), F.concat(F.lit("u"), F.col("user_id").cast("string")),
            F.when(F.col("event_type") == "error", "404").otherwise("200"),
        ).alias("row")
    )
    return R.archive_rows(rows).select(
        "url", "stamp", "yyyymm", F.date_format("snapshot_ts", "yyyy-MM-dd HH:mm:ss").alias("seen")
    ).distinct()


@gate("size_tier", """SELECT p_partkey, CASE p_partkey % 12 WHEN 0 THEN '1gal' WHEN 1 THEN '3gal' WHEN 2 THEN 'quart'
  WHEN 3 THEN p_size || '-' || (p_size + 1) || 'ft' WHEN 4 THEN 'premium-bareroot' WHEN 5 THEN '12-18in' WHEN 6 THEN 'semi-dwarf'
  WHEN 7 THEN 'default' WHEN 8 THEN 'bulb' WHEN 9 THEN p_size || 'ft' WHEN 10 THEN REPLACE(p_name, ' ', '-') ELSE 'ultra-supreme' END AS tier FROM part""")
def size_tier(spark, d):
    size = F.col("p_size").cast("string")
    titles = [
        F.lit("1 GALLON - 2-4 FT / 1 Plant(s) | Ships in Spring"), F.lit("#3 Container 3-4 Feet"), F.lit("One Quart"),
        F.concat(size, F.lit(" - "), (F.col("p_size") + 1).cast("string"), F.lit(" feet")),
        F.lit("PREMIUM / 1 Plant(s) | Ships in Fall"), F.lit('FIELD 12-18" / 1 Plant(s)'), F.lit("Apple Semi-Dwarf"),
        F.concat(F.lit("variant-"), F.lpad(size, 9, "7")), F.lit("3 Bulbs"), F.concat(size, F.lit(" ft")),
        F.concat(F.upper("p_name"), F.lit("!")), F.lit("Ultra Supreme"),
    ]
    title = F.get(F.array(*titles), (F.col("p_partkey") % 12).cast("int"))
    return G.table(spark, d, "part").select("p_partkey", T.size_tier(title).alias("tier"))


TITLE_SQL = r"""CASE WHEN REGEXP_MATCHES(html, '<title>([^<]+)</title>') THEN TRIM(REGEXP_REPLACE(
 REPLACE(REPLACE(REPLACE(REPLACE(REPLACE(SPLIT_PART(REGEXP_EXTRACT(html, '<title>([^<]+)</title>', 1), '|', 1), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) END"""


@gate("title_mismatch", f"""WITH t AS (SELECT page_id, url, {TITLE_SQL} AS title FROM pages),
ex AS (SELECT url, ARG_MIN(CASE WHEN page_id % 2 = 0 THEN COALESCE(title, chr(1)) ELSE 'item ' || page_id END, page_id) AS name FROM t GROUP BY 1),
x AS (SELECT page_id, t.url, NULLIF(name, chr(1)) AS name, title AS page_title, COALESCE(title, '') AS tt0 FROM t JOIN ex USING (url)),
y AS (SELECT *, {match_text_sql('name')} AS nt, {match_text_sql('tt0')} AS tt FROM x),
z AS (SELECT *, {words_sql('nt')} AS nw, {words_sql('tt')} AS tw FROM y)
SELECT * FROM (SELECT page_id, url, name, page_title, {score_sql('nw', 'tw', 'nt', 'tt')} AS title_score FROM z) WHERE title_score < 0.5""")
def title_mismatch(spark, d):
    pages = G.table(spark, d, "pages")
    # The expected name is the page title's first half, or a name from another page's number.
    name = F.when(F.col("page_id") % 2 == 0, Q.page_title(F.col("html"))).otherwise(
        F.concat(F.lit("item "), F.col("page_id").cast("string"))
    )
    expected = pages.groupBy("url").agg(F.min_by(name, "page_id").alias("name"))
    return Q.title_mismatch(pages, expected).select("page_id", "url", "name", "page_title", "title_score")
