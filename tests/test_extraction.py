"""Store products, pages, promotions, attributes and outlines on small literal inputs."""
import pytest
from pyspark.sql import functions as F

from offerlens.operators import documents as D
from offerlens.operators import pages as X
from offerlens.operators import promos as PR
from offerlens.operators import store_products as SP
from offerlens.schemas import VARIANT


def products(spark, variants):
    rows = [(1, "h", [(str(v.get("id", i)), v.get("title"), v.get("price", "10"), v.get("was"), v.get("available"), None)
                      for i, v in enumerate(variants)])]
    return spark.createDataFrame(rows, f"k INT, handle STRING, variants ARRAY<{VARIANT}>").withColumn("base_url", F.lit("https://s"))


def offers(df):
    return {r["tier"]: r.asDict() for r in SP.offers_from_products(df, ["k"]).collect()}


def test_packs_and_bad_prices(spark):
    got = offers(products(spark, [
        {"title": "1 Gallon", "price": "20", "was": "25"}, {"title": "3 Plant(s)"}, {"title": "BOGO"}, {"title": "Single - 2 pack"},
        {"title": "Quart", "price": "abc"}, {"title": "2 Gallon", "price": "0"}, {"title": "3 Gallon", "price": "30", "was": "30"}]))
    assert set(got) == {"1gal", "3gal"}
    assert got["1gal"]["was_price"] == 25.0 and got["3gal"]["was_price"] is None


def test_last_variant_wins_and_stock(spark):
    df = products(spark, [{"title": "1 Gallon", "price": "20", "available": True, "id": 5},
                          {"title": "#1 Container", "price": "22", "available": False, "id": 6}])
    got = offers(df)
    assert got["1gal"]["price"] == 22.0 and got["1gal"]["variant_id"] == "6"
    roll = SP.product_rollup(df, ["k"]).first()
    assert roll["in_stock"] is True and roll["url"] == "https://s/products/h?variant=6"


@pytest.mark.parametrize("flags,stock", [((None, None), None), ((True, False), True), ((False, False), False), ((None, False), False)])
def test_three_valued_stock(spark, flags, stock):
    df = products(spark, [{"title": "1 Gallon", "available": flags[0]}, {"title": "Quart", "available": flags[1]}])
    assert SP.product_rollup(df, ["k"]).first()["in_stock"] is stock


def test_unknown_stock_that_ships_later(spark):
    got = offers(products(spark, [{"title": "PREMIUM / 1 Plant(s) | Ships in Spring"}]))
    assert got["premium-bareroot"]["available"] is True


def test_variant_price_map(spark):
    df = products(spark, [{"title": "A", "price": "1"}, {"title": "A", "price": "2"}, {"title": "B", "price": "x"}, {"title": None, "price": "3"}])
    assert SP.variant_price_map(df, ["k"]).first()["variant_prices"] == {"A": 2.0, "": 3.0}


def page(spark, html):
    df = spark.createDataFrame([(1, "layer", html)], "k INT, kind STRING, html STRING")
    return df


def html_offers(spark, html):
    rows = X.offers_from_html(page(spark, html), ["k"]).orderBy("pos").collect()
    return {r["tier"]: r.asDict() for r in rows}


def offer(sku, price, stock="InStock"):
    return '{"@type":"Offer","sku":"%s","price":"%s","availability":"https://schema.org/%s"}\n' % (sku, price, stock)


def test_labels_win(spark):
    got = html_offers(spark, "<title>Rose | Shop</title>"
        '<button aria-label="1 Quart - Sale price: 24.99 - List price: $34.99">'
        '<button aria-label="3-Pack - Sale price: 99.99 - List price: $129.99">' + offer("44100001", "1"))
    assert set(got) == {"quart"}
    assert (got["quart"]["was_price"], got["quart"]["title"], got["quart"]["strategy"]) == (34.99, "Rose", "label")


@pytest.mark.parametrize("script", [
    '"gid://shopify/ProductVariant/4410000001","1 Gallon"',
    '"id":"gid://shopify/ProductVariant/4410000001","x":1,\n"selectedOptions":[{"name":"Size","value":"1 Gallon"}]',
    '"id":"gid://shopify/ProductVariant/4410000001","optionValues":[{"name":"1 Gallon"}] "id":"gid://shopify/ProductVariant/99"',
    '{"id":4410000001,"sku":"a","option1":"1 Gallon"}',
    '{"id": 4410000001, "title": "1 Gallon"}',
    '"variants":[{"id":4410000001,"z":"zzzzzzzzzz","option1":"1 Gallon"}]',
    '<button data-variant-id="4410000001" class="x"> 1 Gallon </button>'])
def test_names_from_scripts(spark, script):
    got = html_offers(spark, script + offer("4410000001", "20") + offer("4410000001-4PACK", "70"))
    assert {t: (r["price"], r["strategy"]) for t, r in got.items()} == {"1gal": (20.0, "script")}


def test_strikethrough_and_unnamed(spark):
    got = html_offers(spark, '"gid://shopify/ProductVariant/4410000001","1 Gallon"' + offer("4410000001", "20") + offer("4410000002", "30", "OutOfStock")
                      + '"sku":"4410000001" "StrikethroughPrice" "price":"28"\n')
    assert got["1gal"]["was_price"] == 28.0 and got["1gal"]["in_stock"] is True
    assert got["default"]["raw_size"] == "variant-4410000002" and got["default"]["available"] is False


def test_price_order_uses_stock_when_too_many(spark):
    got = html_offers(spark, '<a aria-label="a">3-4 feet</a><a aria-label="b">5-6 feet</a>' + offer("1", "50") + offer("2", "10", "OutOfStock") + offer("3", "30"))
    assert got["3-4ft"]["price"] == 30.0 and got["5-6ft"]["price"] == 50.0 and got["variant-2"]["price"] == 10.0


def test_position_after_swallowed_pack(spark):
    # the pack object lacks a price, so the first reading swallows the offer after it
    html = '<b>>3-4 ft<</b><b>>5-6 ft<</b>' + '{"@type":"Offer","sku":"9-4PACK"} ' + offer("1", "50").strip() + "\n"
    got = html_offers(spark, html)
    assert got["3-4ft"]["price"] == 50.0 and got["3-4ft"]["strategy"] == "position"


LAYER = ('<script>\ndataLayer.push({"productFamilyList":[{"productFamily":{"name":"Apple","nameWithCategoryType":"Apple Tree"},'
         '"lowestPrice":34.99,"lowestRegularPrice":44.99,"availableProducts":[{"productDescription":"Apple Dwarf","price":34.99},'
         '{"productDescription":"Apple Semi-Dwarf","price":44.99},{"productDescription":"Apple Standard","price":54.99},'
         '{"productDescription":"Apple Dwarf 7 Gal Potted","price":79.99},{"productDescription":"none","price":0}]}]});\n</script>')
JSONLD = ('<script type="application/ld+json">\n{"@type":"Product","offers":{"@type":"AggregateOffer","lowPrice":"29.99",'
          '"availability":"https://schema.org/InStock"}}\n</script>')


def test_datalayer(spark):
    rows = {r["tier"]: r for r in X.offers_from_datalayer(page(spark, LAYER), ["k"]).collect()}
    assert set(rows) == {"dwarf", "semi-dwarf", "standard", "dwarf-potted"}
    assert rows["dwarf"]["was_price"] == 44.99 and rows["semi-dwarf"]["was_price"] is None and rows["dwarf"]["title"] == "Apple Tree"


def test_jsonld_fallback(spark):
    (row,) = X.offers_from_datalayer(page(spark, JSONLD), ["k"]).collect()
    assert (row["tier"], row["price"], row["available"]) == ("default", 29.99, True)
    (row,) = X.archive_offers(page(spark, JSONLD), ["k"]).collect()
    assert row["confidence"] == "medium"
    assert {r["confidence"] for r in X.archive_offers(page(spark, LAYER), ["k"]).collect()} == {"high"}


def test_promos(spark):
    html = "<b>Use code: spring25</b> Get 10% off with BLOOM10. code 12345 Code ABCD <i>20% off sitewide</i> 20% OFF SITEWIDE buy 2, get 1 free"
    row = PR.promo_signals(page(spark, html)).first()
    assert row["codes"] == ["SPRING25", "BLOOM10"]
    assert row["banners"] == ["20% off sitewide", "buy 2, get 1 free"]


def test_promo_context(spark):
    html = "<p>aaaaaaaaaaaaaaaaaaaaaaaaaaaa use code ONE10 and promo: TWO20 now</p><p>code FREE</p>"
    rows = PR.promo_signals_context(page(spark, html).drop("kind")).orderBy("pos").collect()
    assert [r["code"] for r in rows] == ["ONE10", "TWO20"]
    assert rows[0]["description"] == "aaaaaaaaaaaaaaaaaaa use code ONE10 and promo: TWO20 now code FREE"
    rows = PR.promo_signals_context(page(spark, "<p>Save up to 20% off today</p>").drop("kind")).collect()
    assert [(r["code"], r["source"]) for r in rows] == [(None, "savings-banner")]
    late = "x" * 6000 + " use code LATE10"
    assert PR.promo_signals_context(page(spark, late).drop("kind")).count() == 1


def attrs(spark, body):
    df = spark.createDataFrame([(1, body)], "k INT, body_html STRING")
    return D.attributes_from_html(df, ["k"]).first().asDict()


def test_attributes(spark):
    got = attrs(spark, "<table><tr><td>Growing Zones</td><td>6, 7, 8</td></tr><tr><td>Sun&nbsp;Exposure</td><td> Full <b>Sun</b></td></tr></table>"
                       "<script>Zones 1-2</script><p>Mature Height: 3 to 4 feet</p><p>Spread: 3'</p><p>Bloom Time: Fall,</p><p>Type: Ornamental grass</p>")
    assert got["zones"] == [6, 7, 8] and got["mature_size"] == "3-4 ft tall x 3 ft wide"
    assert got["bloom_time"] == "Fall" and got["type"] == "Ornamental grass"
    assert attrs(spark, "<p>Hardy in Zones 4-8</p>")["zones"] == [4, 5, 6, 7, 8]
    assert attrs(spark, "<p>Zones 4-18</p>")["zones"] is None
    assert set(attrs(spark, "").values()) == {1, None}


def test_outline(spark):
    text = "intro\n# The Title\n*by me*\n\n## Not this\nFirst line of text.\nmore\n## Why it costs (a lot)\n### no\n## End!  \n"
    df = spark.createDataFrame([("03-my-guide.md", text), ("x.md", "no heading")], "file_name STRING, value STRING")
    a, b = D.document_outline(df).orderBy("file_name").collect()
    assert (a["slug"], a["excerpt"]) == ("my-guide", "First line of text.")
    assert [(t["id"], t["text"]) for t in a["toc"]] == [("not-this", "Not this"), ("why-it-costs", "Why it costs"), ("end", "End!")]
    assert b["title"] == "x.md" and b["description"] == "x.md - Compare prices across online nurseries."


def test_character_references(spark):
    from offerlens.functions.text import unescape
    df = spark.createDataFrame([("a&mdash;b &eacute;&#8217;&#x1F600; &amp;lt; &nbsp;x &bogus; & z; &#0;",), (None,), ("plain",)], "t STRING")
    assert [r[0] for r in df.select(unescape(F.col("t"))).collect()] == ["a—b é’😀 &lt;  x &bogus; & z; \ufffd", None, "plain"]

