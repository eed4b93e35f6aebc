"""Matching catalog names to store listings by shared words, without comparing all with all.

A score is the share of a name's words found in a title, times a weight. For a name of n words to
reach the threshold, at least m words have to be shared, so one of its n-m+1 rarest words has to
be among them. Only these words are joined on, which leaves common words out of the join without
losing a match; equal texts are compared once; a word that is still common is split over several
tasks. Pairs are scored where they are joined and reduced to the best per name before any shuffle.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens.functions import fixed_values as FV
from offerlens.functions import names as N
from offerlens.functions.pricing import confidence_band
from offerlens.operators.windows import top_per_group

# Titles per task for one word; a word found in more titles is split over more tasks.
SPLIT = 20_000
# Room for the product order beside the count of missing words in one LONG.
ORDER_BITS = 48


def _fitting(order: Column) -> Column:
    """The product order, checked once per product: one that doesn't fit stops the query, as it would
    change scores."""
    fits = (order >= 0) & (order < F.lit(1 << ORDER_BITS))
    too_large = F.raise_error(F.lit(f"product order must be from 0 to 2^{ORDER_BITS} - 1")).cast("long")
    return F.when(fits, order).when(order.isNotNull(), too_large)


def _packed(missing: Column, order: Column) -> Column:
    """(missing words, product order) as one sortable LONG, so the best pair is a plain ``min``."""
    return F.call_function("shiftleft", missing.cast("long"), F.lit(ORDER_BITS)) + order


def _missing(packed: Column) -> Column:
    return F.call_function("shiftright", packed, F.lit(ORDER_BITS)).cast("int")


def _order(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit((1 << ORDER_BITS) - 1))


def _key(words: Column) -> Column:
    return F.array_join(F.array_sort(words), " ")


def _distinct_titles(products: DataFrame, group: list[str], keep: int) -> DataFrame:
    """One row per distinct word set: its first product, or its first ``keep`` handles."""
    keyed = products.select(*group, _key(F.col("p_words")).alias("p_key"), "p_handle", "p_ord").filter(
        "p_key != ''"
    )
    if keep == 1:
        firsts = keyed.groupBy(*group, "p_key").agg(F.min("p_ord").alias("p_ord")).withColumn(
            "p_handle", F.lit(None).cast("string")
        )
    else:
        per_handle = keyed.groupBy(*group, "p_key", "p_handle").agg(F.min("p_ord").alias("p_ord"))
        firsts = top_per_group(per_handle, [*group, "p_key"], [F.col("p_ord")], keep)
    return firsts.withColumn("p_words", F.split("p_key", " "))


def _wanted(sets: DataFrame, name_key: list[str], threshold: float) -> DataFrame:
    """name_key.., needed, n, word: the words of each distinct name, and how many of its n words a title has to share."""
    share = F.sequence(F.lit(1), F.size("e_words"))
    needed = F.get(F.filter(share, lambda k: k / F.size("e_words") * F.col("e_weight") >= F.lit(threshold)), 0)
    return (
        sets.select(*name_key).distinct().withColumn("e_words", F.split("e_key", " "))
        .withColumn("needed", needed).filter(F.col("needed").isNotNull())
        .select(*name_key, "needed", F.size("e_words").alias("n"), F.explode("e_words").alias("word"))
    )


def best_by_words(
    names: DataFrame, products: DataFrame, threshold: float, group: list[str], exclude: bool = False
) -> DataFrame:
    """Best product per name: highest share of the name's words, the first product on a tie.

    names: group.., e_id, e_words, e_weight, e_exclude; products: group.., p_words, p_handle, p_ord
    (a unique LONG below 2^48). Returns group.., e_id, score, p_ord for scores >= ``threshold``.
    ``exclude`` skips the product whose handle is the name's ``e_exclude``.
    """
    name_key = [*group, "e_key", "e_weight", "e_exclude"]
    sets = names.withColumn("e_key", _key(F.col("e_words"))).filter("e_key != ''")
    words_of_key = F.split("e_key", " ")
    share = lambda k, n: k / n * F.col("e_weight")
    wanted = _wanted(sets, name_key, threshold)
    titles = _distinct_titles(products, group, 2 if exclude else 1)
    title_words = titles.select("*", F.explode("p_words").alias("word"))
    allowed = ~F.col("p_handle").eqNullSafe(F.col("e_exclude")) if exclude else F.lit(True)

    # Per word: how many titles have it, and which come first. Both are plain aggregates, and the
    # first title is the answer for names of a single word.
    frequency = title_words.groupBy(*group, "word").agg(
        F.count("*").alias("df"), F.min("p_ord").alias("first_ord")
    )
    known = wanted.join(frequency, [*group, "word"], "left").withColumn(
        "df", F.coalesce("df", F.lit(0))
    )
    if exclude:
        first_handles = top_per_group(
            title_words.groupBy(*group, "word", "p_handle").agg(F.min("p_ord").alias("p_ord")),
            [*group, "word"],
            [F.col("p_ord")],
            2,
        )
        single = wanted.filter("n = 1").join(first_handles, [*group, "word"]).filter(allowed)
    else:
        single = known.filter("n = 1 AND df > 0").withColumn("p_ord", F.col("first_ord"))
    single_best = single.select(*name_key, "n", F.col("p_ord").alias("packed"))

    # Longer names: join on their n - needed + 1 rarest words.
    parts = (F.col("df") / SPLIT).cast("int") + 1
    probes = (
        known.filter("n > 1").groupBy(*name_key, "needed", "n")
        .agg(F.array_sort(F.collect_list(F.struct("df", "word"))).alias("ranked"))
        .withColumn("probe", F.explode(F.slice("ranked", F.lit(1), F.col("n") - F.col("needed") + 1)))
        .select(*name_key, "n", "probe.word", "probe.df")
        .filter("df > 0")
    )
    spread = probes.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).withColumn(
        "e_words", words_of_key
    )
    split_words = probes.groupBy(*group, "word").agg(F.max(parts).alias("parts"))
    targets = title_words.join(split_words, [*group, "word"]).withColumn(
        "part", F.pmod(F.xxhash64("p_key"), F.col("parts")).cast("int")
    )
    pairs = spread.join(
        targets.select(*group, "word", "part", "p_words", "p_handle", "p_ord"),
        [*group, "word", "part"],
    ).filter(allowed)
    overlap = F.size(F.array_intersect("e_words", "p_words"))
    pair_best = pairs.select(
        *name_key, "n", _packed(F.col("n") - overlap, F.col("p_ord")).alias("packed")
    )
    best = (
        pair_best.unionByName(single_best).groupBy(*name_key, "n")
        .agg(F.min("packed").alias("packed"))
        .withColumn("score", share(F.col("n") - _missing(F.col("packed")), F.col("n")))
        .withColumn("p_ord", _order(F.col("packed")))
        .filter(F.col("score") >= threshold)
    )
    return sets.join(best, name_key).select(*group, "e_id", "score", "p_ord")


def best_by_text(
    names: DataFrame, products: DataFrame, group: list[str], exclude: bool = False
) -> DataFrame:
    """Names that have no significant word still match a title with the very same text."""
    wordless = names.filter((F.size("e_words") == 0) & (F.col("e_text") != ""))
    texts = products.withColumnRenamed("p_text", "e_text")
    if exclude:
        firsts = top_per_group(
            texts.groupBy(*group, "e_text", "p_handle").agg(F.min("p_ord").alias("p_ord")),
            [*group, "e_text"],
            [F.col("p_ord")],
            2,
        )
        hits = wordless.join(firsts, [*group, "e_text"]).filter(
            ~F.col("p_handle").eqNullSafe(F.col("e_exclude"))
        )
    else:
        firsts = texts.groupBy(*group, "e_text").agg(F.min("p_ord").alias("p_ord"))
        hits = wordless.join(firsts, [*group, "e_text"])
    return hits.select(*group, "e_id", F.col("e_weight").alias("score"), "p_ord")


def _best_of(legs: list[DataFrame], group: list[str], threshold: float) -> DataFrame:
    out = legs[0].select(*group, "e_id", "score", "p_ord")
    for leg in legs[1:]:
        out = out.unionByName(leg.select(*group, "e_id", "score", "p_ord"))
    best = F.max(F.struct(F.col("score"), (-F.col("p_ord")).alias("o"))).alias("b")
    return (
        out.groupBy(*group, "e_id").agg(best)
        .select(*group, "e_id", F.col("b.score").alias("score"), (-F.col("b.o")).alias("p_ord"))
        .filter(F.col("score") >= threshold)
    )


def _texts(
    df: DataFrame, keys: list[Column], texts: list[tuple[str, Column, float]], normal, words, side: str
) -> DataFrame:
    """One row per text of a name or product: what it is matched with, its weight, its words."""
    kinds = F.array(
        *[
            F.struct(F.lit(kind).alias("kind"), text.alias("text"), F.lit(weight).alias("weight"))
            for kind, text, weight in texts
        ]
    )
    rows = df.select(*keys, F.explode(kinds).alias("t")).withColumn(
        f"{side}_text", normal(F.coalesce("t.text", F.lit("")))
    )
    rows = rows.withColumn("kind", F.col("t.kind")).withColumn("e_weight", F.col("t.weight")).drop("t")
    return rows.withColumn(f"{side}_words", words(F.col(f"{side}_text")))


def _names(entities: DataFrame, group: list[str], texts, normal, words, exclude: Column) -> DataFrame:
    keys = [*[F.col(g) for g in group], F.col("entity_id").alias("e_id"), exclude.alias("e_exclude")]
    return _texts(entities, keys, texts, normal, words, "e")


def _listings(products: DataFrame, group: list[str], texts, normal, words) -> DataFrame:
    keys = [
        *[F.col(g) for g in group], _fitting(F.col("product_ord")).alias("p_ord"), F.col("handle").alias("p_handle")
    ]
    rows = [(kind, text, 1.0) for kind, text in texts]
    return _texts(products, keys, rows, normal, words, "p").drop("e_weight")


def _ids(column: str) -> Column:
    return N.dashes_to_blanks(F.col(column).cast("string"))


def _with_product(best: DataFrame, products: DataFrame, group: list[str]) -> DataFrame:
    chosen = products.select(*group, F.col("product_ord").alias("p_ord"), "handle", "title")
    return best.join(chosen, [*group, "p_ord"])


def best_matches(
    entities: DataFrame,
    products: DataFrame,
    threshold: float = FV.MATCH_THRESHOLD,
    group: list[str] | None = None,
) -> DataFrame:
    """Best listing per entity: its name against titles, its botanical name at 0.8, its id against
    handles at 0.9.

    entities: [group..,] entity_id, name, botanical; products: [group..,] product_ord, title,
    handle. ``group`` (such as the seller) keeps matching within one group.
    """
    group = group or []
    best = best_pairs(match_names(entities, group), match_listings(products, group), threshold, group)
    return with_listing(best, products, group)


def match_names(entities: DataFrame, group: list[str]) -> DataFrame:
    """One row per text of an entity that ``best_matches`` compares."""
    return _names(
        entities, group,
        [("title", F.col("name"), 1.0), ("title", F.col("botanical"), 0.8), ("handle", _ids("entity_id"), 0.9)],
        N.match_text, N.match_words, F.lit(""),
    )


def match_listings(products: DataFrame, group: list[str]) -> DataFrame:
    """One row per text of a listing that ``best_matches`` compares."""
    return _listings(
        products, group, [("title", F.col("title")), ("handle", _ids("handle"))],
        N.match_text, N.match_words,
    )


def best_pairs(names: DataFrame, listings: DataFrame, threshold: float, group: list[str]) -> DataFrame:
    """group.., e_id, score, p_ord: the best listing of every name that has one."""
    by = [*group, "kind"]
    legs = [best_by_words(names, listings, threshold, by), best_by_text(names, listings, by)]
    return _best_of(legs, group, threshold)


def with_listing(best: DataFrame, products: DataFrame, group: list[str]) -> DataFrame:
    """The rows of ``best_pairs`` as ``best_matches`` gives them."""
    best = _with_product(best, products, group)
    return best.select(
        *group,
        F.col("e_id").alias("entity_id"),
        "handle",
        "title",
        F.bround("score", 2).alias("score"),
        confidence_band(F.bround("score", 2)).alias("band"),
    )


def _gram_length(scale: Column) -> Column:
    """Three quarters of the scale's window, so two grams or more fit into a window of four."""
    return F.when(scale < 4, scale).otherwise((scale * 3 / 4).cast("int"))


def _scales(text: Column) -> Column:
    """The powers of two that are at most the text's length (not 0)."""
    last = F.floor(F.log2(F.length(text) + F.lit(0.5))).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.pow(F.lit(2), k).cast("int"))


def _window_keys(text: Column, scale: Column) -> Column:
    """The keys of all windows of ``scale`` characters: the least hash of a window's grams. A text's windows are also windows
    of every text around it, so they have the same keys there."""
    q = _gram_length(scale)
    hashes = F.transform(F.sequence(F.lit(1), F.length(text) - q + 1), lambda i: F.xxhash64(scale, F.substr(text, i, q)))
    windows = F.transform(
        F.sequence(F.lit(1), F.length(text) - scale + 1), lambda i: F.array_min(F.slice(hashes, i, scale - q + 1))
    )
    return F.array_distinct(F.when(F.length(text) >= scale, windows).otherwise(F.array().cast("array<bigint>")))


def containment_candidates(short: DataFrame, long: DataFrame) -> DataFrame:
    """(s_id, s_text, l_id, l_text): pairs that share the rarest window key of the short text.

    A key stands for at least three eighths of the short text, so a common piece of a few letters brings no candidates. Long
    texts are filed under their distinct window keys, fewer than they have letters, and only for window lengths in use.
    """
    wanted = short.select("s_id", "s_text", F.element_at(_scales(F.col("s_text")), -1).alias("scale"))
    scales = wanted.agg(F.array_sort(F.collect_set("scale"))).scalar()
    wanted = wanted.select("s_id", "s_text", F.explode(_window_keys(F.col("s_text"), F.col("scale"))).alias("key"))
    fitting = F.array_intersect(_scales(F.col("l_text")), scales)
    filed = long.select("l_id", "l_text", F.explode(fitting).alias("scale"))
    have = filed.select("l_id", "l_text", F.explode(_window_keys(F.col("l_text"), F.col("scale"))).alias("key")).join(
        wanted.select("key").distinct(), "key", "left_semi"
    )
    frequency = have.groupBy("key").agg(F.count("*").alias("df"))
    parts = (F.col("df") / SPLIT).cast("int") + 1
    rarest = (
        wanted.join(frequency, "key", "left")
        .groupBy("s_id", "s_text")
        .agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "key")).alias("g"))
        .select("s_id", "s_text", "g.key", "g.df")
        .filter("df > 0")
    )
    probes = rarest.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    split = rarest.select("key", parts.alias("parts")).distinct()
    targets = have.join(split, "key").withColumn(
        "part", F.pmod(F.xxhash64("l_text"), F.col("parts")).cast("int")
    )
    return probes.join(targets, ["key", "part"]).select("s_id", "s_text", "l_id", "l_text")


def containing(short: DataFrame, long: DataFrame) -> DataFrame:
    """Pairs (s_id, l_id) where the long text contains the short one, character for character.

    short: s_id, s_text; long: l_id, l_text; texts distinct and not empty. Every candidate is compared in full.
    """
    pairs = containment_candidates(short, long)
    return pairs.filter(F.col("l_text").contains(F.col("s_text"))).select("s_id", "l_id")


def _substring_leg(entities: DataFrame, products: DataFrame, weight: float) -> DataFrame:
    """Entity text inside product text or the other way round. An empty text is inside any."""
    texts = entities.select("e_id", "e_text")
    listing = products.groupBy("p_text").agg(F.min("p_ord").alias("p_ord"))
    e_distinct = texts.filter("e_text != ''").select(F.col("e_text")).distinct()
    p_filled = listing.filter("p_text != ''")
    inside = containing(
        e_distinct.select(F.col("e_text").alias("s_id"), F.col("e_text").alias("s_text")),
        p_filled.select(F.col("p_ord").alias("l_id"), F.col("p_text").alias("l_text")),
    ).select(F.col("s_id").alias("e_text"), F.col("l_id").alias("p_ord"))
    around = containing(
        p_filled.select(F.col("p_ord").alias("s_id"), F.col("p_text").alias("s_text")),
        e_distinct.select(F.col("e_text").alias("l_id"), F.col("e_text").alias("l_text")),
    ).select(F.col("l_id").alias("e_text"), F.col("s_id").alias("p_ord"))
    firsts = inside.unionByName(around).groupBy("e_text").agg(F.min("p_ord").alias("p_ord"))
    by_text = texts.join(firsts, "e_text").select("e_id", "p_ord")
    # Empty texts: the first product with one, and the first of all, as scalar subqueries.
    first = lambda df: df.agg(F.min("p_ord")).scalar()
    with_first = lambda df, rows: df.select("e_id", first(rows).alias("p_ord")).filter("p_ord IS NOT NULL")
    any_entity = with_first(texts, listing.filter("p_text = ''"))
    blank_entity = with_first(texts.filter("e_text = ''"), listing)
    return by_text.unionByName(any_entity).unionByName(blank_entity).withColumn(
        "score", F.lit(weight)
    )


def best_matches_wide(
    entities: DataFrame, products: DataFrame, threshold: float = FV.WIDE_MATCH_THRESHOLD
) -> DataFrame:
    """The wider matcher: name against title and handle, id against handle, botanical name at 0.7,
    and 0.9 where id and handle contain one another."""
    title = F.coalesce("title", F.lit(""))
    names = _names(
        entities, [],
        [
            ("title", F.col("name"), 1.0), ("handle", F.col("name"), 1.0),
            ("handle", _ids("entity_id"), 1.0), ("title", F.col("botanical"), 0.7),
        ],
        N.slug_text, N.wide_words, F.lit(""),
    )
    listings = _listings(
        products, [], [("title", title), ("handle", _ids("handle"))], N.slug_text, N.wide_words
    )
    ids = entities.select(
        F.col("entity_id").alias("e_id"), N.slug_text(_ids("entity_id")).alias("e_text")
    )
    handles = products.select(
        _fitting(F.col("product_ord")).alias("p_ord"), N.slug_text(_ids("handle")).alias("p_text")
    )
    legs = [
        best_by_words(names, listings, threshold, ["kind"]),
        _substring_leg(ids, handles, 0.9),
    ]
    best = _with_product(_best_of(legs, [], threshold), products, [])
    return best.select(
        F.col("e_id").alias("entity_id"), "handle", "title", F.bround("score", 3).alias("score")
    )


def best_replacement(
    broken: DataFrame,
    catalog: DataFrame,
    products: DataFrame,
    snapshot: DataFrame,
    variant_prices: DataFrame,
    threshold: float = FV.MATCH_THRESHOLD,
) -> DataFrame:
    """A new listing for each broken link, at the same seller and with another handle, together
    with the prices known before and the candidate's prices.

    broken: seller_id, entity_id, old_handle; catalog: entity_id, name, botanical; products:
    seller_id, product_ord, title, handle; snapshot: price_snapshot rows; variant_prices:
    seller_id, handle, variant_prices.
    """
    group = ["seller_id"]
    by = [*group, "kind"]
    named = broken.select("seller_id", "entity_id", "old_handle").join(catalog, "entity_id")
    names = _names(
        named, group, [("title", F.col("name"), 1.0), ("title", F.col("botanical"), 0.8)],
        N.match_text, N.match_words, F.coalesce("old_handle", F.lit("")),
    )
    listings = _listings(products, group, [("title", F.col("title"))], N.match_text, N.match_words)
    legs = [
        best_by_words(names, listings, threshold, by, exclude=True),
        best_by_text(names, listings, by, exclude=True),
    ]
    best = _with_product(_best_of(legs, group, threshold), products, group)
    old = snapshot.groupBy("seller_id", "entity_id").agg(
        F.map_from_entries(F.collect_list(F.struct("tier", "price"))).alias("old_prices")
    )
    found = best.withColumnRenamed("e_id", "entity_id")
    return (
        named.join(found, ["seller_id", "entity_id"])
        .join(old, ["seller_id", "entity_id"], "left")
        .join(variant_prices, ["seller_id", "handle"], "left")
        .select(
            "seller_id",
            "entity_id",
            "old_handle",
            F.col("handle").alias("candidate_handle"),
            F.col("title").alias("candidate_title"),
            F.bround("score", 2).alias("match_score"),
            F.col("name").alias("common_name"),
            F.col("botanical").alias("botanical_name"),
            "old_prices",
            F.col("variant_prices").alias("candidate_prices"),
        )
    )


def coverage_cut(candidates: DataFrame, matches: DataFrame, min_sellers: int = 2) -> DataFrame:
    """Sellers found per candidate; a candidate without matches stays, with zero."""
    found = matches.groupBy("entity_id").agg(
        F.count_distinct("seller_id").alias("n"),
        F.array_sort(F.collect_set("seller_id")).alias("sellers"),
    )
    return (
        candidates.select("entity_id").join(found, "entity_id", "left")
        .select(
            "entity_id",
            F.coalesce("n", F.lit(0)).alias("seller_count"),
            F.coalesce("sellers", F.array().cast("array<string>")).alias("sellers"),
        )
        .withColumn("verdict", F.when(F.col("seller_count") >= min_sellers, "PASS").otherwise("FAIL"))
    )
