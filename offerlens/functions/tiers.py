"""Size tiers: free text -> tier, tier -> canonical tier, label and rank."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from offerlens.functions import fixed_values as FV
from offerlens.functions.text import any_of, let, lookup, slug, strip, strip_chars, strip_named, title_case

RAW_ID = r"^\d{7,}$"
UNICODE = "(?U)"


def _cleaned_title(title: Column) -> Column:
    """Lower-case title without plant counts and shipping notes. Patterns run only where their word is."""
    plants, *ships = FV.SIZE_NOISE_PATTERNS

    def without(c: Column, patterns: list[str]) -> Column:
        return reduce(lambda x, p: F.regexp_replace(x, UNICODE + p, ""), patterns, c)

    def stripped(c: Column) -> Column:
        return let(strip_named(c), lambda x: F.when(x.contains("/"), strip(strip_chars(x, "/"))).otherwise(x))

    no_ships = lambda c: F.when(c.contains("ship"), without(c, ships)).otherwise(c)
    no_plants = lambda c: F.when(c.contains("plant(s)"), without(c, [plants])).otherwise(c)
    lowered = let(title, lambda t: F.lower(strip_named(t)))
    return let(let(let(lowered, no_plants), no_ships), stripped)


def _whole(c: Column) -> Column:
    """Digits without leading zeros."""
    return F.regexp_replace(c, r"^0+(?=\d)", "")


def size_tier(title: Column) -> Column:
    """Tier of a free-text size title. The order of the rules is the meaning: a pot size wins
    over a height, a height over a grade, and only unknown text becomes a slug."""
    return let(_cleaned_title(title), _tier_of_clean_title)


def _tier_of_clean_title(t: Column) -> Column:
    has = lambda *subs: reduce(lambda a, b: a | b, [t.contains(s) for s in subs])
    all_of = lambda subs: reduce(lambda a, b: a & b, [t.contains(s) for s in subs])
    feet = has("ft", "feet", "foot", "'")
    pair = lambda pattern, unit: F.concat(
        _whole(F.regexp_extract(t, UNICODE + pattern, 1)),
        F.lit("-"),
        _whole(F.regexp_extract(t, UNICODE + pattern, 2)),
        F.lit(unit),
    )
    raw_pair = F.concat(
        F.regexp_extract(t, UNICODE + FV.FIELD_INCH_PATTERN, 1),
        F.lit("-"),
        F.regexp_extract(t, UNICODE + FV.FIELD_INCH_PATTERN, 2),
        F.lit("in"),
    )
    # made up from an id, as in most sizes of archived pages; first, as no other rule matches such a text
    by_id = t.startswith("variant-") & t.rlike(r"^variant-\d{7,}$")
    rules: list[tuple[Column, Column]] = [
        (all_of(needles) & t.rlike(UNICODE + pattern), F.lit(tier))
        for needles, (pattern, tier) in zip(FV.POT_NEEDLES, FV.POT_PATTERNS, strict=True)
    ]
    rules += [
        (has("dormant"), F.lit("bareroot")),
        (has("field") & t.rlike(UNICODE + FV.FIELD_INCH_PATTERN), raw_pair),
        (has("field"), F.lit("field")),
        (feet & t.rlike(UNICODE + FV.HEIGHT_RANGE_PATTERN), pair(FV.HEIGHT_RANGE_PATTERN, "ft")),
        (
            feet & t.rlike(UNICODE + FV.HEIGHT_SINGLE_PATTERN) & ~t.rlike("gal|container|quart"),
            F.concat(
                _whole(F.regexp_extract(t, UNICODE + FV.HEIGHT_SINGLE_PATTERN, 1)), F.lit("ft")
            ),
        ),
        (has("jumbo"), F.lit("jumbo-bareroot")),
        (has("premium"), F.lit("premium-bareroot")),
        (has("bare") & t.rlike(UNICODE + r"bare[\s-]?root"), F.lit("bareroot")),
        (has("ultra supreme", "ultra-supreme"), F.lit("ultra-supreme")),
        (has("supreme"), F.lit("supreme")),
        (has("semi-dwarf", "semi dwarf"), F.lit("semi-dwarf")),
        (has("dwarf"), F.lit("dwarf")),
        (has("standard"), F.lit("standard")),
        (has("bulb") & t.rlike(UNICODE + r"\bbulbs?\b"), F.lit("bulb")),
        ((t == "") | (t == "default title"), F.lit("default")),
    ]
    unknown = slug(t)
    fallback = F.when(unknown.rlike(RAW_ID), F.lit("default")).otherwise(unknown)
    chain = F.when(by_id, F.lit("default"))
    for condition, value in rules:
        chain = chain.when(condition, value)
    return chain.otherwise(fallback)


def rootstock_tier(desc: Column) -> Column:
    """Compound tier of a rootstock description: potted, else base grade plus how it is sold."""
    return let(F.lower(desc), _rootstock_of)


def _rootstock_of(t: Column) -> Column:
    semi = t.contains("semi-dwarf") | t.contains("semi dwarf")
    potted = (
        F.when(semi, "semi-dwarf-potted")
        .when(t.contains("dwarf"), "dwarf-potted")
        .otherwise("potted")
    )
    base = (
        F.when(t.contains("ultra supreme"), "ultra-supreme")
        .when(t.contains("supreme"), "supreme")
        .when(semi, "semi-dwarf")
        .when(t.contains("dwarf"), "dwarf")
        .when(t.contains("standard"), "standard")
    )
    sold_as = (
        F.when(t.contains("ez start") | t.contains("ez-start"), "-ez-start")
        .when(t.contains("bare"), "-bareroot")
        .otherwise("")
    )
    return F.when(t.contains("7 gal") | t.contains("potted"), potted).otherwise(
        F.coalesce(F.concat(base, sold_as), F.lit("default"))
    )


def canonical_tier(tier: Column) -> Column:
    named = let(F.lower(strip(tier)), lambda t: F.coalesce(lookup(FV.TIER_ALIASES, t), t))
    return let(
        named,
        lambda n: F.when(n.rlike(r"^(?:variant-)?\d{7,}$"), F.lit("default")).otherwise(n),
    )


def tier_label(tier: Column) -> Column:
    return let(
        canonical_tier(tier),
        lambda c: F.coalesce(
            lookup(FV.TIER_LABELS, c), title_case(F.replace(c, F.lit("-"), F.lit(" ")))
        ),
    )


def tier_rank(tier: Column) -> Column:
    """Sortable rank: position in the display order; tiers outside it come after, by name."""
    position = F.array_position(any_of(FV.TIER_ORDER), tier)
    return F.struct(
        F.when(position == 0, F.lit(len(FV.TIER_ORDER) + 1).cast("long")).otherwise(position)
        .alias("pos"),
        tier.alias("name"),
    )


def is_visible_tier(tier: Column) -> Column:
    return tier != FV.HIDDEN_TIER


def ships_season(raw_size: Column) -> Column:
    """Season named by "ships in ..." in a raw size text, capitalised; null if none."""
    return F.when(
        raw_size.rlike(FV.SHIPS_IN_PATTERN),
        F.initcap(F.regexp_extract(raw_size, FV.SHIPS_IN_PATTERN, 1)),
    )


def is_pack(title: Column) -> Column:
    """Variant titles that price several plants at once."""
    return let(F.lower(title), lambda t: (
        ((t.contains("plant") | t.contains("pack")) & title.rlike(FV.PACK_TITLE_PATTERN))
        | t.contains("bogo")
        | (t.contains("single") & t.contains("pack"))
    ))


def is_pack_label(name: Column) -> Column:
    """The page-label form of the same rule: any pack or single, whatever the count."""
    t = F.lower(name)
    return t.contains("pack") | t.contains("single") | t.rlike(r"^\d+-(?:pack|pk)")


def is_size_name(name: Column) -> Column:
    t = F.lower(name)
    return t.rlike("|".join([*FV.SIZE_NAME_KEYWORDS, FV.SIZE_NAME_PREFIX_PATTERN]))
