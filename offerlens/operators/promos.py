"""Promotion codes and banners out of page text."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens.functions import fixed_values as FV
from offerlens.functions.text import all_groups, any_of, explode_found, first_group, html_text, keep_first, let, squeeze
from offerlens.operators.state import replace_by_key

FOUND = "array<struct<kind:string,i:int,v:string>>"
MARK, MID, END = "\x01", "\x02", "\x03"


def promo_codes(text: Column) -> Column:
    """Codes in pattern order, upper-case, each once; at least four characters, not only digits."""
    found = F.concat(*[F.transform(all_groups(text, p), F.upper) for p in FV.PROMO_CODE_PATTERNS])
    return F.array_distinct(F.filter(found, lambda c: (F.length(c) >= 4) & ~c.rlike(r"^\d+$")))


def promo_banners(text: Column) -> Column:
    """Banner texts in pattern order, each once whatever its case."""
    found = F.concat(*[F.transform(all_groups(text, p, 0), lambda b: F.trim(b)) for p in FV.PROMO_BANNER_PATTERNS])
    return keep_first(found, F.lower)


def promo_signals(pages: DataFrame, html: str = "html") -> DataFrame:
    """Pages with their codes and banners."""
    text = F.regexp_replace(html_text(F.col(html)), r"\s+", " ")
    return (
        pages.withColumn("_text", text)
        .withColumn("codes", promo_codes(F.col("_text")))
        .withColumn("banners", promo_banners(F.col("_text")))
        .drop("_text")
    )


def _matches_in_context(text: Column, pattern: str, before: int, after: int) -> Column:
    """All matches of a pattern as (code, description): the description is the match with some
    characters around it. Matches are marked and the text is cut at the marks; one pass over the
    pieces adds up where each match stands, and descriptions are cut out of the text itself."""
    marked = F.regexp_replace(text, pattern, f"{MARK}$0{MID}$1{END}")
    spots_type = "array<struct<at:int,n:int,code:string>>"

    def step(acc: Column, piece: Column) -> Column:
        match_length = F.length(F.substring_index(piece, MID, 1))
        code = F.substring_index(F.substring_index(piece, MID, -1), END, 1)
        spot = F.struct(acc["at"].alias("at"), match_length.alias("n"), code.alias("code"))
        past = acc["at"] + match_length + F.length(F.substring_index(piece, END, -1))
        return F.struct(past.alias("at"), F.concat(acc["spots"], F.array(spot)).alias("spots"))

    def cut(pieces: Column) -> Column:
        start = F.struct(
            F.length(F.get(pieces, F.lit(0))).alias("at"), F.array().cast(spots_type).alias("spots")
        )
        rest = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))
        spots = F.aggregate(rest, start, step, lambda acc: acc["spots"])
        return F.transform(spots, lambda m: F.struct(
            F.upper(m["code"]).alias("code"),
            squeeze(F.concat(
                F.substr(text, F.greatest(m["at"] - before, F.lit(0)) + 1, F.least(m["at"], F.lit(before))),
                F.substr(text, m["at"] + 1, m["n"] + after),
            )).alias("description"),
        ))

    return let(F.split(marked, MARK), cut)


def banner_text(html: Column) -> Column:
    """Text of announcement bars and the header, then of the whole page."""
    bars = F.flatten(
        F.array(
            *[
                F.transform(
                    all_groups(html, rf'(?is)class="[^"]*{name}[^"]*"[^>]*>(.*?)</[a-z]+>'),
                    lambda b: squeeze(html_text(b)),
                )
                for name in FV.PROMO_BAR_CLASSES
            ]
        )
    )
    bars = F.filter(bars, lambda b: b != "")
    header = squeeze(html_text(first_group(html, "(?is)<header[^>]*>(.*?)</header>")))
    return F.concat_ws(" ", F.array_join(bars, " "), header, html_text(html))


def promo_signals_context(
    pages: DataFrame, html: str = "html", patterns: list[str] | None = None
) -> DataFrame:
    """One row per page and code with the text around it; a savings phrase where no code is found,
    cut to the 200 characters that are shown."""
    patterns = patterns or FV.CONTEXT_CODE_PATTERNS
    text = F.col("_text")
    found = F.concat(*[_matches_in_context(text, p, 20, 60) for p in patterns])
    valid = F.filter(
        found, lambda m: (F.length(m.code) >= 3) & ~F.array_contains(any_of(FV.CONTEXT_CODE_STOPLIST), m.code)
    )
    with_source = lambda items, source: F.transform(
        items,
        lambda m: F.struct(
            m.code.alias("code"), m.description.alias("description"), F.lit(source).alias("source")
        ),
    )
    savings = F.slice(_matches_in_context(text, FV.CONTEXT_SAVINGS_PATTERN, 10, 80), 1, 1)
    no_code = F.transform(
        savings,
        lambda m: F.struct(
            F.lit(None).cast("string").alias("code"), F.left(m.description, F.lit(200)).alias("description")
        ),
    )
    rows = (
        pages.withColumn("_text", banner_text(F.col(html)))
        .withColumn("_codes", keep_first(valid, lambda m: m.code))
        .withColumn(
            "_promos",
            F.when(F.size("_codes") > 0, with_source(F.col("_codes"), "text-pattern"))
            .otherwise(with_source(no_code, "savings-banner")),
        )
    )
    keep = [c for c in pages.columns if c != html]
    return explode_found(rows, keep, "_promos").select(*keep, "pos", "s.*")


def merge_page_promos(signals: DataFrame, order: str, keys: list[str]) -> DataFrame:
    """Union of the codes and banners of a seller's pages, each once, in page order.

    Values are made distinct with partial aggregation before they are listed, so a seller with very
    many pages arrives as its distinct values.
    """

    def values_of(kind: str) -> Column:
        return F.transform(kind, lambda v, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), v.alias("v")))

    def listed(kind: str) -> Column:
        found = F.collect_list(F.when(F.col("_kind") == kind, F.struct("_at", "_v")))
        return F.transform(F.array_sort(found), lambda x: x["_v"]).alias(kind)

    # one outer explode for both: it keeps pages without values, and a plain one would have Spark filter on the arrays below
    # the projections that build them, which extracts everything again
    both = F.concat(*[F.coalesce(values_of(kind), F.array().cast(FOUND)) for kind in ("codes", "banners")])
    seen = signals.select(*keys, order, F.explode_outer(both).alias("_s"))
    value = [F.col("_s.kind").alias("_kind"), F.col("_s.v").alias("_v")]
    first = seen.groupBy(*keys, *value).agg(F.min(F.struct(order, F.col("_s.i").alias("_i"))).alias("_at"))
    return first.groupBy(*keys).agg(listed("codes"), listed("banners"))


def update_promos(snapshot: DataFrame, merged: DataFrame, key: list[str]) -> DataFrame:
    """Promotion snapshot after a run: sellers checked again are replaced."""
    return replace_by_key(snapshot, merged, key)
