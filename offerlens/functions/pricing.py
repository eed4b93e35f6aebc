"""Price and stock helpers."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def effective_was_price(price: Column, was: Column) -> Column:
    """The struck-through price, kept only if it is a real reduction."""
    w = was.try_cast("double")
    return F.when(w > price, w)


def sale_flag(was_price: Column) -> Column:
    return F.coalesce(was_price != 0, F.lit(False))


def positive_price(price: Column) -> Column:
    return F.coalesce(price > 0, F.lit(False))


def buyable(in_stock: Column) -> Column:
    """Stock has three states; unknown counts as buyable."""
    return ~in_stock.eqNullSafe(F.lit(False))


def savings_pct(low: Column, high: Column) -> Column:
    """Whole percent between two prices, halves to even."""
    return F.when(high > low, F.bround((1 - low / high) * 100)).otherwise(F.lit(0)).cast("int")


def has_affiliate(affiliate: Column, trust_builder: Column) -> Column:
    return affiliate.isNotNull() & ~trust_builder.eqNullSafe(F.lit(True))


def confidence_band(score: Column) -> Column:
    return F.when(score >= 0.8, "HIGH").when(score >= 0.6, "MED").otherwise("LOW")


def stock_text(unavailable: Column, in_stock: Column, season: Column) -> Column:
    shipped = F.when(
        F.coalesce(season, F.lit("")) != "",
        F.concat(F.lit("In Stock (Ships "), season, F.lit(")")),
    ).otherwise("In Stock")
    return (
        F.when(unavailable, "Currently Unavailable")
        .when(in_stock, shipped)
        .when(in_stock.isNull(), "—")
        .otherwise("Sold Out")
    )


def shipping_text(
    has_terms: Column, free_all: Column, free_threshold: Column, flat_rate: Column
) -> Column:
    """Shipping terms as shown to a shopper. A zero threshold or rate counts as not given."""
    return (
        F.when(~has_terms, "Check site")
        .when(free_all, "Free")
        .when(free_threshold != 0, F.concat(F.lit("Free over $"), free_threshold.cast("string")))
        .when(flat_rate != 0, F.concat(F.lit("$"), F.format_string("%.2f", flat_rate), F.lit(" flat")))
        .otherwise("Varies")
    )
