"""Product url helpers."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from offerlens.functions.text import strip_chars


def handle_from_url(url: Column) -> Column:
    """Store handle: what follows the last ``/products/``, without query, fragment or ``.json``."""
    path = F.substring_index(F.substring_index(url, "?", 1), "#", 1)
    handle = strip_chars(F.substring_index(path, "/products/", -1), "/")
    bare = F.regexp_replace(handle, r"\.json$", "")
    return F.when(path.contains("/products/") & (bare != ""), bare)


def base_url(url: Column) -> Column:
    return F.substring_index(url, "?variant=", 1)


def variant_url(url: Column, variant_id: Column) -> Column:
    """Deep link to one size; the bare url if the size has no id."""
    base = base_url(url)
    known = F.coalesce(variant_id.cast("string"), F.lit("")) != ""
    return F.when(known, F.concat(base, F.lit("?variant="), variant_id.cast("string"))).otherwise(base)


def product_url(base: Column, handle: Column, category: Column | None = None) -> Column:
    """Canonical product page; null without a handle. Some sellers file products by category."""
    folder = F.lit("/products/")
    if category is not None:
        folder = F.when(
            category.isNotNull(), F.concat(F.lit("/products/"), category, F.lit("/"))
        ).otherwise(folder)
    return F.when(F.coalesce(handle, F.lit("")) != "", F.concat(base, folder, handle))
