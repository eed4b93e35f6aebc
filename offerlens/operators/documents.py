"""Attributes out of product descriptions, and outlines of markdown guides."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens.functions import calendar as C
from offerlens.functions import fixed_values as FV
from offerlens.functions.text import all_groups, first_group, slug, strip, unescape


def description_text(html: Column) -> Column:
    """Visible text, tags as line ends."""
    shown = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", "")
    return unescape(F.regexp_replace(shown, "<[^>]+>", "\n"))


def table_cells(html: Column) -> Column:
    """Two-cell table rows as (key, value); keys lower-case."""
    cell = lambda c: strip(unescape(F.regexp_replace(c, r"\s*<[^>]+>\s*", "")))

    def entry(row: Column) -> Column:
        cells = all_groups(row, r"(?is)<td\b[^>]*>(.*?)</td>")
        return F.struct(
            F.size(cells).alias("n"),
            F.lower(cell(F.get(cells, 0))).alias("key"),
            cell(F.get(cells, 1)).alias("value"),
        )

    rows = F.transform(all_groups(html, r"(?is)<tr\b[^>]*>(.*?)</tr>"), entry)
    return F.filter(rows, lambda r: r.n >= 2)


def _cell(cells: Column, key: str) -> Column:
    """Value of a key; of a repeated key the last one."""
    return F.get(F.reverse(F.filter(cells, lambda r: r.key == key)), 0).value


def _first_cell(cells: Column, keys: list[str]) -> Column:
    return F.coalesce(*[_cell(cells, k) for k in keys])


def _phrase(text: Column, pattern: str) -> Column:
    found = F.regexp_replace(strip(first_group(text, pattern)), "[,.]+$", "")
    return F.when(F.length(found) > 2, found)


def attributes_from_html(products: DataFrame, keys: list[str], html: str = "body_html") -> DataFrame:
    """Zones, sun, size, bloom and type of a product description: table rows first, then labels in
    the text."""
    body = F.coalesce(F.col(html), F.lit(""))
    text, cells = F.col("_text"), F.col("_cells")
    zone_cell = _first_cell(cells, FV.ZONE_KEYS)
    listed = C.comma_ints(first_group(text, FV.ZONE_LIST_PATTERN))
    span = C.zone_range(
        first_group(text, FV.ZONE_RANGE_PATTERN, 1).cast("int"),
        first_group(text, FV.ZONE_RANGE_PATTERN, 2).cast("int"),
    )
    filled = lambda c: F.when(c != "", c)
    height = F.coalesce(
        filled(_first_cell(cells, FV.HEIGHT_KEYS[::-1])), strip(first_group(text, FV.HEIGHT_PATTERN))
    )
    width = F.coalesce(
        filled(_first_cell(cells, FV.WIDTH_KEYS[::-1])), strip(first_group(text, FV.WIDTH_PATTERN))
    )
    return (
        products.withColumn("_text", description_text(body)).withColumn("_cells", table_cells(body))
        .select(
            *keys,
            F.when(zone_cell.isNotNull(), C.zone_list(zone_cell))
            .otherwise(F.coalesce(F.when(F.size(listed) > 0, listed), span)).alias("zones"),
            F.coalesce(_first_cell(cells, FV.SUN_KEYS), strip(first_group(text, FV.SUN_PATTERN))).alias("sun"),
            C.mature_size(height, width).alias("mature_size"),
            F.coalesce(_first_cell(cells, FV.BLOOM_KEYS), _phrase(text, FV.BLOOM_PATTERN)).alias("bloom_time"),
            F.coalesce(_first_cell(cells, FV.TYPE_KEYS), _phrase(text, FV.TYPE_PATTERN)).alias("type"),
        )
    )


def document_outline(docs: DataFrame, name: str = "file_name", text: str = "value") -> DataFrame:
    """Title, slug, excerpt, table of contents and description of markdown documents."""
    body = F.col(text)
    lines = F.split(body, "\n")
    title = F.coalesce(first_group(body, r"^#\s+(.+)(?m)$"), F.col(name))
    first_h1 = F.array_position(F.transform(lines, lambda l: l.startswith("# ")), True)
    plain = F.filter(
        F.slice(lines, F.greatest(first_h1.cast("int") + 1, F.lit(1)), F.size(lines)),
        lambda l: (strip(l) != "") & ~l.startswith("*") & ~l.startswith("#"),
    )
    excerpt = F.when(
        first_h1 > 0, F.coalesce(F.left(strip(F.get(plain, 0)), F.lit(200)), F.lit(""))
    ).otherwise("")
    heads = F.transform(
        all_groups(body, r"(?m)^##\s+(.+?)(?:\s*\(.*?\))?\s*$"),
        lambda h: F.struct(slug(strip(h)).alias("id"), strip(h).alias("text")),
    )
    described = F.when(F.col("excerpt") != "", F.col("excerpt")).otherwise(
        F.concat(F.col("title"), F.lit(" - Compare prices across online nurseries."))
    )
    return (
        docs.withColumn("title", title).withColumn("excerpt", excerpt).withColumn("toc", heads)
        .withColumn("slug", F.replace(F.regexp_replace(name, r"^\d+-", ""), F.lit(".md"), F.lit("")))
        .withColumn("description", F.left(described, F.lit(160)))
        .drop(text)
    )
