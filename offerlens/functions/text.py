"""Small text helpers shared by the normalisers and the extraction jobs."""
from __future__ import annotations

from html.entities import html5

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE_SPACE = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())


def strip(c: Column) -> Column:
    """Trim any white space, including tabs, line ends and no-break spaces."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def strip_named(c: Column) -> Column:
    """``strip`` for a column that costs nothing to name again: texts that start and end with a printable ASCII character,
    as nearly all do, are not searched for white space."""
    last = F.substring(c, -1, 1)
    return F.when((c >= "!") & (c < "\x7f") & (last >= "!") & (last < "\x7f"), c).otherwise(strip(c))


def strip_chars(c: Column, chars: str) -> Column:
    return F.btrim(c, F.lit(chars))


def squeeze(c: Column) -> Column:
    """White-space runs become one blank; ends are trimmed."""
    return F.btrim(F.regexp_replace(c, r"(?U)\s+", " "))


def first_group(c: Column, pattern: str, group: int = 1) -> Column:
    """``regexp_extract`` that yields null (not '') when nothing was found, in one scan."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def all_groups(c: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def number(c: Column) -> Column:
    return c.try_cast("double")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, with ``value`` computed once however often ``body`` uses it.

    The finish of an aggregate over nothing: an element of a transformed array would work out its type for every row.
    """
    return F.aggregate(F.array(), value, lambda v, _: v, lambda v: body(v))


def _sql_literal(v) -> str:
    if isinstance(v, str):
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return str(v)


def literal_map(values: dict) -> Column:
    return F.expr(f"map({', '.join(_sql_literal(x) for kv in values.items() for x in kv)})")


def lookup(values: dict, key: Column) -> Column:
    """Literal table lookup; null when the key is absent or null."""
    return F.when(key.isNotNull(), F.try_element_at(literal_map(values), key))


def any_of(items: list[str]) -> Column:
    return F.expr(f"array({', '.join(_sql_literal(x) for x in items)})")


def title_case(c: Column) -> Column:
    """Capital after every non-letter, so '12-18in' becomes '12-18In'."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    cased = F.transform(
        runs, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substr(x, F.lit(2))))
    )
    return F.array_join(cased, "")


def slug(c: Column) -> Column:
    return strip_chars(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "-")


def html_text(html: Column, joiner: str = " ") -> Column:
    return F.regexp_replace(html, "<[^>]+>", joiner)


_REFERENCE = r"&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"
# The standard library's table of named references; a non-breaking space is read as a space.
_NAMED = {name[:-1]: text for name, text in html5.items() if name.endswith(";")} | {"nbsp": " "}


def _character(code: Column) -> Column:
    """The character of a code point; the replacement character for ones that don't exist."""
    real = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    return F.when(real, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise("\ufffd")


def unescape(c: Column) -> Column:
    """Text with its character references read once, from left to right: named, decimal and hexadecimal ones.
    Unknown names stay as they are."""
    names = F.map_from_arrays(any_of(list(_NAMED)), any_of(list(_NAMED.values())))

    def read(ref: Column) -> Column:
        return (
            F.when(F.lower(F.left(ref, F.lit(2))) == "#x", _character(F.conv(F.substr(ref, F.lit(3)), 16, 10).cast("long")))
            .when(F.left(ref, F.lit(1)) == "#", _character(F.substr(ref, F.lit(2)).cast("long")))
            .otherwise(F.coalesce(F.element_at(names, ref), F.concat(F.lit("&"), ref, F.lit(";"))))
        )

    refs = F.transform(F.regexp_extract_all(c, F.lit(_REFERENCE), F.lit(1)), read)
    parts = F.zip_with(F.split(c, _REFERENCE, -1), refs, lambda text, char: F.concat(text, F.coalesce(char, F.lit(""))))
    return F.when(F.contains(c, F.lit("&")), F.array_join(parts, "")).otherwise(c)


def words(c: Column) -> Column:
    """Distinct blank-separated words."""
    return F.array_distinct(F.filter(F.split(c, " "), lambda w: w != ""))


def keep_last(items: Column, key: Callable[[Column], Column]) -> Column:
    """One element per key inside an array: the last one, placed where the key first appeared.

    That is what assigning into an insertion-ordered map leaves behind.
    """
    return _one_per_key(items, key, -1)


def keep_first(items: Column, key: Callable[[Column], Column]) -> Column:
    return _one_per_key(items, key, 1)


def _one_per_key(items: Column, key: Callable[[Column], Column], which: int) -> Column:
    def pick(rows: Column) -> Column:
        keys = F.array_distinct(F.transform(rows, key))
        return F.transform(keys, lambda k: F.element_at(F.filter(rows, lambda x: key(x) == k), which))

    return let(items, pick)


def first_nonempty(*arrays: Column) -> Column:
    """The first array that has elements; an empty one if none has."""
    out = arrays[-1]
    for a in reversed(arrays[:-1]):
        out = let(a, lambda x, rest=out: F.when(F.size(x) > 0, x).otherwise(rest))
    return out


def explode_found(df: DataFrame, keys: list, items: Column | str, item: str = "s") -> DataFrame:
    """One row per element with its position. The outer form is used, with empty rows dropped
    after it: for the plain form Spark adds a filter on the array and pushes it below the
    projections that build the array, which would evaluate all extraction twice or more."""
    return df.select(*keys, F.posexplode_outer(items).alias("pos", item)).filter(
        F.col("pos").isNotNull()
    )
