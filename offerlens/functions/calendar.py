"""Months, zones and dates."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from offerlens.functions import fixed_values as FV
from offerlens.functions.text import first_group, let, lookup, strip

MONTH_NUMBER = {m: i + 1 for i, m in enumerate(FV.MONTHS)}
OFFSET_PATTERN = r"(Z|[+-]\d{2}:?\d{2})$"


def bit(position: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1), position)


def month_range(text: Column) -> Column:
    """'Nov-Jan' -> [11, 12, 1]; a single month -> itself; unknown or missing text -> []."""
    named = F.transform(
        F.split(strip(F.coalesce(text, F.lit(""))), "[-–]"),
        lambda p: lookup(MONTH_NUMBER, F.substring(F.lower(strip(p)), 1, 3)),
    )
    return let(F.filter(named, lambda m: m.isNotNull()), _months_between)


def _months_between(months: Column) -> Column:
    first, last = F.get(months, 0), F.get(months, 1)
    return (
        F.when(last.isNull(), months)
        .when(first <= last, F.sequence(first, last))
        .otherwise(F.concat(F.sequence(first, F.lit(12)), F.sequence(F.lit(1), last)))
    )


def month_mask(text: Column) -> Column:
    """The same months as bits, so that windows of many rows union with ``bit_or``."""
    return F.aggregate(
        month_range(text), F.lit(0), lambda acc, m: acc.bitwiseOR(bit(m - 1))
    )


def mask_flags(mask: Column, slots: int = 12) -> Column:
    """Bits back to an array of booleans, first month first."""
    return F.array(*[mask.bitwiseAND(F.lit(1 << i)) != 0 for i in range(slots)])


def zone_range(low: Column, high: Column) -> Column:
    ok = low.between(1, 13) & high.between(1, 13) & (low <= high)
    return F.when(ok, F.sequence(low, high))


def comma_ints(text: Column) -> Column:
    parts = F.filter(F.transform(F.split(text, ","), strip), lambda x: x.rlike(r"^\d+$"))
    return F.array_sort(F.transform(parts, lambda x: x.cast("int")))


def zone_list(text: Column) -> Column:
    """'6-11', '6, 7, 8' or '7' -> sorted zones; null when no zone can be read."""
    return let(strip(text), _zones_in)


def _zones_in(t: Column) -> Column:
    listed = comma_ints(t)
    span = r"^(\d{1,2})\s*[-–to]+\s*(\d{1,2})"
    low = first_group(t, span, 1).cast("int")
    high = first_group(t, span, 2).cast("int")
    single = F.when(t.rlike(r"^\d+$"), t.try_cast("int"))
    return (
        F.when(t.contains(",") & (F.size(listed) > 0), listed)
        .when(zone_range(low, high).isNotNull(), zone_range(low, high))
        .when(single.between(1, 13), F.array(single))
    )


def _feet(size: Column) -> Column:
    s = F.regexp_replace(strip(size), r"\.+$", "")
    s = F.regexp_replace(s, r"(?i)\s*feet\b", " ft")
    s = F.regexp_replace(s, r"(\d)'", "$1 ft")
    s = F.replace(s, F.lit("ft."), F.lit("ft"))
    return F.regexp_replace(F.regexp_replace(s, r"(?i)(\d+)\s+to\s+(\d+)", "$1-$2"), r"(\d+)\s*–\s*(\d+)", "$1-$2")


def mature_size(height: Column, width: Column) -> Column:
    """'3 to 4 feet', "3'" -> '3-4 ft tall x 3 ft wide'; one side alone stays as it is."""

    def side(size: Column, word: str) -> Column:
        s = strip(F.regexp_replace(_feet(size), rf"(?i)\s*{word}\b", ""))
        return F.when(F.lower(s).contains("ft"), s).otherwise(F.concat(s, F.lit(" ft")))

    h = F.when(height != "", height)
    w = F.when(width != "", width)
    both = F.concat(side(h, "tall"), F.lit(" tall x "), side(w, "wide"), F.lit(" wide"))
    return F.coalesce(both, _feet(h), _feet(w))


SEASON_TABLES = {"perennial": FV.PERENNIAL_SEASONS, "tree": FV.TREE_SEASONS}


def season_calendar(zones: Column, kind: str = "perennial") -> Column:
    """Planting windows of each known zone, as map zone -> struct(spring, fall); others dropped."""
    table = F.create_map(
        *[
            x
            for zone, (spring, fall) in SEASON_TABLES[kind].items()
            for x in (
                F.lit(str(zone)),
                F.struct(
                    F.lit(spring).cast("string").alias("spring"),
                    F.lit(fall).cast("string").alias("fall"),
                ),
            )
        ]
    )
    known = F.filter(
        F.transform(F.array_distinct(zones), lambda z: z.cast("string")),
        lambda z: F.map_contains_key(table, z),
    )
    return F.map_from_arrays(known, F.transform(known, lambda z: F.try_element_at(table, z)))


def stated_date(stamp: Column) -> Column:
    """The date as written in an ISO stamp, whatever its offset; null if the stamp is not valid."""
    return F.when(
        stamp.rlike(r"^\d{4}-\d{2}-\d{2}") & stamp.try_cast("timestamp").isNotNull(),
        F.substring(stamp, 1, 10).try_cast("date"),
    )


def instant(stamp: Column) -> Column:
    """The instant of an ISO stamp that states its offset; null without one."""
    return F.when(stamp.rlike(OFFSET_PATTERN), stamp.try_cast("timestamp"))


def long_date(stamp: Column) -> Column:
    return F.coalesce(F.date_format(stated_date(stamp), "MMMM dd, yyyy"), F.lit(""))


def feedback_labels(category: Column, status: Column) -> tuple[Column, Column]:
    return (
        F.coalesce(lookup(FV.FEEDBACK_CATEGORY_LABELS, category), F.lit("Other")),
        F.coalesce(lookup(FV.FEEDBACK_STATUS_LABELS, status), F.lit("Under Review")),
    )
