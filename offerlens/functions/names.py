"""Name normalisers and scores for matching."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from offerlens.functions import fixed_values as FV
from offerlens.functions.text import any_of, let, squeeze, strip, words


def match_text(c: Column) -> Column:
    """Lower-case name without marketing words, marks and bracketed text. Words are dropped as
    substrings, so "street" loses "tree"; that is part of the rule."""
    t = F.lower(strip(c))
    for sub in FV.MATCH_DROP_SUBSTRINGS:
        t = F.replace(t, F.lit(sub), F.lit(""))
    t = F.regexp_replace(t, "[®™©]", "")
    return squeeze(F.regexp_replace(t, r"\([^)]*\)", ""))


def slug_text(c: Column) -> Column:
    """Second normaliser: letters, digits and single blanks only."""
    t = F.regexp_replace(F.lower(strip(c)), "[®™©']", "")
    t = F.replace(t, F.lit("&"), F.lit("and"))
    return squeeze(F.regexp_replace(t, "[^a-z0-9 ]", " "))


def match_words(normalised: Column) -> Column:
    return F.array_except(words(normalised), any_of(FV.MATCH_NOISE_WORDS))


def wide_words(normalised: Column) -> Column:
    return F.array_except(words(normalised), any_of(FV.WIDE_NOISE_WORDS))


def overlap_score(name_words: Column, title_words: Column) -> Column:
    """Share of the name's words found in the title."""
    n = F.size(name_words)
    return F.when(n > 0, F.size(F.array_intersect(name_words, title_words)) / n).otherwise(0.0)


def match_score(name: Column, title: Column) -> Column:
    blank = F.lit("")
    pair = F.struct(
        F.coalesce(match_text(name), blank).alias("n"), F.coalesce(match_text(title), blank).alias("t")
    )
    return let(
        pair,
        lambda p: F.when((p.n == "") | (p.t == ""), 0.0)
        .when(p.n == p.t, 1.0)
        .otherwise(overlap_score(match_words(p.n), match_words(p.t))),
    )


def dashes_to_blanks(c: Column) -> Column:
    return F.replace(c, F.lit("-"), F.lit(" "))
