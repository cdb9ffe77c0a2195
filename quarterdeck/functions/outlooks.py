"""Cleaning and comparison of rating letters and outlooks, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Entries that are no long-term rating, and the designations of default.
NOT_RATED = ("NR",)
SHORT_TERM = ("NP", "P-1", "P-2", "P-3", "P1", "P2", "P3")
DEFAULTS = ("SD", "RD", "D")
WATCH = r"(?i)\b(under\s+review|watch|review)\b"


def stripped(value: Column) -> Column:
    """Outer blanks removed; blank becomes NULL."""
    return F.nullif(F.trim(value), F.lit(""))


def is_token(value: Column, tokens) -> Column:
    """Whether the trimmed upper-case value is one of the tokens; False for NULL."""
    return F.coalesce(F.upper(F.trim(value)).isin(*tokens), F.lit(False))


def without_provisional(rating: Column) -> Column:
    """``(P)B1`` becomes ``B1``."""
    return F.trim(F.regexp_replace(rating, r"^(?i)\(P\)\s*(?=.)", ""))


def is_provisional(rating: Column) -> Column:
    return F.coalesce(rating.rlike(r"^(?i)\(P\)\s*.+$"), F.lit(False))


# Fixed value: letters with an outlook in brackets behind them.
_EMBEDDED = r"^(.*?)\s*\(([^)]+)\)\s*$"


def letters_of(rating: Column) -> Column:
    """The letters in front of an embedded outlook; NULL if there are none."""
    bare = without_provisional(stripped(rating))
    return F.nullif(F.trim(F.when(bare.rlike(_EMBEDDED), F.regexp_extract(bare, _EMBEDDED, 1)).otherwise(bare)), F.lit(""))


def outlook_of(rating: Column, outlook: Column) -> Column:
    """The outlook, or else the one embedded in the rating."""
    bare = without_provisional(stripped(rating))
    return F.coalesce(stripped(outlook), F.nullif(F.trim(F.regexp_extract(bare, _EMBEDDED, 2)), F.lit("")))


def provenance(source: Column, rating: Column) -> Column:
    """The source, with a note if the rating was provisional."""
    return F.when(is_provisional(stripped(rating)), F.trim(F.concat(F.coalesce(source, F.lit("")), F.lit(" (provisional)")))).otherwise(source)


def normal_outlook(outlook: Column) -> Column:
    """NULL for a blank or an outlook of NR."""
    bare = stripped(outlook)
    return F.when(F.upper(bare) != "NR", bare)


def base_direction(outlook: Column) -> Column:
    """The outlook without its watch or review qualifier."""
    return F.trim(F.regexp_replace(F.regexp_replace(outlook, WATCH, ""), r"\s+", " "))


def on_watch(outlook: Column) -> Column:
    low = F.lower(outlook)
    return F.coalesce(low.contains("watch") | low.contains("review"), F.lit(False))


def outlooks_agree(a: Column, b: Column) -> Column:
    """A missing outlook agrees with any, two watches agree, and so do equal base directions. Not transitive."""
    x, y = F.lower(normal_outlook(a)), F.lower(normal_outlook(b))
    bx, by = base_direction(x), base_direction(y)
    return F.coalesce(x.isNull() | y.isNull() | (x == y) | (on_watch(x) & on_watch(y)) | ((bx != "") & (bx == by)), F.lit(True))


def agreement_ties(outlook: Column) -> Column:
    """What an outlook can agree by, as an array: two outlooks agree if either's is empty or they have one in common."""
    low = F.lower(normal_outlook(outlook))
    base = base_direction(low)
    ties = F.array_compact(F.array(F.concat(F.lit("="), low), F.when(on_watch(low), F.lit("watch")), F.when(base != "", F.concat(F.lit("~"), base))))
    return F.coalesce(F.when(low.isNotNull(), ties), F.array().cast("array<string>"))


def preferred_outlook(first: Column, second: Column) -> Column:
    """The first unless only the second is on watch; the other where one is missing."""
    x, y = normal_outlook(first), normal_outlook(second)
    return F.when(on_watch(y) & ~on_watch(x), y).otherwise(F.coalesce(x, y))
