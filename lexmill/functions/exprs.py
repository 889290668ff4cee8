"""Column expressions shared by the operators; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Without white space of any kind at the ends; null counts as empty."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), "(?U)^\\s+|\\s+$", "")


def word_count(c: Column) -> Column:
    """Number of words between white space."""
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit("(?U)\\S+"))


def clamp(c: Column, least, most) -> Column:
    return F.least(F.greatest(c, F.lit(least)), F.lit(most))


def safe_int(c: Column) -> Column:
    """The value as a whole number, 0 where it isn't one."""
    return F.coalesce(F.try_to_number(F.regexp_extract(c.cast("string"), "^\\s*(-?\\d{1,18})\\s*$", 1), F.lit("S999999999999999999")), F.lit(0)).cast("bigint")


def rounded(c: Column, digits: int) -> Column:
    """Half-even rounding of the decimal rendering."""
    return F.bround(c, digits)


def lang_of(db: Column) -> Column:
    """The language part of a dictionary's name."""
    return F.lower(F.split_part(strip(db), F.lit("-"), F.lit(1)))


def ordered_distinct(items: Column, key) -> Column:
    """The first item of each key, in order; ``key`` maps an item to its key."""
    return F.filter(items, lambda x, i: F.array_position(F.transform(items, key), key(x)) == i + 1)
