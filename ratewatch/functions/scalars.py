"""Parsing, formatting and guarding of single values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that is cut from the ends of texts.
BLANKS = " \t\r\n"


def day_first_date(s: Column) -> Column:
    """A date from day/month/year."""
    return F.try_to_timestamp(s, F.lit("dd/MM/yyyy")).cast("date")


def decimal_number(s: Column, decimal: str = ",", thousands: str | None = None) -> Column:
    """A number whose decimal sign may be a comma. With ``thousands``, that sign is dropped first."""
    if thousands:
        s = F.replace(s, F.lit(thousands), F.lit(""))
    return F.replace(s, F.lit(decimal), F.lit(".")).try_cast("double")


def iso_instant(s: Column) -> Column:
    """A timestamp from ISO 8601, with a zone or Z."""
    return F.try_to_timestamp(s)


def published_at(s: Column, run_ts: Column) -> Column:
    """When an article came out: a feed's date (day month year time zone) or ISO 8601; the run's time if neither."""
    plain = F.regexp_replace(F.regexp_replace(F.btrim(s), r"^[A-Za-z]+,\s*", ""), r"\s*(GMT|UTC|UT|Z)$", " +0000")
    feed = F.coalesce(F.try_to_timestamp(plain, F.lit("d MMM yyyy HH:mm:ss xx")), F.try_to_timestamp(plain, F.lit("d MMM yyyy HH:mm xx")))
    return F.coalesce(feed, iso_instant(s), run_ts)


def any_keyword(text: Column, keywords: list[str]) -> Column:
    """Whether the lower-cased text has one of the (lower-case) keywords anywhere, inside words too."""
    low = F.lower(text)
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(k)) for k in keywords], F.lit(False))


def prefix(s: Column, n: int) -> Column:
    """The first n code points."""
    return F.substring(s, 1, n)


def percent_change(now: Column, then: Column) -> Column:
    """In percent to two places; null if there is nothing to compare with, or that is zero."""
    return F.round(F.try_divide(now - then, then) * 100, 2)


def guarded_ratio(error: Column, actual: Column, tiny: float = 1e-9) -> Column:
    """error / actual, with a tiny number in the place of zero."""
    return error / F.when(actual != 0, actual).otherwise(F.lit(tiny))


def money(x: Column, places: int = 2) -> Column:
    """With a comma for thousands; rounded half up first."""
    return F.format_string(f"%,.{places}f", F.round(x, places))


def signed(x: Column, places: int = 2) -> Column:
    """With its sign; rounded half up first."""
    return F.format_string(f"%+.{places}f", F.round(x, places))


def tidy(s: Column) -> Column:
    """Without white space at its ends (newlines too)."""
    return F.btrim(s, F.lit(BLANKS))


def split_once(s: Column, mark: str = "---") -> tuple[Column, Column]:
    """What stands before and after the first mark (an empty text if there is none), both tidied."""
    parts = F.split(s, mark, 2)
    return tidy(parts[0]), F.coalesce(tidy(F.try_element_at(parts, F.lit(2))), F.lit(""))


def is_true(flag: Column) -> Column:
    """A flag that may be missing."""
    return F.coalesce(flag, F.lit(False))


def map_value(m: Column, key: str, default: str | None = None) -> Column:
    found = F.try_element_at(m, F.lit(key))
    return found if default is None else F.coalesce(found, F.lit(default))
