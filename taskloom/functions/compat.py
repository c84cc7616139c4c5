"""Scalar semantics of the embedded-database dialect on Spark columns.

Where the dialect and ANSI SQL differ, these give the dialect's answer: integer division
truncates, division by zero is null, text that begins with a number casts to that number
and other text to 0, LIKE ignores the case of ASCII letters, bad dates are null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def int_div(a: Column, b: Column) -> Column:
    """a / b of integers, truncated towards zero; null by zero."""
    return F.when(b != 0, (F.signum(a) * F.signum(b)).cast("long") * F.call_function("div", F.abs(a), F.abs(F.nullif(b, F.lit(0)))))


def div(a: Column, b: Column) -> Column:
    """a / b as a double; null by zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def to_int(text: Column) -> Column:
    """The integer that a text begins with, else 0; null stays null."""
    lead = F.regexp_extract(text, r"^\s*([+-]?[0-9]+)", 1)
    return F.when(text.isNotNull(), F.coalesce(lead.try_cast("long"), F.lit(0)))


def like(text: Column, pattern: str) -> Column:
    return F.lower(text).like(pattern.lower())


def date_of(x: Column) -> Column:
    """Date of a date, timestamp or text; null where a text is no date."""
    return F.try_to_date(x.cast("string").substr(1, 10), "yyyy-MM-dd")


def start_of_month(x: Column) -> Column:
    return F.trunc(date_of(x), "MM")


def start_of_quarter(x: Column) -> Column:
    return F.trunc(date_of(x), "quarter")


def plus_months(x: Column, n: int) -> Column:
    """The end of a shorter month stands for days that it lacks."""
    return F.add_months(date_of(x), n)


def julian_days(later: Column, earlier: Column) -> Column:
    """Days between two times, with fractions."""
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(86_400_000_000.0)


def month_difference(later: Column, earlier: Column) -> Column:
    return (F.year(later) * 12 + F.month(later)) - (F.year(earlier) * 12 + F.month(earlier))


def decade(x: Column) -> Column:
    return F.call_function("div", F.year(x), F.lit(10)) * 10


def log10(x: Column) -> Column:
    """The dialect's LOG, which is to base 10; null outside its domain."""
    return F.when(x > 0, F.log10(x))


def concat(*parts: Column) -> Column:
    """The || operator: null if any part is."""
    return F.concat(*parts)


def missing(text: Column, sentinel: str = "\\N") -> Column:
    """A text sentinel as null."""
    return F.nullif(text, F.lit(sentinel))
