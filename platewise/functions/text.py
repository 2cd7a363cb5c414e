"""Cleaning of padded, sentinel-ridden text fields. Bad text becomes NULL, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# Fixed value: blank, tab, LF, CR, FF, VT, next line, no-break space.
WHITE_SPACE = " \t\n\r\f\v\u0085\u00a0"


def stripped(text: Column) -> Column:
    """Text without white space around it."""
    return F.trim(text, F.lit(WHITE_SPACE))


def known(value: Column) -> Column:
    """The text, NULL where it is empty or a spelling of 'not a number'.

    The text stands here more than once: strip it in a projection before.
    """
    return F.when(~value.isin("", "NaN", "nan"), value)


def trimmed(text: Column) -> Column:
    """Both of the above; computes the stripped text twice."""
    return known(stripped(text))


def without(text: Column, literal: str) -> Column:
    """Remove every occurrence of a literal (not a pattern)."""
    return F.replace(text, F.lit(literal), F.lit(""))


def number(text: Column) -> Column:
    """Double from text, NULL when it is not a number.

    Any letter but the exponent's e makes it bad text: the cast alone would read
    'NaN', 'Infinity', '1.5d' and '0x1p3' as numbers. What ends in a digit and has no x
    is none of these, so that most texts go without the pattern.
    """
    plain = F.right(text, F.lit(1)).between("0", "9") & ~F.contains(text, F.lit("x")) & ~F.contains(text, F.lit("X"))
    return F.when(plain | ~text.rlike("[A-DF-Za-df-z]"), text.try_cast("double"))


def as_whole(value: Column) -> Column:
    """Integer from a double, NULL for a fraction or what an integer cannot hold."""
    return F.when(value == F.floor(value), value.try_cast("int"))


def whole(text: Column) -> Column:
    """Integer from text, by the same rule."""
    return as_whole(number(text))


def date_parts(date: Column) -> Column:
    """Trimmed 'dd-MM-yyyy' in three parts, as text."""
    return F.split(date, "-")


def clock_parts(clock: Column) -> Column:
    """Trimmed 'HH:mm:ss' in three whole numbers, NULL where a part is none.

    The lambda is deliberate: a projection that holds one is compiled apart, in a method for
    each of its columns. Behind twenty cleaned fields all that follows would be one method
    otherwise, longer than what the JVM compiles.
    """
    return F.transform(F.split(clock, ":"), lambda part: part.try_cast("int"))


def timestamp_of(date: Column, clock: Column) -> Column:
    """Timestamp without zone from the parts of a date and a clock; NULL if either is bad."""
    year, second = F.get(date, F.lit(2)), F.get(clock, F.lit(2))
    stamp = F.call_function(
        "try_make_timestamp_ntz",
        year.try_cast("int"),
        F.get(date, F.lit(1)).try_cast("int"),
        F.get(date, F.lit(0)).try_cast("int"),
        F.get(clock, F.lit(0)),
        F.get(clock, F.lit(1)),
        second,
    )
    well_formed = (F.size(date) == 3) & (F.size(clock) == 3) & (F.length(year) == 4) & (second < 60)
    return F.when(well_formed, stamp)


def day_month_year(date: Column, clock: Column) -> Column:
    """Timestamp without zone from trimmed 'dd-MM-yyyy' and 'HH:mm:ss'; NULL if either is bad."""
    return timestamp_of(date_parts(date), clock_parts(clock))


def true_text(text: Column) -> Column:
    """'True' is true, anything else (missing included) is false; a stray CR is ignored."""
    return F.coalesce(without_cr(text) == "True", F.lit(False))


def without_cr(text: Column) -> Column:
    return F.rtrim(text, F.lit("\r"))
