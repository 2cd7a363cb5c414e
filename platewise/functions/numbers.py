"""Ratios, rounding, ordinals and tiny helpers on numeric columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ratio(numerator: Column, denominator: Column) -> Column:
    """Double division; a zero denominator gives NULL instead of an ANSI error."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def exact(value: Column) -> Column:
    """The value as a decimal of 10 places where that is the same number, else NULL."""
    decimal = value.try_cast("decimal(38,10)")
    return F.when(decimal.cast("double") == value.cast("double"), decimal)


def rate(flag: Column) -> Column:
    """Share of true values (aggregate); NULL flags are skipped."""
    return F.avg(flag.cast("double"))


def open_ratio(numerator: Column, denominator: Column) -> Column:
    """Float division as IEEE does it, with 0/0 as NULL: x/0 is infinite for x > 0."""
    return F.when((denominator == 0) & (numerator > 0), float("inf")).otherwise(
        ratio(numerator, denominator)
    )


def percent(value: Column, digits: int | None = 2) -> Column:
    scaled = F.lit(100.0) * value
    return scaled if digits is None else F.round(scaled, digits)


def maybe_round(value: Column, digits: int | None) -> Column:
    return value if digits is None else F.round(value, digits)


def ordinal(label: Column, levels: Sequence[str]) -> Column:
    """Position of a label in its ordered vocabulary; unknown labels give NULL."""
    position = F.lit(None).cast("int")
    for i, level in enumerate(levels):
        position = F.when(label == level, i).otherwise(position)
    return position


def correlation(x: Column, y: Column) -> Column:
    """Pearson r (aggregate) over the rows where both are known; NULL without spread.

    The built-in corr raises on a constant column under ANSI mode.
    """
    known_x, known_y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return ratio(F.covar_pop(x, y), F.stddev_pop(known_x) * F.stddev_pop(known_y))


def round_doubles(df: DataFrame, digits: int) -> DataFrame:
    """Round every double column, leave the others alone."""
    return df.select(
        *[
            F.round(f.name, digits).alias(f.name)
            if isinstance(f.dataType, T.DoubleType)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )
