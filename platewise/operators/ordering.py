"""Positions in a global order, without a single-task window.

A running total over a whole table written as an unpartitioned window runs in one
task. Here the rows are cut into ranges of about equal size, each range is summed
by its own window partition, and the totals of the earlier ranges (one number
each) are added.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def default_ranges(df: DataFrame) -> int:
    """Four ranges per shuffle partition: that setting already follows the size of the data."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(4 * partitions, 64)


def range_borders(keys: DataFrame, order_by: Sequence[str], ranges: int) -> DataFrame:
    """One row, one column: about `ranges` of the distinct keys, in order.

    Taken are the keys whose hash is below a threshold, which each task tells by itself.
    Being a function of the data alone, the pick comes out the same when a lost task is
    run again.
    """
    share = ranges / F.greatest(keys.agg(F.count("*")).scalar(), F.lit(1)).cast("double")
    key = F.struct(*order_by)
    picked = keys.select(key.alias("key")).filter(F.xxhash64("key").cast("double") < share * float(1 << 64) - float(1 << 63))
    return picked.agg(F.sort_array(F.collect_list("key")))


def running_total(
    df: DataFrame,
    order_by: Sequence[str],
    weight: str,
    name: str = "before",
    ranges: int | None = None,
) -> DataFrame:
    """`order_by`, `weight` and `name`: the total weight of all rows ordered before.

    Rows that agree in `order_by` become one, their weights added before the shuffle, so a
    key that most rows share is one row. `weight` is a positive integer column.

    The range borders only steer the split: every row is kept.
    """
    ranges = ranges or default_ranges(df)
    df = df.groupBy(*order_by).agg(F.sum(weight).alias(weight)).filter(F.col(weight) > 0)
    key = F.struct(*order_by)
    borders = range_borders(df, order_by, ranges)
    # Binary search: _range becomes the number of borders below the key. Places beyond the
    # last border are NULL and never taken; the pick is all but never above twice `ranges`.
    steps = F.array(*[F.lit(1 << k) for k in reversed(range((4 * ranges + 64).bit_length()))])
    below = lambda at, step: at + F.when(F.get("_borders", at + step - 1) < key, step).otherwise(F.lit(0))
    split = df.withColumn("_borders", borders.scalar()).withColumn("_range", F.aggregate(steps, F.lit(0), below)).drop("_borders")

    earlier_rows = Window.rowsBetween(Window.unboundedPreceding, -1)
    within = split.withColumn(
        "_within",
        F.coalesce(
            F.sum(weight).over(
                Window.partitionBy("_range")
                .orderBy(*order_by)
                .rowsBetween(Window.unboundedPreceding, -1)
            ),
            F.lit(0),
        ),
    )
    # One row per range from here on, numbered 0, 1, ... without gaps, since
    # every border is itself a row of the range it closes.
    starts = (
        split.groupBy("_range")
        .agg(F.sum(weight).alias("_total"))
        .select(
            "_range",
            F.coalesce(F.sum("_total").over(earlier_rows.orderBy("_range")), F.lit(0)).alias("_start"),
        )
        .agg(F.sort_array(F.collect_list(F.struct("_range", "_start"))))
    )
    return (
        within.withColumn("_starts", starts.scalar())
        .withColumn(name, F.get("_starts", F.col("_range"))["_start"] + F.col("_within"))
        .drop("_range", "_within", "_starts")
    )


def row_positions(df: DataFrame, order_by: Sequence[str], name: str = "position", ranges: int | None = None) -> DataFrame:
    """Every row of `order_by` with its position 0, 1, ... in that order.

    Equal rows are counted, placed as one and unfolded again.
    """
    placed = running_total(df.select(*order_by, F.lit(1).alias("_rows")), order_by, "_rows", "_before", ranges)
    last = F.col("_before") + F.col("_rows") - 1
    return placed.select(*order_by, F.explode(F.sequence("_before", last)).alias(name))


#: Ranks are bracketed to one part in so many of the rows.
SKETCH_ACCURACY = 100_000
#: Brackets per word of a pattern.
WORD = 62


def known_number(column: str) -> Column:
    """The column as a double, NaN as NULL."""
    return F.nanvl(F.col(f"`{column}`").cast("double"), F.lit(None).cast("double"))


def column_figures(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], more: Mapping[str, Column] | None = None) -> dict:
    """Figures of each column from one pass, which runs at once, and whatever else it is to aggregate.

    -> {column: {count, mean, std, min, max, edges}, name: value of each of `more`}. The edges
    bracket the rank of each probability from below and above.
    """
    margin = 3.0 / SKETCH_ACCURACY
    wanted = [max(float(p) - margin, 0.0) for p in probabilities] + [min(float(p) + margin, 1.0) for p in probabilities]
    edges = F.array(*[F.lit(p) for p in wanted])
    # a name that no column of the table begins with
    number = "number"
    while any(name.startswith(number) for name in df.columns):
        number += "_"
    aggregates = [
        F.struct(
            F.count(value).alias("count"),
            F.avg(value).alias("mean"),
            F.nanvl(F.stddev_samp(value), F.lit(None).cast("double")).alias("std"),
            F.min(value).alias("min"),
            F.max(value).alias("max"),
            F.percentile_approx(value, edges, SKETCH_ACCURACY).alias("edges"),
        ).alias(f"f{i}")
        for i, value in enumerate(F.col(f"`{number}{i}`") for i in range(len(columns)))
    ]
    numbers = df.select("*", *[known_number(c).alias(f"{number}{i}") for i, c in enumerate(columns)])
    found = numbers.agg(*aggregates, *[value.alias(f"m{i}") for i, value in enumerate((more or {}).values())]).first()
    figures = {c: found[f"f{i}"].asDict() | {"wanted": wanted} for i, c in enumerate(columns)}
    return figures | {name: found[f"m{i}"] for i, name in enumerate(more or {})}


def quantiles_between(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], figures: Mapping) -> DataFrame:
    """Exact quantiles, interpolated linearly -> metric, probability, quantile, by one scan

    `figures` are those of `column_figures`, whose edges bracket each rank. A row gives one
    small cell that says below which brackets it lies, a pattern that most rows share, and a
    cell for each value inside a bracket, a few in a hundred thousand. Both are counted before
    the shuffle.
    """
    probabilities = [float(p) for p in probabilities]
    numbers = df.select(*[known_number(c).alias(f"c{i}") for i, c in enumerate(columns)])
    below, inside = [], []
    for i, c in enumerate(columns):
        value, known = F.col(f"c{i}"), figures[c]
        for k in range(len(probabilities)):
            low = high = F.lit(False)
            # in fewer rows the margin is less than the step between two ranks
            if known["count"] >= SKETCH_ACCURACY:
                low = value < known["edges"][k] if known["wanted"][k] > 0 else low
                high = value > known["edges"][len(probabilities) + k] if known["wanted"][len(probabilities) + k] < 1 else high
            number = len(below)
            below.append(F.coalesce(low, F.lit(False)))
            cell = F.struct(F.lit(number).alias("bracket"), F.lit(None).cast("array<bigint>").alias("under"), value.alias("value"))
            inside.append(F.when(value.isNotNull() & ~low & ~high, cell))
    words = [
        reduce(add, [F.when(flag, F.lit(1 << k)).otherwise(F.lit(0)).cast("bigint") for k, flag in enumerate(below[at : at + WORD])])
        for at in range(0, len(below), WORD)
    ]
    pattern = F.struct(F.lit(-1).alias("bracket"), F.array(*words).alias("under"), F.lit(None).cast("double").alias("value"))
    counted = (
        numbers.select(F.explode(F.array(pattern, *inside)).alias("cell"))
        .filter("cell is not null")
        .groupBy("cell.bracket", "cell.under", "cell.value")
        .agg(F.count("*").alias("n"))
    )
    # every bracket that a pattern is below: at most one row per pattern and bracket
    brackets = F.array(*[F.lit(b) for b in range(len(below))])
    is_under = lambda b: F.getbit(F.get("under", F.floor(b / WORD).cast("int")), b % WORD) == 1
    places = F.when(F.col("bracket") >= 0, F.array("bracket")).otherwise(F.filter(brackets, is_under))
    counts = counted.select(F.explode(places).alias("bracket"), "value", "n").groupBy("bracket", "value").agg(F.sum("n").alias("n"))
    about = F.array(
        *[
            F.struct(F.lit(c).alias("metric"), F.lit(p).alias("probability"), F.lit(float(p * (figures[c]["count"] - 1))).alias("place"))
            for c in columns
            for p in probabilities
        ]
    )
    # A window partition holds one bracket: a few in a hundred thousand of a column's rows.
    earlier = Window.partitionBy("bracket").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("ahead", F.coalesce(F.sum("n").over(earlier), F.lit(0))).withColumn("of", F.get(about, F.col("bracket")))

    def value_at(position: Column) -> Column:
        return F.max(F.when((F.col("ahead") <= position) & (position < F.col("ahead") + F.col("n")), F.col("value")))

    ends = counts.groupBy("of.metric", "of.probability", "of.place").agg(
        value_at(F.floor("of.place")).alias("low"), value_at(F.ceil("of.place")).alias("high")
    )
    return ends.selectExpr("metric", "probability", "low + (place - floor(place)) * (high - low) AS quantile")


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]
) -> DataFrame:
    """Exact quantiles, interpolated linearly -> metric, probability, quantile; NULL and NaN left out

    Two scans. The first, which runs at once, sketches each column and brackets every wanted
    rank between two values; the second counts what lies below and inside the brackets.
    """
    return quantiles_between(df, columns, probabilities, column_figures(df, columns, probabilities))


def exact_median(df: DataFrame, column: str) -> DataFrame:
    """One row, one column: the median (mean of the two middle values)."""
    return exact_quantiles(df, [column], [0.5]).agg(F.max("quantile").alias("median"))
