"""Delivery performance: on-time breakdowns and what drives the delay."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.functions.numbers import correlation, maybe_round, ordinal, percent, rate
from platewise.operators.ordering import column_figures, quantiles_between
from platewise.operators.sessions import union_all
from platewise.operators.statistics import pearson_and_anova, spearman_ordinal, with_p_value
from platewise.schemas import TRAFFIC_LEVELS


def _on_time(as_percent: bool, digits: int | None) -> Column:
    share = rate(F.col("on_time"))
    value = percent(share, digits) if as_percent else maybe_round(share, digits)
    return value.alias("on_time_pct")


def delivery_overall(orders: DataFrame, digits: int | None = 2) -> DataFrame:
    """One row -> total_orders, on_time_pct, avg_time_taken_min, median_time_taken_min

    Two scans. The first runs when the query is built and fetches one row: the totals, and the
    bracket in which the second finds the median.
    """
    totals = {"total_orders": F.count("*"), "on_time_pct": _on_time(True, digits), "avg_time_taken_min": maybe_round(F.avg("time_taken_min"), digits)}
    found = column_figures(orders, ["time_taken_min"], [0.5], totals)
    median = quantiles_between(orders, ["time_taken_min"], [0.5], found).agg(F.max("quantile").alias("median"))
    return median.select(
        F.lit(found["total_orders"]).cast("bigint").alias("total_orders"),
        F.lit(found["on_time_pct"]).cast("double").alias("on_time_pct"),
        F.lit(found["avg_time_taken_min"]).cast("double").alias("avg_time_taken_min"),
        maybe_round(F.col("median"), digits).alias("median_time_taken_min"),
    )


def on_time_share(orders: DataFrame) -> DataFrame:
    """One row: the overall on-time share as a fraction -> overall_on_time_pct"""
    return orders.agg(rate(F.col("on_time")).alias("overall_on_time_pct"))


def delivery_by(
    orders: DataFrame,
    key: str,
    levels: Sequence[str] | None = None,
    keep_unknown: bool = True,
    sort_by_rate: bool = False,
    as_percent: bool = True,
    digits: int | None = 2,
) -> DataFrame:
    """Breakdown by one label -> `key`, orders, on_time_pct, avg_time_taken_min

    Rows without a label are left out. With `levels` the rows follow that order, and
    labels outside it come first, or are dropped when `keep_unknown` is false.
    `sort_by_rate` sorts by on-time share instead. The share is a percentage, or a
    fraction with `as_percent=False`.
    """
    labelled = orders.filter(F.col(key).isNotNull())
    if levels is not None and not keep_unknown:
        labelled = labelled.filter(F.col(key).isin(*levels))
    result = labelled.groupBy(key).agg(
        F.count("*").alias("orders"),
        _on_time(as_percent, digits),
        maybe_round(F.avg("time_taken_min"), digits).alias("avg_time_taken_min"),
    )
    if levels is not None:
        return result.orderBy(F.coalesce(ordinal(F.col(key), levels), F.lit(-1)), key)
    return result.orderBy("on_time_pct", key) if sort_by_rate else result.orderBy(key)


def delivery_by_traffic(
    orders: DataFrame, levels: Sequence[str] = TRAFFIC_LEVELS, keep_unknown: bool = True, **options
) -> DataFrame:
    """By traffic, in order of severity; padded labels are trimmed."""
    tidy = orders.withColumn("traffic_density", F.trim("traffic_density"))
    return delivery_by(tidy, "traffic_density", levels, keep_unknown, **options)


def delay_combos(orders: DataFrame, min_orders: int = 30, k: int = 10, digits: int | None = 2) -> DataFrame:
    """The k slowest traffic and weather combinations with enough orders
    -> traffic_density, weather, orders, avg_time_taken_min, on_time_pct"""
    return (
        orders.filter(F.col("traffic_density").isNotNull() & F.col("weather").isNotNull())
        .groupBy("traffic_density", "weather")
        .agg(
            F.count("*").alias("orders"),
            maybe_round(F.avg("time_taken_min"), digits).alias("avg_time_taken_min"),
            _on_time(True, digits),
        )
        .filter(F.col("orders") >= min_orders)
        .orderBy(F.desc("avg_time_taken_min"), "traffic_density", "weather")
        .limit(k)
    )


def delay_correlations(
    orders: DataFrame, levels: Sequence[str] = TRAFFIC_LEVELS, digits: int | None = 4
) -> DataFrame:
    """Pearson r of delivery time with distance, traffic ordinal and multiple deliveries,
    over the orders that know all three -> one row"""
    complete = orders.filter(
        F.col("distance_km").isNotNull()
        & F.col("traffic_density").isNotNull()
        & F.col("multiple_deliveries").isNotNull()
    ).withColumn("traffic_ordinal", ordinal(F.col("traffic_density"), levels).cast("double"))

    def r(column: str, name: str) -> Column:
        return maybe_round(correlation(F.col(column), F.col("time_taken_min")), digits).alias(name)

    return complete.agg(
        r("distance_km", "corr_distance_vs_time"),
        r("traffic_ordinal", "corr_traffic_ordinal_vs_time"),
        r("multiple_deliveries", "corr_multiple_deliveries_vs_time"),
    )


def delay_stats(
    orders: DataFrame,
    levels: Sequence[str] = TRAFFIC_LEVELS,
    ranges: int | None = None,
    untrafficked: DataFrame | None = None,
) -> DataFrame:
    """Four tests of what goes with delivery time -> test, method, statistic, p_value

    Each test uses the rows that know its own two columns. Where traffic comes from a
    join, `untrafficked` may give the same rows before it, for the three tests that look
    at other columns; those share one pass.
    """
    tidy = orders.withColumn("traffic_density", F.trim("traffic_density"))
    y = "time_taken_min"
    predictors = ["distance_km", "multiple_deliveries"]
    moments = pearson_and_anova(orders if untrafficked is None else untrafficked, y, predictors, "weather")
    method = F.when(F.col("test") == "pearson", "Pearson r").otherwise("One-way ANOVA F").alias("method")
    others = moments.select(F.concat("name", F.lit(f" vs {y}")).alias("test"), method, "statistic", "f", "dof1", "dof2")
    ranks = spearman_ordinal(tidy, "traffic_density", levels, y, ranges).select(
        F.lit(f"traffic_density (ordinal) vs {y}").alias("test"), F.lit("Spearman rho").alias("method"), "*"
    )
    stacked = union_all([others, ranks])
    return with_p_value(stacked).select("test", "method", "statistic", "p_value")
