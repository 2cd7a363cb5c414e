"""The registered queries: every operator over the sample tables, whole tables always.

Dates and timestamps come out as text and doubles rounded, so that results compare
by value across engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from platewise.functions.numbers import ratio, round_doubles
from platewise.functions.tails import norm_cdf, norm_sf
from platewise.operators import cleaning, delivery, experiment, funnel, growth, orders, quality, report, retention
from platewise.operators.sessions import session_rollup, union_all
from platewise.plans import bindings as b
from platewise.plans import reloads
from platewise.schemas import ORDER_VALUE_RANGE
from platewise.sources.readers import typed

Query = Callable[[SparkSession, str], DataFrame]
SUMMARY_COLUMNS = ["time_taken_min", "distance_km", "prep_time_min"]
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW")


def plain(df: DataFrame, digits: int | None = None) -> DataFrame:
    """Dates and timestamps as text, doubles rounded to `digits`."""
    columns = []
    for f in df.schema.fields:
        column = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DateType):
            column = column.cast("string")
        elif isinstance(f.dataType, T.TimestampNTZType):
            text = column.cast("string")  # a zero fraction is left out
            column = F.rpad(F.when(F.contains(text, F.lit(".")), text).otherwise(F.concat(text, F.lit("."))), 26, "0")
        columns.append(column.alias(f.name))
    result = df.select(*columns)
    return result if digits is None else round_doubles(result, digits)


def _retention(operator, **options) -> Query:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return operator(
            b.users(spark, sf), b.funnel_events(spark, sf), b.ANALYSIS_END, open_stage=b.OPEN_STAGE, **options
        )

    return query


def _curve(spark: SparkSession, sf: str) -> DataFrame:
    return _retention(retention.retention_curve, max_day=25)(spark, sf)


def _cleaned(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.clean_orders(b.raw_orders(spark, sf))


def norm_tail_functions(spark: SparkSession, sf: str) -> DataFrame:
    """Both polynomial tails over the standardised price of every order."""
    prices = b.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    moments = prices.agg(
        F.struct(F.avg("o_totalprice").alias("mean"), F.stddev_samp("o_totalprice").alias("std"))
    )
    z = F.col("z")
    return (
        prices.withColumn("m", moments.scalar())
        .withColumn("z", 3 * ratio(F.col("o_totalprice") - F.col("m.mean"), F.col("m.std")))
        .select("o_orderkey", norm_sf(z).alias("sf"), norm_cdf(z).alias("cdf"))
    )


def row_counts(spark: SparkSession, sf: str) -> DataFrame:
    return quality.row_counts(
        {
            "real_orders": b.line_deliveries(spark, sf),
            "synthetic_users": b.users(spark, sf),
            "synthetic_funnel_events": b.funnel_events(spark, sf),
            "synthetic_orders": b.event_orders(spark, sf),
            "synthetic_ab_test": b.ab_sessions(spark, sf),
        }
    )


def orders_from_events(spark: SparkSession, sf: str) -> DataFrame:
    return orders.orders_from_events(
        b.funnel_events(spark, sf),
        F.col("value") * 10,
        order_stage=b.STAGES[-1],
        value_range=ORDER_VALUE_RANGE,
    )


def growth_by_states(spark: SparkSession, sf: str) -> DataFrame:
    """Growth from the states of everything before a day and of the rest, merged."""
    cut = F.lit("1995-06-17").cast("timestamp_ntz")
    opens, shop = b.order_opens(spark, sf), b.shop_orders(spark, sf)
    activity = [growth.activity_state(opens.filter(part), b.OPEN_STAGE) for part in (F.col("event_ts") < cut, F.col("event_ts") >= cut)]
    state = growth.order_state(shop.filter(F.col("order_ts") < cut)).union(growth.order_state(shop.filter(F.col("order_ts") >= cut)))
    return growth.growth_from_states(growth.merged_activity(*activity), state)


def approximate_activity(spark: SparkSession, sf: str) -> DataFrame:
    """Users per day, week and month from daily sketches, held against the exact counts."""
    opens = b.order_opens(spark, sf)
    sketches = growth.activity_sketches(opens, b.OPEN_STAGE)
    exact = {"day": growth.dau, "week": growth.wau, "month": growth.mau}
    rows = []
    for grain, counted in exact.items():
        known = counted(opens, b.OPEN_STAGE).toDF("period", "exact_users")
        close = F.abs(F.col("users") - F.col("exact_users")) <= F.greatest(F.col("exact_users") * growth.sketch_error(), F.lit(1))
        both = known.join(growth.approximate_activity(sketches, grain), "period", "full")
        rows.append(both.select(F.lit(grain).alias("grain"), "period", "exact_users", close.alias("within_error")))
    return union_all(rows)


def constraint_report(spark: SparkSession, sf: str) -> DataFrame:
    """Keys of lines and orders, references of orders and events, labels of orders, in one aggregate."""
    tables = {
        "lines": b.table(spark, sf, "lineitem").withColumnRenamed("l_partkey", "p_key"),
        "orders": b.table(spark, sf, "orders").withColumnRenamed("o_custkey", "user_id"),
        "users": b.event_users(spark, sf),
    }
    return quality.constraint_report(
        tables,
        {"lines": ["p_key", "l_suppkey"], "orders": ["o_orderkey"], "users": ["user_id"]},
        [("orders", "user_id", "users")],
        {"o_orderpriority": PRIORITIES, "o_orderstatus": ("F", "O")},
    )


QUERIES: dict[str, Query] = {
    # funnel
    "session_rollup": lambda s, d: plain(session_rollup(b.funnel_events(s, d))),
    "funnel_first_session": lambda s, d: plain(funnel.funnel(b.funnel_events(s, d), b.STAGES, "first_session")),
    "funnel_blended": lambda s, d: plain(funnel.funnel(b.funnel_events(s, d), b.STAGES, "blended")),
    "funnel_by_depth": lambda s, d: plain(funnel.funnel_by_depth(b.funnel_events(s, d), b.STAGES)),
    # retention
    "cohort_retention_long": lambda s, d: plain(
        _retention(retention.cohort_retention, days=b.DAYS, grain="week")(s, d)
    ),
    "cohort_retention_wide": lambda s, d: plain(
        _retention(retention.cohort_retention_wide, days=b.DAYS, grain="week")(s, d)
    ),
    "cohort_retention_by_month": lambda s, d: plain(
        _retention(retention.cohort_retention_wide, days=b.DAYS)(s, d)
    ),
    "retention_curve": lambda s, d: plain(_curve(s, d)),
    "retention_day_points": lambda s, d: plain(retention.day_points(_curve(s, d), b.DAYS)),
    "retention_powerlaw_fit": lambda s, d: plain(retention.fit_retention_curve(_curve(s, d), floor=0.38), 6),
    "pooled_retention": lambda s, d: plain(_retention(retention.pooled_retention, days=b.DAYS)(s, d)),
    # growth
    "dau": lambda s, d: plain(growth.dau(b.order_opens(s, d), b.OPEN_STAGE)),
    "wau": lambda s, d: plain(growth.wau(b.order_opens(s, d), b.OPEN_STAGE)),
    "mau": lambda s, d: plain(growth.mau(b.order_opens(s, d), b.OPEN_STAGE)),
    "orders_monthly": lambda s, d: plain(growth.orders_monthly(b.shop_orders(s, d))),
    "repeat_rate_within_month": lambda s, d: plain(growth.repeat_rate_within_month(b.shop_orders(s, d))),
    "growth_monthly_week_end": lambda s, d: plain(
        # by way of nine digits, so that ties round alike in both engines
        plain(growth.growth_monthly(b.order_opens(s, d), b.shop_orders(s, d), b.OPEN_STAGE), 9), 4
    ),
    "growth_monthly_week_split": lambda s, d: plain(
        growth.growth_monthly_split(b.order_opens(s, d), b.shop_orders(s, d), b.OPEN_STAGE)
    ),
    "growth_by_states": lambda s, d: plain(plain(growth_by_states(s, d), 9), 4),
    "approximate_activity": lambda s, d: plain(approximate_activity(s, d)),
    "lifetime_repeat_rate": lambda s, d: growth.lifetime_repeat_rate(b.shop_orders(s, d)),
    "orders_from_events": lambda s, d: plain(orders_from_events(s, d)),
    # delivery
    "delivery_overall": lambda s, d: delivery.delivery_overall(b.line_deliveries(s, d)),
    "delivery_on_time_share": lambda s, d: plain(delivery.on_time_share(b.line_deliveries(s, d))),
    "delivery_by_traffic": lambda s, d: delivery.delivery_by_traffic(b.deliveries(s, d), b.TRAFFIC),
    "delivery_by_weather": lambda s, d: delivery.delivery_by(b.line_deliveries(s, d), "weather", sort_by_rate=True),
    "delivery_by_city": lambda s, d: delivery.delivery_by(b.deliveries(s, d), "city_type", sort_by_rate=True),
    "delivery_by_festival": lambda s, d: delivery.delivery_by(b.line_deliveries(s, d), "festival"),
    "delivery_by_traffic_fraction": lambda s, d: plain(
        delivery.delivery_by_traffic(b.deliveries(s, d), b.TRAFFIC[:3], False, as_percent=False, digits=None)
    ),
    "delay_combos_topk": lambda s, d: delivery.delay_combos(b.deliveries(s, d)),
    "delay_correlations": lambda s, d: delivery.delay_correlations(b.deliveries(s, d), b.TRAFFIC),
    "delay_stats": lambda s, d: plain(
        delivery.delay_stats(b.deliveries(s, d), b.TRAFFIC, untrafficked=b.line_deliveries(s, d)), 6
    ),
    # experiment
    "ab_ztest": lambda s, d: plain(experiment.ab_ztest(b.ab_sessions(s, d)), 8),
    "ab_readout": lambda s, d: plain(experiment.ab_readout(b.ab_sessions(s, d)), 8),
    "ab_chi2": lambda s, d: experiment.ab_chi2(b.ab_sessions(s, d)),
    "ab_chi2_equals_z2": lambda s, d: plain(experiment.ab_chi2_equals_z2(b.ab_sessions(s, d)), 6),
    "norm_tail_functions": lambda s, d: plain(norm_tail_functions(s, d), 8),
    # loading, cleaning, profiles, checks
    "typed_load": lambda s, d: plain(typed(b.event_texts(s, d), b.TYPED)),
    "file_load": lambda s, d: plain(reloads.file_load(s, d)),
    "scalar_file": reloads.scalar_file,
    "months_replaced": lambda s, d: plain(reloads.months_replaced(s, d)),
    "clean_orders": lambda s, d: plain(_cleaned(s, d).withColumn("distance_km", F.round("distance_km", 6))),
    "null_profile": lambda s, d: quality.null_profile(_cleaned(s, d)),
    "numeric_summary": lambda s, d: plain(quality.numeric_summary(_cleaned(s, d), SUMMARY_COLUMNS), 6),
    "row_counts": row_counts,
    "pk_violations": lambda s, d: quality.pk_violations(b.table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"]),
    "fk_orphans": lambda s, d: quality.fk_orphans(b.shop_orders(s, d), b.event_users(s, d), "user_id"),
    "domain_violations": lambda s, d: quality.domain_violations(
        b.table(s, d, "orders"), {"o_orderpriority": PRIORITIES, "o_orderstatus": ("F", "O")}
    ),
    "stage_prefix_violations": lambda s, d: quality.stage_violations(b.all_events(s, d), b.STAGES),
    "constraint_report": constraint_report,
    "users_without_session": lambda s, d: quality.users_without_session(
        b.table(s, d, "customer").withColumnRenamed("c_custkey", "user_id"), b.table(s, d, "events")
    ),
    # reports
    "calibration_report": lambda s, d: plain(
        report.calibration_report(
            b.users(s, d), b.funnel_events(s, d), None, b.ANALYSIS_END, b.STAGES, b.DAYS, order_stage=b.STAGES[-1]
        )
    ),
    "key_numbers": lambda s, d: report.key_numbers(
        b.line_deliveries(s, d), b.funnel_events(s, d), b.event_orders(s, d), b.ab_sessions(s, d), b.STAGES
    ),
}
