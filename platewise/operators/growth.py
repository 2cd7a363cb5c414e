"""Activity and order metrics per day, week and month."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.functions.numbers import exact, maybe_round, percent, rate, ratio
from platewise.functions.periods import day, month_label, month_start, week_end_month, week_start
from platewise.operators.sessions import union_all
from platewise.schemas import FUNNEL_STAGES

OPEN_STAGE = FUNNEL_STAGES[0]
WEEK_SLOTS = 6  # a month touches at most six Monday-based weeks


def _opens(events: DataFrame, open_stage: str) -> DataFrame:
    return events.filter((F.col("stage") == open_stage) & F.col("event_ts").isNotNull())


def _active_users(events: DataFrame, open_stage: str, period: Column, name: str) -> DataFrame:
    return _opens(events, open_stage).groupBy(period).agg(F.countDistinct("user_id").alias(name))


def dau(events: DataFrame, open_stage: str = OPEN_STAGE) -> DataFrame:
    """-> activity_date, dau"""
    period = day(F.col("event_ts")).alias("activity_date")
    return _active_users(events, open_stage, period, "dau").orderBy("activity_date")


def wau(events: DataFrame, open_stage: str = OPEN_STAGE) -> DataFrame:
    """-> week_start (Monday), wau; weeks are whole, also across month ends"""
    period = week_start(F.col("event_ts")).alias("week_start")
    return _active_users(events, open_stage, period, "wau").orderBy("week_start")


def mau(events: DataFrame, open_stage: str = OPEN_STAGE) -> DataFrame:
    """-> month, mau"""
    period = month_start(F.col("event_ts")).alias("month")
    return _active_users(events, open_stage, period, "mau").orderBy("month")


#: Size of a sketch of users, as a power of two; three standard deviations of its counts.
SKETCH_SIZE = 14


def sketch_error(size: int = SKETCH_SIZE) -> float:
    """Relative error that a count from sketches keeps to, but for three in a thousand."""
    return 3 * 1.04 / 2 ** (size / 2)


def activity_sketches(events: DataFrame, open_stage: str = OPEN_STAGE, size: int = SKETCH_SIZE) -> DataFrame:
    """One mergeable sketch of a day's users -> activity_date, users

    A few kilobytes a day, whatever the number of users: keep them, and count weeks, months
    or any other set of days without the events.
    """
    period = day(F.col("event_ts")).alias("activity_date")
    user = F.col("user_id") if dict(events.dtypes)["user_id"] in ("int", "bigint", "string", "binary") else F.col("user_id").cast("string")
    return _opens(events, open_stage).groupBy(period).agg(F.hll_sketch_agg(user, F.lit(size)).alias("users"))


def approximate_activity(sketches: DataFrame, grain: str = "day") -> DataFrame:
    """Distinct users by 'day', 'week' or 'month' from daily sketches -> period, users

    Within `sketch_error` of the exact count; small counts are exact.
    """
    periods = {"day": lambda d: d, "week": week_start, "month": month_start}
    if grain not in periods:
        raise ValueError(f"unknown grain {grain!r}")
    period = periods[grain](F.col("activity_date")).alias("period")
    merged = sketches.groupBy(period).agg(F.hll_union_agg("users").alias("users"))
    return merged.select("period", F.hll_sketch_estimate("users").alias("users")).orderBy("period")


def activity_state(events: DataFrame, open_stage: str = OPEN_STAGE) -> DataFrame:
    """One row per user and month -> user_id, month, days

    Bit d of `days` is set when the user was active on day d + 1 of the month. All activity
    figures follow from this small table; states of parts of the events merge into that of all.
    """
    return (
        _opens(events, open_stage)
        .filter(F.col("user_id").isNotNull())
        .select(
            "user_id",
            month_start(F.col("event_ts")).alias("month"),
            F.expr("shiftleft(1L, day(event_ts) - 1)").alias("day_bit"),
        )
        .groupBy("user_id", "month")
        .agg(F.bit_or("day_bit").alias("days"))
    )


def merged_activity(*states: DataFrame) -> DataFrame:
    """The state of all events from those of parts of them, which may overlap."""
    return union_all(states).groupBy("user_id", "month").agg(F.bit_or("days").alias("days"))


def _with_weeks(per_month: DataFrame) -> DataFrame:
    """Adds `weeks`, whose bit k is set when active in the k-th Monday-based week the month touches."""
    # Aligned to weeks, bit 0 is the Monday of the month's first week.
    weeks = " + ".join(
        f"if((shiftright(shiftleft(days, weekday(month)), {7 * k}) & 127) != 0, {1 << k}, 0)" for k in range(WEEK_SLOTS)
    )
    return per_month.withColumn("weeks", F.expr(weeks).cast("bigint"))


def _mean_per_slot(bits: str) -> Column:
    """Mean number of users per day (or week) slot, over the slots with any user.

    The sum of set bits counts (user, slot) pairs; the bits set by anybody count the slots.
    """
    return ratio(F.sum(F.bit_count(bits)), F.bit_count(F.bit_or(bits)))


def _weekly_by_sunday(user_months: DataFrame) -> DataFrame:
    """Mean WAU per month, a whole week belonging to the month of its Sunday."""
    slots = F.expr(f"filter(sequence(0, {WEEK_SLOTS - 1}), k -> getbit(weeks, k) = 1)")
    weeks = user_months.select("user_id", "month", F.explode(slots).alias("slot")).select(
        "user_id", F.expr("date_add(date_sub(month, weekday(month)), 7 * slot)").alias("week")
    )
    return (
        weeks.distinct()  # a week across a month end shows up in both months
        .groupBy("week")
        .agg(F.count("*").alias("wau"))
        .groupBy(week_end_month(F.col("week")).alias("month"))
        .agg(F.avg("wau").alias("wau_avg"))
    )


def _added_up(rows: DataFrame, n: Column, valued: Column, value: Column, decimal: Column, decimals: Column, *keys: Column | str) -> DataFrame:
    total = F.try_sum(decimal)
    return rows.groupBy(*keys).agg(
        F.sum(n).alias("n"),
        F.sum(valued).alias("valued"),
        F.sum(value).alias("value"),
        total.alias("exact"),
        F.when(total.isNotNull(), F.sum(decimals)).otherwise(0).alias("exacts"),
    )


def order_state(orders: DataFrame) -> DataFrame:
    """One row per user and day; everything about orders sums up from it
    -> user_id, day, n, valued, value, exact, exacts

    `value` is the sum of doubles, `exact` the sum of the `exacts` values that are decimals of
    ten places. States of disjoint parts of the orders are stacked.
    """
    value = F.col("order_value")
    rows = orders.filter(F.col("order_ts").isNotNull())
    count = lambda c: c.isNotNull().cast("bigint")
    return _added_up(rows, F.lit(1), count(value), value.cast("double"), exact(value), count(exact(value)), "user_id", day(F.col("order_ts")).alias("day"))


def _orders_by_user(state: DataFrame) -> DataFrame:
    """One row per month and user."""
    names = ("n", "valued", "value", "exact", "exacts")
    return _added_up(state, *map(F.col, names), month_start(F.col("day")).alias("month"), "user_id")


def _monthly(by_user: DataFrame) -> DataFrame:
    repeated = F.when(F.col("user_id").isNotNull(), (F.col("n") >= 2))
    return by_user.groupBy("month").agg(
        F.sum("n").alias("orders"),
        F.count("user_id").alias("ordering_users"),
        F.sum("valued").alias("valued_orders"),
        # exact, whatever the order of summing, unless a value is no such decimal
        F.coalesce(
            F.when(F.sum("exacts") == F.sum("valued"), F.try_sum("exact")).cast("double"), F.sum("value")
        ).alias("revenue"),
        rate(repeated).alias("repeat_rate"),
    )


def _orders_by_month(orders: DataFrame) -> DataFrame:
    value = F.col("order_value")
    rows = orders.filter(F.col("order_ts").isNotNull())
    count = lambda c: c.isNotNull().cast("bigint")
    month = month_start(F.col("order_ts")).alias("month")
    return _monthly(_added_up(rows, F.lit(1), count(value), value.cast("double"), exact(value), count(exact(value)), month, "user_id"))


def _aov(digits: int | None) -> Column:
    """Mean value of the orders that have one."""
    return maybe_round(ratio(F.col("revenue"), F.col("valued_orders")), digits)


def _revenue(digits: int | None) -> Column:
    return maybe_round(F.col("revenue").cast("double"), digits)


def orders_monthly(orders: DataFrame, digits: int | None = 2) -> DataFrame:
    """-> month, orders, ordering_users, aov, revenue"""
    return (
        _orders_by_month(orders)
        .select(
            "month",
            "orders",
            "ordering_users",
            _aov(digits).alias("aov"),
            _revenue(digits).alias("revenue"),
        )
        .orderBy("month")
    )


def repeat_rate_within_month(orders: DataFrame, digits: int | None = 4) -> DataFrame:
    """Share of a month's ordering users with two orders or more in that month
    -> month, repeat_order_rate_within_month"""
    return (
        _orders_by_month(orders)
        .select("month", maybe_round(F.col("repeat_rate"), digits).alias("repeat_order_rate_within_month"))
        .orderBy("month")
    )


def lifetime_repeat_rate(orders: DataFrame, as_percent: bool = True) -> DataFrame:
    """Share of ordering users with two orders or more ever, one row.

    -> lifetime_repeat_customer_pct (2 decimals), or with `as_percent=False`
    lifetime_repeat_customer_rate as a fraction.
    """
    share = rate(F.col("n") >= 2)
    result = (
        percent(share).alias("lifetime_repeat_customer_pct")
        if as_percent
        else share.alias("lifetime_repeat_customer_rate")
    )
    return (
        orders.filter(F.col("user_id").isNotNull()).groupBy("user_id").agg(F.count("*").alias("n")).agg(result)
    )


def growth_monthly(events: DataFrame, orders: DataFrame, open_stage: str = OPEN_STAGE) -> DataFrame:
    """Monthly rollup, unrounded, a whole week counting for the month of its Sunday.

    -> month ('yyyy-MM'), DAU_avg, WAU_avg, MAU, orders, ordering_users,
    orders_per_ordering_user, orders_per_MAU, AOV, revenue, revenue_per_MAU,
    repeat_order_rate_within_month. One row per month with active users.
    """
    return _growth(activity_state(events, open_stage), _orders_by_month(orders))


def growth_from_states(activity: DataFrame, orders: DataFrame) -> DataFrame:
    """`growth_monthly` from an `activity_state` and an `order_state`, without the events and orders."""
    return _growth(activity, _monthly(_orders_by_user(orders)))


def _growth(activity: DataFrame, orders_by_month: DataFrame) -> DataFrame:
    user_months = _with_weeks(activity)
    active = user_months.groupBy("month").agg(
        _mean_per_slot("days").alias("dau_avg"), F.count("*").alias("mau")
    )
    # The joined sides hold one row per calendar month.
    return (
        active.join(F.broadcast(_weekly_by_sunday(user_months)), "month", "left")
        .join(F.broadcast(orders_by_month), "month", "left")
        .orderBy("month")
        .select(
            month_label(F.col("month")).alias("month"),
            F.col("dau_avg").alias("DAU_avg"),
            F.col("wau_avg").alias("WAU_avg"),
            F.col("mau").alias("MAU"),
            "orders",
            "ordering_users",
            ratio(F.col("orders"), F.col("ordering_users")).alias("orders_per_ordering_user"),
            ratio(F.col("orders"), F.col("mau")).alias("orders_per_MAU"),
            _aov(None).alias("AOV"),
            _revenue(None).alias("revenue"),
            ratio(F.col("revenue"), F.col("mau")).alias("revenue_per_MAU"),
            F.col("repeat_rate").alias("repeat_order_rate_within_month"),
        )
    )


def growth_monthly_split(events: DataFrame, orders: DataFrame, open_stage: str = OPEN_STAGE) -> DataFrame:
    """Monthly rollup, rounded, weeks split at month ends: a week across two months
    counts as a partial week in each.

    -> month (date), dau_avg, wau_avg, mau, orders, ordering_users,
    orders_per_ordering_user, orders_per_mau, aov, revenue, revenue_per_mau,
    repeat_order_rate_within_month. One row per month with active users.
    """
    active = (
        _with_weeks(activity_state(events, open_stage))
        .groupBy("month")
        .agg(
            F.round(_mean_per_slot("days"), 1).alias("dau_avg"),
            F.round(_mean_per_slot("weeks"), 1).alias("wau_avg"),
            F.count("*").alias("mau"),
        )
    )
    # The joined side holds one row per calendar month.
    return (
        active.join(F.broadcast(_orders_by_month(orders)), "month", "left")
        .select(
            "month",
            "dau_avg",
            "wau_avg",
            "mau",
            "orders",
            "ordering_users",
            F.round(ratio(F.col("orders"), F.col("ordering_users")), 2).alias("orders_per_ordering_user"),
            F.round(ratio(F.col("orders"), F.col("mau")), 2).alias("orders_per_mau"),
            _aov(2).alias("aov"),
            _revenue(2).alias("revenue"),
            F.round(ratio(_revenue(2), F.col("mau")), 2).alias("revenue_per_mau"),
            F.round("repeat_rate", 4).alias("repeat_order_rate_within_month"),
        )
        .orderBy("month")
    )
