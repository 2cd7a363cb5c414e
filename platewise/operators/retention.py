"""Exact-day retention: a user is retained on day N when the app is opened on day N
after signup, no earlier and no later."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.functions.numbers import maybe_round, ratio
from platewise.functions.periods import day, days_between, month_label, period_start
from platewise.schemas import FUNNEL_STAGES, RETENTION_DAYS

OPEN_STAGE = FUNNEL_STAGES[0]


def _active_days(
    users: DataFrame, events: DataFrame, open_stage: str, until: Column | None = None
) -> DataFrame:
    """Users with the days since signup on which they opened the app
    -> user_id, signup_date, day_n.

    Opens collapse to one row per user and date before the join, so a user with
    very many events brings at most one row per calendar day to it. A user listed more
    than once counts with the first signup, so every row here is another user and day.
    """
    opens = events.filter(F.col("stage") == open_stage)
    if until is not None:
        opens = opens.filter(F.col("event_ts") < F.date_add(until, 1).cast("timestamp_ntz"))
    opens = opens.select("user_id", day(F.col("event_ts")).alias("open_date")).distinct()
    signups = users.groupBy("user_id").agg(F.min("signup_date").alias("signup_date"))
    return opens.join(signups, "user_id").select(
        "user_id", "signup_date", days_between(F.col("signup_date"), F.col("open_date")).alias("day_n")
    )


def _signups(users: DataFrame) -> DataFrame:
    """Users per signup date: one row per calendar day."""
    return users.groupBy("signup_date").agg(F.count("*").alias("users"))


def _eligible(end: Column, day_n: Column) -> Column:
    """Signed up early enough for day N to lie within the observed time."""
    return F.col("signup_date") <= F.date_sub(end, day_n)


def cohort_retention(
    users: DataFrame,
    events: DataFrame,
    analysis_end: date,
    days: Sequence[int] = RETENTION_DAYS,
    open_stage: str = OPEN_STAGE,
    grain: str = "month",
    digits: int | None = 4,
) -> DataFrame:
    """Long form -> cohort_month, day_n, eligible_users, active_users, retention_rate.

    Active users are not limited to eligible ones. A cohort without eligible users
    for a day has no row for it. With `grain='week'` the cohort is a week's Monday,
    under the same column name.
    """
    end = F.lit(analysis_end)
    cohort = period_start(F.col("signup_date"), grain).alias("cohort_month")
    day_list = F.array(*[F.lit(int(n)) for n in days])
    eligible = (
        _signups(users)
        .withColumn("day_n", F.explode(day_list))
        .filter(_eligible(end, F.col("day_n")))
        .groupBy(cohort, "day_n")
        .agg(F.sum("users").alias("eligible_users"))
    )
    active = (
        _active_days(users, events, open_stage)
        .filter(F.col("day_n").isin(*[int(n) for n in days]))
        .groupBy(cohort, "day_n")
        .agg(F.count("*").alias("active_users"))
    )
    active_users = F.coalesce(F.col("active_users"), F.lit(0))
    return (
        eligible.join(active, ["cohort_month", "day_n"], "left")
        .select(
            "cohort_month",
            "day_n",
            "eligible_users",
            active_users.alias("active_users"),
            maybe_round(ratio(active_users, F.col("eligible_users")), digits).alias("retention_rate"),
        )
        .orderBy("cohort_month", "day_n")
    )


def cohort_retention_wide(
    users: DataFrame,
    events: DataFrame,
    analysis_end: date,
    days: Sequence[int] = RETENTION_DAYS,
    open_stage: str = OPEN_STAGE,
    grain: str = "month",
) -> DataFrame:
    """One row per cohort -> cohort_month, cohort_size, D{n}_retention, D{n}_eligible_users.

    Only eligible users count as active. A day without eligible users is NULL in
    both columns; the size counts every user.
    """
    end = F.lit(analysis_end)
    days = [int(n) for n in days]

    def label(cohort: Column) -> Column:
        return month_label(cohort) if grain == "month" else cohort.cast("string")

    cohort = label(period_start(F.col("signup_date"), grain)).alias("cohort_month")
    sizes = (
        _signups(users)
        .filter(F.col("signup_date").isNotNull())
        .groupBy(cohort)
        .agg(
            F.sum("users").alias("cohort_size"),
            *[F.sum(F.when(_eligible(end, F.lit(n)), F.col("users"))).alias(f"eligible_{n}") for n in days],
        )
    )
    active = (
        _active_days(users, events, open_stage, until=end)
        .filter(F.col("day_n").isin(*days) & _eligible(end, F.col("day_n")))
        .groupBy(cohort, "day_n")
        .agg(F.count("*").alias("users"))
        .groupBy("cohort_month")
        .agg(*[F.max(F.when(F.col("day_n") == n, F.col("users"))).alias(f"active_{n}") for n in days])
    )
    per_day = []
    for n in days:
        retained = ratio(F.coalesce(F.col(f"active_{n}"), F.lit(0)), F.col(f"eligible_{n}"))
        per_day += [
            retained.alias(f"D{n}_retention"),
            F.col(f"eligible_{n}").alias(f"D{n}_eligible_users"),
        ]
    return (
        sizes.join(active, "cohort_month", "left")
        .select("cohort_month", "cohort_size", *per_day)
        .orderBy("cohort_month")
    )


def retention_curve(
    users: DataFrame,
    events: DataFrame,
    analysis_end: date,
    max_day: int = 45,
    open_stage: str = OPEN_STAGE,
) -> DataFrame:
    """All cohorts pooled -> day, retention, eligible_users for days 1..max_day.

    Days without eligible users have no row.
    """
    end = F.lit(analysis_end)
    eligible = (
        _signups(users)
        .withColumn("day", F.explode(F.sequence(F.lit(1), F.lit(max_day))))
        .filter(_eligible(end, F.col("day")))
        .groupBy("day")
        .agg(F.sum("users").alias("eligible_users"))
    )
    active = (
        _active_days(users, events, open_stage, until=end)
        .filter(F.col("day_n").between(1, max_day) & _eligible(end, F.col("day_n")))
        .groupBy(F.col("day_n").alias("day"))
        .agg(F.count("*").alias("active_users"))
    )
    return (
        eligible.join(active, "day", "left")
        .select(
            "day",
            ratio(F.coalesce(F.col("active_users"), F.lit(0)), F.col("eligible_users")).alias("retention"),
            "eligible_users",
        )
        .orderBy("day")
    )


def pooled_retention(
    users: DataFrame,
    events: DataFrame,
    analysis_end: date,
    days: Sequence[int] = RETENTION_DAYS,
    open_stage: str = OPEN_STAGE,
    digits: int | None = None,
) -> DataFrame:
    """All cohorts pooled -> day_n, eligible_users, active_users, retention_rate.

    Active users are not limited to eligible ones; the rate of a day without
    eligible users is NULL.
    """
    days = [int(n) for n in days]
    reached = _eligible(F.lit(analysis_end), F.col("day_n"))
    eligible = (
        _signups(users)
        .withColumn("day_n", F.explode(F.array(*[F.lit(n) for n in days])))
        .groupBy("day_n")
        .agg(F.coalesce(F.sum(F.when(reached, F.col("users"))), F.lit(0)).alias("eligible_users"))
    )
    active = (
        _active_days(users, events, open_stage)
        .filter(F.col("day_n").isin(*days))
        .groupBy("day_n")
        .agg(F.count("*").alias("active_users"))
    )
    active_users = F.coalesce(F.col("active_users"), F.lit(0))
    return (
        eligible.join(active, "day_n", "left")
        .select(
            "day_n",
            "eligible_users",
            active_users.alias("active_users"),
            maybe_round(ratio(active_users, F.col("eligible_users")), digits).alias("retention_rate"),
        )
        .orderBy("day_n")
    )


def day_points(curve: DataFrame, days: Sequence[int] = RETENTION_DAYS) -> DataFrame:
    """The rows of a retention curve at the labelled days."""
    return curve.filter(F.col("day").isin(*[int(n) for n in days]))


def fit_retention_curve(
    curve: DataFrame, floor: float = 0.0, anchor_days: Sequence[int] | None = None
) -> DataFrame:
    """Power law through the curve: log(retention) = slope * log(day) + intercept.

    -> the curve plus slope, intercept and fitted_retention (never below `floor`).
    `anchor_days` limits the fit, not the output, to some days. Days with zero
    retention have no logarithm and do not take part in the fit.
    """
    points = curve.filter((F.col("retention") > 0) & (F.col("day") > 0))
    if anchor_days is not None:
        points = day_points(points, anchor_days)
    log_day, log_retention = F.log("day"), F.log("retention")
    line = points.agg(
        F.struct(
            F.regr_slope(log_retention, log_day).alias("slope"),
            F.regr_intercept(log_retention, log_day).alias("intercept"),
        )
    )
    first_day = F.greatest(F.col("day"), F.lit(1))
    fitted = F.exp(F.col("line.slope") * F.log(first_day) + F.col("line.intercept"))
    return curve.withColumn("line", line.scalar()).select(
        "day",
        "retention",
        "eligible_users",
        F.col("line.slope").alias("slope"),
        F.col("line.intercept").alias("intercept"),
        # greatest() skips NULLs; without a line there is no fitted value either
        F.when(F.col("line.slope").isNotNull(), F.greatest(fitted, F.lit(float(floor)))).alias(
            "fitted_retention"
        ),
    )
