"""Reports that draw on several operators."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.functions.numbers import open_ratio, ordinal, ratio
from platewise.functions.periods import day, month_label, month_start
from platewise.operators.delivery import on_time_share
from platewise.operators.experiment import ab_readout
from platewise.operators.funnel import funnel
from platewise.operators.growth import growth_monthly
from platewise.operators.sessions import has_bit, stage_words, union_all
from platewise.schemas import FUNNEL_STAGES, ORDERS_PER_USER_BAND, RETENTION_DAYS


def _cells(users: DataFrame, events: DataFrame, orders: DataFrame | None, stages: Sequence[str], order_stage: str | None) -> DataFrame:
    """Every input row as tagged cells of one shape -> tag, user_id, session_id, at, position, value

    An event is a cell of its session and, where it opens the app, one of its user's day; where
    orders are events of a stage, also one of its user's month. So each input is read once.
    """
    kinds = dict(events.dtypes)
    none = lambda kind: F.lit(None).cast(kind)

    def cell(tag: str, user=None, session=None, at=None, position=None, value=None) -> Column:
        parts = {"user_id": (user, kinds["user_id"]), "session_id": (session, kinds["session_id"]), "at": (at, "date"), "position": (position, "int"), "value": (value, "double")}
        return F.struct(F.lit(tag).alias("tag"), *[(none(kind) if c is None else c.cast(kind)).alias(n) for n, (c, kind) in parts.items()])

    user, ts, stage = F.col("user_id"), F.col("event_ts"), F.col("stage")
    opened = (stage == stages[0]) & user.isNotNull() & ts.isNotNull()
    cells = [cell("event", session=F.col("session_id"), position=ordinal(stage, stages)), F.when(opened, cell("open", user, at=day(ts)))]
    if orders is None:
        cells.append(F.when(stage == order_stage, cell("order", user, at=month_start(ts), value=F.col("value"))))
    rows = [events.select(F.explode(F.array(*cells)).alias("cell")).filter("cell is not null")]
    rows.append(users.select(cell("user", user, at=F.col("signup_date")).alias("cell")))
    if orders is not None:
        rows.append(orders.select(cell("order", user, at=month_start(F.col("order_ts")), value=F.col("order_value")).alias("cell")))
    return union_all(rows).select("cell.*")


def calibration_report(
    users: DataFrame,
    events: DataFrame,
    orders: DataFrame | None,
    analysis_end: date,
    stages: Sequence[str] = FUNNEL_STAGES,
    days: Sequence[int] = RETENTION_DAYS,
    band: tuple[float, float] = ORDERS_PER_USER_BAND,
    order_stage: str | None = None,
) -> DataFrame:
    """Headline figures of a data set -> metric, value, low, high, in_band

    Table sizes, mean order value, orders per ordering user and month (against the
    band; orders of known users only), sessions per stage, overall conversion and
    pooled retention, whose active users are not limited to eligible ones.

    One scan of each input and three aggregates in a row: to sessions, user-days and
    user-months; to users; to months. Without `orders`, the events of `order_stage` are the
    orders, at their `value`. A user's row holds at most one entry per calendar day.
    """
    if (orders is None) == (order_stage is None):
        raise ValueError("orders are either a table or the events of a stage")
    days = [int(n) for n in days]
    end, tag = F.lit(analysis_end), F.col("tag")
    # sessions, users by signup date, user-days, user-months
    fine = _cells(users, events, orders, stages, order_stage).groupBy("tag", "user_id", "session_id", "at").agg(
        F.count("*").alias("n"),
        stage_words(F.col("position"), len(stages)).alias("words"),
        F.sum("value").alias("value"),
        F.count("value").alias("valued"),
    )

    def of(name: str, value: str) -> Column:
        return F.coalesce(F.sum(F.when(tag == name, F.col(value))), F.lit(0))

    dated = F.struct("at", "n")
    # users; all sessions are one group, added up before the shuffle
    per_user = fine.groupBy((tag == "event").alias("is_event"), "user_id").agg(
        of("user", "n").alias("users"),
        of("event", "n").alias("events"),
        of("order", "n").alias("orders"),
        F.sum("value").alias("value"),
        F.sum("valued").alias("valued"),
        *[F.count_if((tag == "event") & F.col("session_id").isNotNull() & has_bit("words", k)).alias(f"at_{k}") for k in range(len(stages))],
        F.collect_list(F.when(tag == "user", dated)).alias("signups"),
        F.collect_list(F.when(tag == "open", F.col("at"))).alias("opens"),
        F.collect_list(F.when((tag == "order") & F.col("at").isNotNull(), dated)).alias("months"),
    )
    known = (F.size("signups") > 0) & F.col("user_id").isNotNull()
    signup = F.array_min(F.transform("signups", lambda s: s["at"]))
    reached = lambda n: F.aggregate(
        "signups", F.lit(0).cast("bigint"), lambda total, s: total + F.when(s["at"] <= F.date_sub(end, n), s["n"]).otherwise(0)
    )
    totals = ["users", "events", "orders", "value", "valued", *[f"at_{k}" for k in range(len(stages))]]
    per_user = per_user.select(
        *totals,
        *[reached(n).alias(f"eligible_{n}") for n in days],
        *[(known & F.coalesce(F.array_contains("opens", F.date_add(signup, n)), F.lit(False))).cast("bigint").alias(f"active_{n}") for n in days],
        # the user's totals under no month, and each month's orders if the user is known
        F.explode(F.concat(F.array(F.struct(F.lit(None).cast("date").alias("at"), F.lit(0).cast("bigint").alias("n"))), F.when(known, F.col("months")).otherwise(F.array()))).alias("month"),
    )
    totals += [f"{kind}_{n}" for kind in ("eligible", "active") for n in days]
    per_month = per_user.groupBy("month.at").agg(F.sum("month.n").alias("n"), F.count("*").alias("buyers"), *[F.sum(c).alias(c) for c in totals])
    # one row from here on
    is_total = F.col("at").isNull()
    months = F.collect_list(F.when(~is_total, F.struct("at", ratio(F.col("n"), F.col("buyers")).alias("per_user"))))
    row = per_month.agg(months.alias("months"), *[F.coalesce(F.max(F.when(is_total, F.col(c))), F.lit(0)).alias(c) for c in totals])

    def metric(name: Column | str, value: Column) -> Column:
        return F.struct((F.lit(name) if isinstance(name, str) else name).alias("metric"), value.cast("double").alias("value"))

    at = [F.col(f"at_{k}") for k in range(len(stages))]
    figures = [
        metric("users", F.col("users")),
        metric("funnel_event_rows", F.col("events")),
        metric("orders", F.col("orders")),
        metric("aov_mean", F.round(ratio(F.col("value"), F.col("valued")), 2)),
        *[metric(f"sessions:{stage}", at[k]) for k, stage in enumerate(stages)],
        metric("overall_conversion", F.round(open_ratio(at[-1], at[0]), 4)),
    ]
    retention = [metric(f"D{n}_retention", ratio(F.col(f"active_{n}"), F.col(f"eligible_{n}"))) for n in days]
    per_month_name = lambda m: F.concat(F.lit("orders_per_ordering_user:"), month_label(m["at"]))
    every = F.concat(
        F.array(*figures),
        F.when(F.col("users") > 0, F.array(*retention)).otherwise(F.array()),
        F.transform("months", lambda m: metric(per_month_name(m), m["per_user"])),
    )
    low, high = (F.lit(float(edge)) for edge in band)
    return _banded(row.select(F.explode(every).alias("row")).select("row.*"), low, high)


def _banded(rows: DataFrame, low: Column, high: Column) -> DataFrame:
    banded = F.col("metric").startswith("orders_per_ordering_user:")
    return rows.select(
        "metric",
        "value",
        F.when(banded, low).alias("low"),
        F.when(banded, high).alias("high"),
        F.when(banded, F.col("value").between(low, high)).alias("in_band"),
    )


def key_numbers(
    delivery_orders: DataFrame,
    events: DataFrame,
    orders: DataFrame,
    ab: DataFrame,
    stages: Sequence[str] = FUNNEL_STAGES,
) -> DataFrame:
    """The headline, one row -> on_time_pct, first_session_conversion_pct,
    last_month_orders_per_ordering_user, decision, p_value"""
    conversion = funnel(events, stages, "first_session").filter(F.col("stage") == stages[-1])
    last_month = growth_monthly(events, orders, stages[0]).agg(
        F.max_by("orders_per_ordering_user", "month")
    )
    return ab_readout(ab).select(
        F.round(on_time_share(delivery_orders).scalar() * 100, 1).alias("on_time_pct"),
        F.round(conversion.select("conversion_from_top").scalar() * 100, 2).alias("first_session_conversion_pct"),
        F.round(last_month.scalar(), 2).alias("last_month_orders_per_ordering_user"),
        "decision",
        F.round("p_value_ztest", 5).alias("p_value"),
    )
