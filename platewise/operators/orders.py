"""Orders taken out of the funnel events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.operators.ordering import row_positions
from platewise.schemas import FUNNEL_STAGES

FIRST_ORDER_NUMBER = 100000  # fixed value


def orders_from_events(
    events: DataFrame,
    value: Column,
    order_stage: str = FUNNEL_STAGES[-1],
    order_by: Sequence[str] = ("order_ts", "session_id"),
    value_range: tuple[float, float] | None = None,
    ranges: int | None = None,
) -> DataFrame:
    """One order per event of the order stage
    -> session_id, user_id, order_ts, order_value, order_id

    `value` is a column over the events, rounded to 2 decimals; with `value_range` it is
    clamped to that first (`ORDER_VALUE_RANGE` holds the published one). Ids are 'O100000',
    'O100001', ... in `order_by` order; rows that tie are ordered by their other columns.
    """
    clamped = value.cast("double")
    if value_range is not None:
        low, high = value_range
        clamped = F.greatest(F.least(clamped, F.lit(float(high))), F.lit(float(low)))
    placed = events.filter(F.col("stage") == order_stage).select(
        "session_id",
        "user_id",
        F.col("event_ts").alias("order_ts"),
        F.when(value.isNotNull(), F.round(clamped, 2)).alias("order_value"),
    )
    rest = [c for c in ("order_ts", "session_id", "user_id", "order_value") if c not in order_by]
    numbered = row_positions(placed, [*order_by, *rest], "position", ranges)
    order_id = F.concat(F.lit("O"), (F.col("position") + FIRST_ORDER_NUMBER).cast("string"))
    return numbered.select("session_id", "user_id", "order_ts", "order_value", order_id.alias("order_id"))
