"""Growth figures that are kept up day by day: new events and orders are merged into a store.

The store holds what the figures follow from, not the events: one row per user and month with a
bit per active day, by month, and one row per ordering user and day, by day. Adding a batch reads
the months that the batch touches and nothing else, and replaces those; a batch added twice
changes nothing, provided that it holds all orders of its days.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.operators.growth import OPEN_STAGE, activity_state, growth_from_states, merged_activity, order_state
from platewise.sources.shared import exists, removed
from platewise.sources.writers import write_days

ACTIVITY, ORDERS = "activity", "orders"


def add_batch(spark: SparkSession, store: str, events: DataFrame, orders: DataFrame, open_stage: str = OPEN_STAGE) -> None:
    """Merge new events into the store; `orders` holds all orders of the days that it has any of."""
    write_days(order_state(orders), f"{store}/{ORDERS}")
    # the batch's own state is written first: what it touches is then known without a second look at the events
    fresh, merged = f"{store}/_fresh-{uuid.uuid4().hex}", f"{store}/_merged-{uuid.uuid4().hex}"
    try:
        activity_state(events, open_stage).write.parquet(fresh)
        new = spark.read.parquet(fresh)
        if exists(spark, f"{store}/{ACTIVITY}"):
            # at most one row per calendar month; a filter on them reads those folders alone
            months = [row.month for row in new.select("month").distinct().collect()]
            before = spark.read.parquet(f"{store}/{ACTIVITY}").filter(F.col("month").isin(months)).select(*new.columns)
            # the folders read here are replaced below, so the result is put down in between
            merged_activity(before, new).write.parquet(merged)
            new = spark.read.parquet(merged)
        write_days(new, f"{store}/{ACTIVITY}", "month")
    finally:
        for path in (fresh, merged):
            removed(spark, path)


def growth(spark: SparkSession, store: str) -> DataFrame:
    """`growth_monthly` of everything added so far."""
    return growth_from_states(spark.read.parquet(f"{store}/{ACTIVITY}"), spark.read.parquet(f"{store}/{ORDERS}"))
