"""Whole tables written to the shared folder by the sinks and read back by the sources.

A name is written twice where a rerun must leave one copy. What a query writes goes when the
application ends.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.functions.periods import month_start
from platewise.operators.delivery import on_time_share
from platewise.plans import bindings as b
from platewise.sources.readers import read_csv_table
from platewise.sources.shared import removed, shared_folder
from platewise.sources.writers import write_csv, write_days, write_scalar


def _place(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    removed(spark, path, at_end=True)
    return path


def file_load(spark: SparkSession, sf: str) -> DataFrame:
    """Every event as text in CSV files, written over what was there, read with types."""
    path, texts = _place(spark, "file-load"), b.event_texts(spark, sf)
    write_csv(texts.select(*[F.lit("stale").alias(c) for c in texts.columns]).limit(3), path)
    write_csv(texts, path)
    return read_csv_table(spark, path, b.TYPED)


def scalar_file(spark: SparkSession, sf: str) -> DataFrame:
    """The on-time share as the one line of a text file."""
    path = _place(spark, "scalar-file")
    for _ in range(2):
        write_scalar(on_time_share(b.line_deliveries(spark, sf)), path)
    return spark.read.text(path).withColumnRenamed("value", "line")


def months_replaced(spark: SparkSession, sf: str) -> DataFrame:
    """A store of orders by month in which the months of 1995 are loaded again, with other prices."""
    path = _place(spark, "months-replaced")
    orders = b.shop_orders(spark, sf).select("order_id", "order_value", month_start(F.col("order_ts")).alias("month"))
    write_days(orders, path, "month")
    again = orders.filter(F.year("month") == 1995).withColumn("order_value", F.lit(0.0))
    for _ in range(2):
        write_days(again, path, "month")
    return spark.read.parquet(path).groupBy("month").agg(F.count("*").alias("orders"), F.max("order_value").alias("largest"))
