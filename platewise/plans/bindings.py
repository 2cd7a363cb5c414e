"""The sample tables (orders, lineitem, events, customer) as the model tables.

The samples have no sessions, signups or deliveries, so each model table is defined
here once over them, always over all of their rows.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

STAGES = ("view", "click", "signup", "purchase")
OPEN_STAGE = STAGES[0]
ANALYSIS_END = date(2024, 1, 20)
DAYS = (1, 7, 14, 30)
TRAFFIC = ("5-LOW", "3-MEDIUM", "2-HIGH", "1-URGENT")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def funnel_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session is one user's day; error events are no stage."""
    stage = F.col("event_type")
    order = F.lit(None).cast("int")
    for i, name in enumerate(STAGES):
        order = F.when(stage == name, i).otherwise(order)
    return (
        table(spark, sf_dir, "events")
        .filter(stage != "error")
        .select(
            F.concat_ws("-", F.col("user_id").cast("string"), F.to_date("ts").cast("string")).alias("session_id"),
            "user_id",
            F.col("ts").alias("event_ts"),
            stage.alias("stage"),
            order.alias("stage_order"),
            "value",
        )
    )


def all_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event, errors too. The recorded order comes from the event's number, so it
    often differs from that of the stage."""
    return table(spark, sf_dir, "events").select(
        F.concat_ws("-", F.col("user_id").cast("string"), F.to_date("ts").cast("string")).alias("session_id"),
        F.col("event_type").alias("stage"),
        (F.col("event_id") % 4).cast("int").alias("stage_order"),
    )


TYPED = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("event_ts", T.TimestampNTZType()),
        T.StructField("day", T.DateType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("stage_order", T.IntegerType()),
        T.StructField("stage", T.StringType()),
        T.StructField("purchased", T.BooleanType()),
    ]
)


def event_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as the text fields of a file: empty fields, stray carriage returns,
    numbers that are none or too large."""
    n = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        n.cast("string").alias("event_id"),
        F.when(n % 37 == 0, "soon").otherwise(F.col("ts").cast("string")).alias("event_ts"),
        F.concat(F.to_date("ts").cast("string"), F.when(n % 3 == 0, "\r").otherwise("")).alias("day"),
        F.when(n % 41 == 0, "NaN").otherwise(F.concat(F.lit(" "), F.col("value").cast("string"))).alias("value"),
        F.when(n % 43 == 0, "1e20").when(n % 47 == 0, "2.7").otherwise((n % 4).cast("string")).alias("stage_order"),
        F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type")).alias("stage"),
        F.when(F.col("event_type") == "purchase", "True\r").otherwise("False").alias("purchased"),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user of the events, signed up on one of the first 20 days of 2024."""
    offset = (F.col("user_id") % 20).cast("int")
    return (
        table(spark, sf_dir, "events")
        .select("user_id")
        .distinct()
        .select("user_id", F.date_add(F.lit(date(2024, 1, 1)), offset).alias("signup_date"))
    )


def event_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases as orders."""
    return (
        funnel_events(spark, sf_dir)
        .filter(F.col("stage") == "purchase")
        .select("session_id", "user_id", F.col("event_ts").alias("order_ts"), F.col("value").alias("order_value"))
    )


def order_opens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as an app open of its customer."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("event_ts"), F.lit(OPEN_STAGE).alias("stage")
    )


def shop_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order, whatever its status."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderdate").alias("order_ts"),
        F.col("o_totalprice").alias("order_value"),
    )


def event_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The users that any event names."""
    return table(spark, sf_dir, "events").select("user_id").distinct()


def line_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as deliveries, with the attributes the line itself carries."""
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        F.col("l_quantity").alias("time_taken_min"),
        (F.col("l_quantity") <= 30).alias("on_time"),
        (F.col("l_extendedprice") / 1000).alias("distance_km"),
        F.col("l_linenumber").cast("double").alias("multiple_deliveries"),
        F.col("l_returnflag").alias("weather"),
        F.col("l_linestatus").alias("festival"),
    )


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as deliveries, with traffic and city from the order.

    A left join: a line without its order keeps its own attributes, which is why
    breakdowns by those need `line_deliveries` only, and no join.
    """
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"),
        F.nullif("o_orderpriority", F.lit("4-NOT SPECIFIED")).alias("traffic_density"),
        F.col("o_orderstatus").alias("city_type"),
    )
    return line_deliveries(spark, sf_dir).join(orders, "l_orderkey", "left")


def ab_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per user and day of any event; even users are the control arm."""
    return (
        table(spark, sf_dir, "events")
        .groupBy("user_id", F.to_date("ts").alias("day"))
        .agg(F.max(F.col("event_type") == "purchase").alias("order_placed"))
        .select(F.when(F.col("user_id") % 2 == 0, "control").otherwise("treatment").alias("arm"), "order_placed")
    )


def _decimal_text(hundredths: Column) -> Column:
    whole = F.floor(hundredths / 100).cast("string")
    return F.concat(whole, F.lit("."), F.lpad((hundredths % 100).cast("string"), 2, "0"))


def _clock_text(minutes: Column) -> Column:
    hour, minute = F.floor(minutes / 60).cast("string"), (minutes % 60).cast("string")
    return F.concat(F.lpad(hour, 2, "0"), F.lit(":"), F.lpad(minute, 2, "0"), F.lit(":00"))


def _pick(index: Column, texts: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(t) for t in texts]), index.cast("int") + 1)


def raw_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines written out as raw text records: fields padded with blanks, tabs and
    carriage returns, 'NaN ' sentinels, numbers out of range, impossible dates and clocks, and coordinates that are too close or too far."""
    o, p, s = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")
    line = F.col("l_linenumber")

    def spoilt(condition: Column, text: str, otherwise: Column) -> Column:
        return F.when(condition, text).otherwise(otherwise)

    ordered = (p % 24) * 60 + s % 60
    picked = (ordered + line * 25) % 1440
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit(" "), o.cast("string"), F.lit("-"), line.cast("string"), F.lit(" ")).alias("ID "),
        F.concat(F.lit("DP"), s.cast("string"), F.lit("  ")).alias("Delivery_person_ID"),
        spoilt(p % 7 == 0, "NaN ", F.concat((18 + p % 40).cast("string"), F.lit(" "))).alias(" Delivery_person_Age"),
        spoilt(s % 9 == 0, "NaN ", _decimal_text((s % 50) * 10)).alias("Delivery_person_Ratings"),
        _decimal_text(1000 + p % 1000).alias("Restaurant_latitude"),
        _decimal_text(7000 + line * 10).alias("Restaurant_longitude"),
        _decimal_text(1000 + p % 1000 + s % 60).alias("Delivery_location_latitude"),
        _decimal_text(7000 + line * 10 + o % 3).alias("Delivery_location_longitude"),
        spoilt(o % 101 == 0, "31-02-2022", F.date_format("l_shipdate", "dd-MM-yyyy")).alias("Order_Date"),
        spoilt(o % 11 == 0, "NaN ", spoilt(o % 13 == 0, "24:05:00", _clock_text(ordered))).alias("Time_Orderd"),
        _clock_text(picked).alias("Time_Order_picked"),
        F.concat(
            F.lit("conditions "),
            spoilt(
                o % 17 == 0, "NaN", F.replace(F.replace("l_returnflag", F.lit("A"), F.lit("Fog")), F.lit("N"), F.lit("Sunny"))
            ),
        ).alias("Weatherconditions"),
        _pick(p % 5, ("Low\t", "Medium ", "\tHigh \r", "Jam ", "NaN\t")).alias("Road_traffic_density"),
        spoilt(o % 29 == 0, "1e20", spoilt(o % 31 == 0, "2.7", (line % 4).cast("string"))).alias("Vehicle_condition"),
        _pick(s % 4, ("Snack ", "Meal ", "Drinks ", "Buffet ")).alias("Type_of_order"),
        _pick(s % 2, ("motorcycle ", "scooter ")).alias("Type_of_vehicle"),
        spoilt(o % 19 == 0, "NaN ", (line % 4).cast("string")).alias("multiple_deliveries"),
        spoilt(o % 50 == 0, "Yes ", spoilt(o % 51 == 0, "NaN ", F.lit("No "))).alias("Festival"),
        _pick(s % 3, ("Metropolitian ", "Urban ", "Semi-Urban ")).alias("City"),
        F.concat(
            F.lit("(min) "), spoilt(o % 23 == 0, "NaN", F.col("l_quantity").cast("int").cast("string"))
        ).alias("Time_taken(min)"),
    )
