"""Raw order records to the clean order table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.functions.geo import haversine_km
from platewise.functions.periods import minutes_between
from platewise.functions.text import as_whole, clock_parts, date_parts, known, number, stripped, timestamp_of, without
from platewise.schemas import RAW_ORDER_COLUMNS, SLA_MINUTES

# Longest plausible preparation, and the plausible distances.
MAX_PREP_MINUTES = 120
MIN_DISTANCE_KM = 0.05
MAX_DISTANCE_KM = 50
# Raw columns that hold numbers as they stand.
NUMERIC = (
    "Delivery_person_Age",
    "Delivery_person_Ratings",
    "Restaurant_latitude",
    "Restaurant_longitude",
    "Delivery_location_latitude",
    "Delivery_location_longitude",
    "Vehicle_condition",
    "multiple_deliveries",
)


def clean_orders(raw: DataFrame, sla_minutes: float = SLA_MINUTES) -> DataFrame:
    """Raw text records -> the 18 columns of the order table, row for row.

    Nothing is dropped: bad fields become NULL. No shuffle; every projection is narrow, and
    each computes a value that the next uses more than once, so that it is computed once. A
    column of the result reads the raw columns that it is made of, and no others.
    """
    df = raw.toDF(*[c.strip() for c in raw.columns])
    missing = [c for c in RAW_ORDER_COLUMNS if c not in df.columns]
    if missing:
        raise ValueError(f"raw orders lack the columns {missing}")
    field = {name: F.col(f"`{name}`") for name in RAW_ORDER_COLUMNS}
    texts = df.select(*[stripped(c.cast("string")).alias(name) for name, c in field.items()])
    unpacked = {
        "Weatherconditions": stripped(without(known(field["Weatherconditions"]), "conditions ")),
        "Time_taken(min)": without(known(field["Time_taken(min)"]), "(min) "),
    }
    texts = texts.select(*[unpacked.get(name, known(c)).alias(name) for name, c in field.items()])
    text_columns = ["order_id", "delivery_person_id", "traffic_density", "order_type", "vehicle_type", "festival", "city_type"]
    values = texts.select(
        field["ID"].alias("order_id"),
        field["Delivery_person_ID"].alias("delivery_person_id"),
        field["Road_traffic_density"].alias("traffic_density"),
        field["Type_of_order"].alias("order_type"),
        field["Type_of_vehicle"].alias("vehicle_type"),
        field["Festival"].alias("festival"),
        field["City"].alias("city_type"),
        known(field["Weatherconditions"]).alias("weather"),
        date_parts(field["Order_Date"]).alias("date"),
        clock_parts(field["Time_Orderd"]).alias("ordered"),
        clock_parts(field["Time_Order_picked"]).alias("picked"),
        *[number(field[name]).alias(name) for name in NUMERIC],
        number(field["Time_taken(min)"]).alias("time_taken_min"),
    )
    parsed = values.select(
        *text_columns,
        "weather",
        timestamp_of(F.col("date"), F.col("ordered")).alias("order_datetime"),
        timestamp_of(F.col("date"), F.col("picked")).alias("same_day_pickup"),
        F.col("Delivery_person_Age").alias("delivery_person_age"),
        F.col("Delivery_person_Ratings").alias("delivery_person_rating"),
        F.col("Restaurant_latitude").alias("lat1"),
        F.col("Restaurant_longitude").alias("lon1"),
        F.col("Delivery_location_latitude").alias("lat2"),
        F.col("Delivery_location_longitude").alias("lon2"),
        as_whole(F.col("Vehicle_condition")).alias("vehicle_condition"),
        "multiple_deliveries",
        "time_taken_min",
    )

    # A pickup that reads earlier than the order happened after midnight.
    pickup = F.col("same_day_pickup")
    rolled = F.when(pickup < F.col("order_datetime"), pickup + F.expr("interval 1 day")).otherwise(pickup)
    distance = haversine_km(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    derived = parsed.withColumns({"pickup_datetime": rolled, "distance": distance})

    prep = minutes_between(F.col("order_datetime"), F.col("pickup_datetime"))
    return derived.select(
        "order_id",
        "delivery_person_id",
        "delivery_person_age",
        "delivery_person_rating",
        "order_datetime",
        "pickup_datetime",
        F.when(prep.between(0, MAX_PREP_MINUTES), prep).alias("prep_time_min"),
        F.when(
            (F.col("distance") > MIN_DISTANCE_KM) & (F.col("distance") <= MAX_DISTANCE_KM), F.col("distance")
        ).alias("distance_km"),
        "weather",
        "traffic_density",
        "vehicle_condition",
        "order_type",
        "vehicle_type",
        "multiple_deliveries",
        "festival",
        "city_type",
        "time_taken_min",
        F.coalesce(F.col("time_taken_min") <= sla_minutes, F.lit(False)).alias("on_time"),
    )
