"""Table definitions and the fixed vocabularies of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------
# Funnel stages in order; a stage's position is its stage_order (0..5).
FUNNEL_STAGES = (
    "app_open",
    "browse",
    "view_restaurant",
    "add_to_cart",
    "checkout_start",
    "order_placed",
)
# Traffic labels in order of severity; the position is the ordinal (0..3).
TRAFFIC_LEVELS = ("Low", "Medium", "High", "Jam")
# Minutes within which a delivery counts as on time.
SLA_MINUTES = 30
# Retention days reported per cohort.
RETENTION_DAYS = (1, 7, 30)
# Accepted band of orders per ordering user and month.
ORDERS_PER_USER_BAND = (3.6, 4.5)
# Allowed order value, low and high.
ORDER_VALUE_RANGE = (120.0, 1400.0)

# Column names of the raw order file, as spelled there.
RAW_ORDER_COLUMNS = (
    "ID",
    "Delivery_person_ID",
    "Delivery_person_Age",
    "Delivery_person_Ratings",
    "Restaurant_latitude",
    "Restaurant_longitude",
    "Delivery_location_latitude",
    "Delivery_location_longitude",
    "Order_Date",
    "Time_Orderd",
    "Time_Order_picked",
    "Weatherconditions",
    "Road_traffic_density",
    "Vehicle_condition",
    "Type_of_order",
    "Type_of_vehicle",
    "multiple_deliveries",
    "Festival",
    "City",
    "Time_taken(min)",
)

# Accepted labels per column, used by the domain checks.
DOMAINS = {
    "traffic_density": TRAFFIC_LEVELS,
    "festival": ("Yes", "No"),
    "city_type": ("Urban", "Metropolitian", "Semi-Urban"),
    "order_type": ("Snack", "Meal", "Drinks", "Buffet"),
    "city_tier": ("Metro", "Tier-1", "Tier-2"),
    "platform": ("iOS", "Android"),
    "stage": FUNNEL_STAGES,
    "arm": ("control", "treatment"),
}
# ----------------------------------------------------------------------------


def _table(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


REAL_ORDERS = _table(
    ("order_id", T.StringType()),
    ("delivery_person_id", T.StringType()),
    ("delivery_person_age", T.DoubleType()),
    ("delivery_person_rating", T.DoubleType()),
    ("order_datetime", T.TimestampNTZType()),
    ("pickup_datetime", T.TimestampNTZType()),
    ("prep_time_min", T.DoubleType()),
    ("distance_km", T.DoubleType()),
    ("weather", T.StringType()),
    ("traffic_density", T.StringType()),
    ("vehicle_condition", T.IntegerType()),
    ("order_type", T.StringType()),
    ("vehicle_type", T.StringType()),
    ("multiple_deliveries", T.DoubleType()),
    ("festival", T.StringType()),
    ("city_type", T.StringType()),
    ("time_taken_min", T.DoubleType()),
    ("on_time", T.BooleanType()),
)

USERS = _table(
    ("user_id", T.StringType()),
    ("signup_date", T.DateType()),
    ("city_tier", T.StringType()),
    ("platform", T.StringType()),
    ("acquisition_channel", T.StringType()),
    ("is_power_user", T.BooleanType()),
)

FUNNEL_EVENTS = _table(
    ("session_id", T.StringType()),
    ("user_id", T.StringType()),
    ("event_ts", T.TimestampNTZType()),
    ("stage", T.StringType()),
    ("stage_order", T.IntegerType()),
)

# Column order of the order files: the id comes last.
ORDERS = _table(
    ("session_id", T.StringType()),
    ("user_id", T.StringType()),
    ("order_ts", T.TimestampNTZType()),
    ("order_value", T.DoubleType()),
    ("order_id", T.StringType()),
)

AB_TEST = _table(
    ("checkout_session_id", T.StringType()),
    ("arm", T.StringType()),
    ("checkout_start_ts", T.TimestampNTZType()),
    ("order_placed", T.BooleanType()),
)

TABLES = {
    "real_orders": REAL_ORDERS,
    "synthetic_users": USERS,
    "synthetic_funnel_events": FUNNEL_EVENTS,
    "synthetic_orders": ORDERS,
    "synthetic_ab_test": AB_TEST,
}

PRIMARY_KEYS = {
    "real_orders": ("order_id",),
    "synthetic_users": ("user_id",),
    "synthetic_funnel_events": ("session_id", "stage"),
    "synthetic_orders": ("order_id",),
    "synthetic_ab_test": ("checkout_session_id",),
}

# Table, column, and the table whose key the column refers to.
FOREIGN_KEYS = (
    ("synthetic_funnel_events", "user_id", "synthetic_users"),
    ("synthetic_orders", "user_id", "synthetic_users"),
)
