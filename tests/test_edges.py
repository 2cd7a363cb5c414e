"""One small case per rule."""

import math
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from platewise.functions.tails import f_tail, norm_cdf, norm_sf, register_sql_functions, two_sided_normal_p
from platewise.functions.text import number, trimmed, true_text
from platewise.operators import experiment, quality
from platewise.operators.cleaning import clean_orders
from platewise.operators.delivery import delay_combos, delay_stats, delivery_by, delivery_by_traffic, delivery_overall
from platewise.operators.experiment import ab_readout, ab_ztest
from platewise.operators.funnel import funnel, funnel_by_depth
from platewise.operators.growth import growth_monthly, growth_monthly_split, lifetime_repeat_rate, orders_monthly, wau
from platewise.operators.orders import orders_from_events
from platewise.operators.report import calibration_report
from platewise.operators.retention import (
    cohort_retention,
    cohort_retention_wide,
    fit_retention_curve,
    pooled_retention,
    retention_curve,
)
from platewise.operators.statistics import anova, pearson, spearman_ordinal, with_p_value
from platewise.schemas import RAW_ORDER_COLUMNS

EVENTS = "session_id string, user_id string, event_ts timestamp_ntz, stage string, stage_order int"
STAGES = ("a", "b", "c")


def ts(text):
    return datetime.fromisoformat(text)


# --- text ------------------------------------------------------------------------
@pytest.mark.parametrize(
    "text, value",
    [(" 24 ", 24.0), ("NaN ", None), ("", None), ("abc", None), ("1e3", 1000.0), ("1.5d", None), ("2F", None),
     ("-3.5", -3.5), (None, None), ("0x1p3", None)],
)
def test_number(table, rows, text, value):
    assert rows(table("t string", (text,)).select(number(F.col("t")))) == [(value,)]


@pytest.mark.parametrize("text, value", [("  Low ", "Low"), ("NaN ", None), ("nan", None), ("", None), (None, None)])
def test_trimmed(table, rows, text, value):
    assert rows(table("t string", (text,)).select(trimmed(F.col("t")))) == [(value,)]


@pytest.mark.parametrize("text, value", [("True", True), ("True\r", True), ("False", False), ("true", False), (None, False)])
def test_true_text(table, rows, text, value):
    assert rows(table("t string", (text,)).select(true_text(F.col("t")))) == [(value,)]


# --- cleaning --------------------------------------------------------------------
GOOD = {
    "ID": " 0xa1 ", "Delivery_person_ID": "P1 ", "Delivery_person_Age": "37 ", "Delivery_person_Ratings": "4.9",
    "Restaurant_latitude": "12.97", "Restaurant_longitude": "77.59", "Delivery_location_latitude": "13.0",
    "Delivery_location_longitude": "77.62", "Order_Date": "19-03-2022", "Time_Orderd": "11:30:00",
    "Time_Order_picked": "11:45:00", "Weatherconditions": "conditions Sunny", "Road_traffic_density": "High ",
    "Vehicle_condition": "2", "Type_of_order": "Snack ", "Type_of_vehicle": "motorcycle ",
    "multiple_deliveries": "0", "Festival": "No ", "City": "Urban ", "Time_taken(min)": "(min) 24",
}


@pytest.fixture
def clean(spark):
    def one(**changes):
        record = {**GOOD, **{k.replace("Time_taken", "Time_taken(min)"): v for k, v in changes.items()}}
        names = [f" {c} " for c in RAW_ORDER_COLUMNS]
        raw = spark.createDataFrame([tuple(record[c] for c in RAW_ORDER_COLUMNS)], ", ".join(f"`{n}` string" for n in names))
        (row,) = clean_orders(raw).collect()
        return row

    return one


def test_clean_row(clean):
    r = clean()
    assert (r.order_id, r.delivery_person_id, r.delivery_person_age, r.delivery_person_rating) == ("0xa1", "P1", 37.0, 4.9)
    assert (r.order_datetime, r.pickup_datetime, r.prep_time_min) == (ts("2022-03-19T11:30"), ts("2022-03-19T11:45"), 15.0)
    assert (r.weather, r.traffic_density, r.vehicle_condition, r.order_type) == ("Sunny", "High", 2, "Snack")
    assert (r.vehicle_type, r.multiple_deliveries, r.festival, r.city_type) == ("motorcycle", 0.0, "No", "Urban")
    assert (r.time_taken_min, r.on_time) == (24.0, True)
    a, b = math.radians(12.97), math.radians(13.0)
    h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(0.03) / 2) ** 2
    assert r.distance_km == pytest.approx(2 * 6371.0 * math.asin(math.sqrt(h)), rel=1e-9)


def test_missing_time_is_late(clean):
    r = clean(Time_taken="(min) NaN")
    assert r.time_taken_min is None and r.on_time is False


@pytest.mark.parametrize("minutes, on_time", [("30", True), ("31", False)])
def test_sla_boundary(clean, minutes, on_time):
    assert clean(Time_taken=f"(min) {minutes}").on_time is on_time


def test_missing_age_is_null_not_nan(clean):
    assert clean(Delivery_person_Age="NaN ").delivery_person_age is None


def test_bad_clock(clean):
    r = clean(Time_Orderd="24:05:00")
    assert r.order_datetime is None and r.prep_time_min is None and r.pickup_datetime == ts("2022-03-19T11:45")
    assert clean(Order_Date="31-02-2022").pickup_datetime is None
    assert clean(Time_Order_picked="NaN ").pickup_datetime is None


def test_pickup_after_midnight(clean):
    r = clean(Time_Orderd="23:50:00", Time_Order_picked="00:10:00")
    assert r.pickup_datetime == ts("2022-03-20T00:10") and r.prep_time_min == 20.0


@pytest.mark.parametrize("clock", ["11:30", "11:30:60", "11:30:00:00", "11:30:00.5", "x:30:00", "-1:30:00", ""])
def test_malformed_clock(clean, clock):
    assert clean(Time_Orderd=clock).order_datetime is None


@pytest.mark.parametrize("day", ["2022-03-19", "19-03-22", "19/03/2022", "00-03-2022", "19-13-2022"])
def test_malformed_date(clean, day):
    assert clean(Order_Date=day).order_datetime is None


def test_single_digits(clean):
    assert clean(Order_Date="9-3-2022", Time_Orderd="9:5:3").order_datetime == ts("2022-03-09T09:05:03")


def test_the_session_time_zone_does_not_matter(spark, clean, table, rows):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:  # 02:30 does not exist there on that day
        r = clean(Order_Date="13-03-2022", Time_Orderd="02:30:00", Time_Order_picked="03:10:00")
        opens = table(OPENS, ("u", ts("2022-03-13T02:30"), "app_open"))
        assert rows(wau(opens)) == [(date(2022, 3, 7), 1)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert r.order_datetime == ts("2022-03-13T02:30") and r.prep_time_min == 40.0


def test_long_preparation_is_dropped_but_not_the_times(clean):
    r = clean(Time_Orderd="10:00:00", Time_Order_picked="12:30:00")
    assert r.prep_time_min is None and r.pickup_datetime == ts("2022-03-19T12:30")
    assert clean(Time_Orderd="10:00:00", Time_Order_picked="12:00:00").prep_time_min == 120.0


@pytest.mark.parametrize("lat", ["12.97", "22.97", "NaN "])
def test_implausible_distance(clean, lat):
    assert clean(Delivery_location_latitude=lat, Delivery_location_longitude="77.59").distance_km is None


def test_missing_weather(clean):
    assert clean(Weatherconditions="conditions NaN").weather is None


def test_missing_column(table):
    with pytest.raises(ValueError, match="lack the columns"):
        clean_orders(table("ID string", ("1",)))


# --- funnel ----------------------------------------------------------------------
def test_equal_starts_go_to_the_lower_session(table, rows):
    t = ts("2024-01-01T10:00")
    df = table(EVENTS, ("s2", "u", t, "a", 0), ("s2", "u", t, "b", 1), ("s1", "u", t, "a", 0))
    assert [r[1] for r in rows(funnel(df, STAGES))] == [1, 0, 0]


def test_skipped_stage(table, rows):
    df = table(EVENTS, ("s", "u", ts("2024-01-01"), "a", 0), ("s", "u", ts("2024-01-01"), "c", 2))
    assert [r[1] for r in rows(funnel(df, STAGES, "blended"))] == [1, 0, 1]
    assert [r[3] for r in rows(funnel_by_depth(df, STAGES))] == [1, 1, 1, 1, 1, 1]
    seen = rows(funnel(df, STAGES, "blended"))
    assert seen[2][2] == math.inf  # 1 / 0, as float division has it
    violations = {r.check: r.violations for r in quality.stage_violations(df, STAGES).collect()}
    assert violations == {"stage_order_mismatch": 0, "incomplete_prefix": 1}


def test_two_empty_stages_convert_at_one(table, rows):
    df = table(EVENTS, ("s", "u", ts("2024-01-01"), "a", 0))
    got = rows(funnel(df, STAGES))
    assert got == [("a", 1, 1.0, 0.0, 1.0), ("b", 0, 0.0, 1.0, 0.0), ("c", 0, 1.0, 0.0, 0.0)]
    assert [r[4] for r in rows(funnel_by_depth(df, STAGES))] == [None, 0.0, None] * 2


def test_no_event_at_all(table, rows):
    df = table(EVENTS)
    assert [(r[1], r[4]) for r in rows(funnel(df, STAGES))] == [(0, None)] * 3
    assert [r[3] for r in rows(funnel_by_depth(df, STAGES))] == [0] * 6


def test_unknown_user_and_unknown_stage(table, rows):
    df = table(
        EVENTS,
        ("s1", None, ts("2024-01-01"), "a", 0),
        ("s2", "u", ts("2024-01-02"), "a", 0),
        ("s2", "u", ts("2024-01-02"), "zzz", 9),
        (None, "u", ts("2023-01-02"), "b", 1),
    )
    assert [r[1] for r in rows(funnel(df, STAGES))] == [1, 0, 0]
    assert [r[1] for r in rows(funnel(df, STAGES, "blended"))] == [2, 0, 0]


def test_one_user_with_a_third_of_all_sessions(spark, rows):
    df = spark.range(30000).selectExpr(
        "concat('s', id) AS session_id",
        "if(id % 3 = 0, 'hot', concat('u', id)) AS user_id",
        "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, cast(id as int)) AS event_ts",
        "'a' AS stage",
        "0 AS stage_order",
    )
    assert [r[1] for r in rows(funnel(df, STAGES))] == [20001, 0, 0]
    assert [r[3] for r in rows(funnel_by_depth(df, STAGES))] == [30000, 0, 0, 20001, 0, 0]


# --- retention -------------------------------------------------------------------
END = date(2024, 1, 20)


@pytest.fixture
def retention_tables(table):
    users = table("user_id string, signup_date date", ("u1", date(2024, 1, 13)), ("u2", date(2024, 1, 14)))
    opens = table(
        "user_id string, event_ts timestamp_ntz, stage string",
        ("u1", ts("2024-01-20T09:00"), "app_open"),
        ("u1", ts("2024-01-20T21:00"), "app_open"),
        ("u2", ts("2024-01-21T09:00"), "app_open"),  # after the cutoff
        ("u2", ts("2024-01-15T09:00"), "browse"),
        ("u1", ts("2024-01-01T09:00"), "app_open"),  # before signup
        ("ghost", ts("2024-01-20T09:00"), "app_open"),
    )
    return users, opens


def test_signup_at_the_cutoff_is_eligible(retention_tables, rows):
    # u2 is not eligible for day 7, but counts as active in the long form.
    assert rows(cohort_retention(*retention_tables, END, days=(7,))) == [(date(2024, 1, 1), 7, 1, 2, 2.0)]
    assert rows(cohort_retention_wide(*retention_tables, END, days=(7,))) == [("2024-01", 2, 1.0, 1)]
    assert rows(pooled_retention(*retention_tables, END, days=(7, 30))) == [(7, 1, 2, 2.0), (30, 0, 0, None)]


def test_cohort_without_eligible_users(retention_tables, rows):
    assert rows(cohort_retention(*retention_tables, END, days=(30,))) == []
    assert rows(cohort_retention_wide(*retention_tables, END, days=(1, 30))) == [("2024-01", 2, 0.0, 2, None, None)]


def test_curve_stops_where_nobody_is_eligible(retention_tables, rows):
    got = rows(retention_curve(*retention_tables, END))
    assert [r[0] for r in got] == [1, 2, 3, 4, 5, 6, 7]
    assert got[5] == (6, 0.0, 2) and got[6] == (7, 1.0, 1)


def test_power_law(table, rows):
    curve = table("day int, retention double, eligible_users int", *[(d, 0.3 * d**-0.5, 10) for d in (1, 4, 9, 100)], (5, 0.0, 10))
    got = rows(fit_retention_curve(curve, floor=0.05))
    assert got[0][3] == pytest.approx(-0.5) and math.exp(got[0][4]) == pytest.approx(0.3)
    assert [r[5] for r in got] == pytest.approx([0.3, 0.15, 0.1, 0.05, 0.3 * 5**-0.5])
    anchored = rows(fit_retention_curve(curve, anchor_days=(1, 4)))
    assert anchored[0][3] == pytest.approx(-0.5)


# --- growth ----------------------------------------------------------------------
OPENS = "user_id string, event_ts timestamp_ntz, stage string"
ORDERS = "order_id string, user_id string, order_ts timestamp_ntz, order_value double"


def test_week_across_two_months(table, rows):
    opens = table(OPENS, ("u", ts("2024-01-30"), "app_open"), ("u", ts("2024-02-02"), "app_open"), ("u", ts("2024-02-02"), "x"))
    orders = table(ORDERS)
    by_sunday = [(r["month"], r["WAU_avg"], r["MAU"]) for r in growth_monthly(opens, orders).collect()]
    assert by_sunday == [("2024-01", None, 1), ("2024-02", 1.0, 1)]
    split = [(str(r["month"]), r["wau_avg"], r["mau"]) for r in growth_monthly_split(opens, orders).collect()]
    assert split == [("2024-01-01", 1.0, 1), ("2024-02-01", 1.0, 1)]
    assert rows(wau(opens)) == [(date(2024, 1, 29), 1)]


def test_week_spilling_into_a_month_without_activity(table):
    opens = table(OPENS, ("u", ts("2024-09-30T12:00"), "app_open"))
    (r,) = growth_monthly(opens, table(ORDERS)).collect()
    assert (r["month"], r["MAU"], r["WAU_avg"], r["orders"], r["AOV"]) == ("2024-09", 1, None, None, None)


def test_monthly_figures(table):
    opens = table(
        OPENS,
        *[("u1", ts(f"2024-01-{d:02d}T10:00"), "app_open") for d in (1, 1, 2, 31)],
        *[("u2", ts(f"2024-01-{d:02d}T10:00"), "app_open") for d in (2, 9)],
    )
    orders = table(
        ORDERS,
        ("1", "u1", ts("2024-01-02"), 100.05),
        ("2", "u1", ts("2024-01-05"), 200.0),
        ("3", "u2", ts("2024-01-05"), 300.0),
        ("4", "u2", ts("2024-02-05"), 10.0),  # a month nobody was active in
    )
    (r,) = growth_monthly(opens, orders).collect()
    # active days 1, 2, 9, 31 with 1, 2, 1, 1 users; the gap days do not count
    assert r["DAU_avg"] == 5 / 4
    # weeks of the 1st (2 users) and the 8th (1 user); the week of the 29th ends in February
    assert r["WAU_avg"] == 3 / 2
    assert (r["MAU"], r["orders"], r["ordering_users"], r["revenue"]) == (2, 3, 2, 600.05)
    assert r["AOV"] == 600.05 / 3 and r["repeat_order_rate_within_month"] == 0.5
    (s,) = growth_monthly_split(opens, orders).collect()
    assert (s["dau_avg"], s["wau_avg"], s["aov"], s["revenue_per_mau"]) == (1.3, 1.3, 200.02, 300.03)


def test_lifetime_repeat(table, rows):
    orders = table(ORDERS, ("1", "u1", ts("2024-01-02"), 1.0), ("2", "u1", ts("2024-05-02"), 1.0), ("3", "u2", ts("2024-01-02"), 1.0),
                   ("4", "u3", ts("2024-01-02"), 1.0))
    assert rows(lifetime_repeat_rate(orders)) == [(33.33,)]
    assert rows(lifetime_repeat_rate(orders, as_percent=False)) == [(1 / 3,)]


def test_orders_from_events(table, rows):
    df = table(
        EVENTS + ", value double",
        ("s2", "u", ts("2024-01-02"), "order_placed", 5, 90.0),
        ("s1", "u", ts("2024-01-02"), "order_placed", 5, 425.129),
        ("s0", "u", ts("2024-01-03"), "order_placed", 5, 9999.0),
        ("s0", "u", ts("2024-01-03"), "app_open", 0, 1.0),
    )
    got = sorted((r.order_id, r.session_id, r.order_value) for r in orders_from_events(df, F.col("value"), value_range=(120.0, 1400.0)).collect())
    assert got == [("O100000", "s1", 425.13), ("O100001", "s2", 120.0), ("O100002", "s0", 1400.0)]


# --- delivery --------------------------------------------------------------------
def test_overall_ignores_missing_times(table, rows):
    df = table("time_taken_min double, on_time boolean", (1.0, True), (2.0, True), (4.0, True), (10.0, True), (None, False))
    assert rows(delivery_overall(df)) == [(5, 80.0, 4.25, 3.0)]


def test_traffic_labels(table, rows):
    df = table(
        "traffic_density string, time_taken_min double, on_time boolean",
        ("Jam ", 40.0, False), ("Low", 10.0, True), ("Odd", 10.0, True), (None, 1.0, True),
    )
    assert [r[0] for r in rows(delivery_by_traffic(df))] == ["Odd", "Low", "Jam"]
    assert [r[0] for r in rows(delivery_by_traffic(df, keep_unknown=False))] == ["Low", "Jam"]
    assert [r[0] for r in rows(delivery_by(df, "traffic_density", sort_by_rate=True))] == ["Jam ", "Low", "Odd"]


def test_combo_needs_enough_orders(spark, rows):
    df = spark.range(59).selectExpr(
        "if(id < 29, 'Low', 'Jam') AS traffic_density", "'Fog' AS weather", "double(id) AS time_taken_min", "true AS on_time"
    )
    assert rows(delay_combos(df)) == [("Jam", "Fog", 30, 43.5, 100.0)]


# --- statistics ------------------------------------------------------------------
def test_spearman_uses_mean_ranks(table, rows):
    df = table("t string, y double", ("Low", 1.0), ("Low", 2.0), ("Jam", 2.0), ("Jam", 9.0), (None, 3.0), ("Low", None))
    # ranks 1.5 1.5 3.5 3.5 against 1 2.5 2.5 4
    (r,) = spearman_ordinal(df, "t", ("Low", "Jam"), "y").collect()
    assert r.statistic == pytest.approx(3.0 / math.sqrt(4.0 * 4.5)) and r.dof2 == 2.0


def test_anova_and_pearson(table):
    df = table("g string, x double, y double", ("a", 1.0, 1.0), ("a", 2.0, 3.0), ("b", 3.0, 5.0), ("b", 4.0, 9.0), (None, None, 4.0))
    (r,) = with_p_value(anova(df, "g", "y")).collect()
    assert r.f == pytest.approx(25.0 / 5.0) and (r.dof1, r.dof2) == (1.0, 2.0)
    t = math.sqrt(5.0)
    assert r.p_value == pytest.approx(1 - t / math.sqrt(2 + t * t), rel=1e-12)
    (r,) = pearson(df, "y", ["x"]).collect()
    assert r.statistic == pytest.approx(13 / math.sqrt(175), rel=1e-12) and r.dof2 == 2.0


def test_perfect_fit_has_p_zero(table):
    df = table("g string, x double, y double", *[("a" if x < 3 else "b", float(x), 2.0 * x) for x in range(6)])
    (r,) = with_p_value(pearson(df, "y", ["x"])).collect()
    assert r.statistic == pytest.approx(1.0) and r.p_value < 1e-30
    (r,) = with_p_value(anova(df.withColumn("y", (F.col("g") == "a").cast("double")), "g", "y")).collect()
    assert r.f == math.inf and r.p_value == 0.0


def test_no_spread_gives_null(table):
    df = table("distance_km double, multiple_deliveries double, traffic_density string, weather string, time_taken_min double",
               (1.0, 1.0, "Low", "Fog", 5.0), (1.0, 1.0, "Low", "Fog", 5.0))
    assert [(r.statistic, r.p_value) for r in delay_stats(df).collect()] == [(None, None)] * 4


def test_normal_tails(table):
    zs = [0.0, 0.3, 1.0, 1.99, 2.0, 3.5, 9.4, 37.0, -1.0]
    df = table("z double", *[(z,) for z in zs], (None,))
    z = F.col("z")
    for r in df.select(z, two_sided_normal_p(z).alias("p"), norm_sf(z).alias("sf"), norm_cdf(z).alias("cdf")).collect():
        if r.z is None:
            assert (r.p, r.sf, r.cdf) == (None, None, None)
            continue
        assert r.p == pytest.approx(math.erfc(abs(r.z) / math.sqrt(2)), rel=1e-12)
        assert r.sf == pytest.approx(0.5 * math.erfc(r.z / math.sqrt(2)), rel=0.05, abs=1e-7) and r.sf > 0
        assert r.sf + r.cdf == pytest.approx(1.0, abs=1e-15)


def test_sql_functions(spark, table):
    register_sql_functions(spark)
    df = table("z double", (-2.0,), (0.5,), (9.4,))
    for r in df.select("z", norm_sf(F.col("z")).alias("sf"), F.expr("norm_sf(z)").alias("s"), norm_cdf(F.col("z")).alias("cdf"), F.expr("norm_cdf(z)").alias("c")).collect():
        assert r.sf == pytest.approx(r.s, rel=1e-12) and r.cdf == pytest.approx(r.c, rel=1e-12)


def test_f_tail_closed_forms(table):
    cases = [(f, 2.0, v, (1 + 2 * f / v) ** (-v / 2)) for f in (0.01, 1.0, 5.0) for v in (3.0, 50.0, 40000.0)]
    cases += [(f, 1.0, 1.0, 1 - 2 / math.pi * math.atan(math.sqrt(f))) for f in (0.1, 3.0, 80.0)]
    cases += [(4.0, 1.0, 1e12, math.erfc(math.sqrt(2.0))), (0.0, 3.0, 5.0, 1.0), (700.0, 5.0, 44000.0, 0.0)]
    df = table("f double, d1 double, d2 double, p double", *cases)
    for r in df.select("*", f_tail(F.col("f"), F.col("d1"), F.col("d2")).alias("got")).collect():
        assert r.got == pytest.approx(r.p, rel=1e-4 if r.d2 > 1e9 else 1e-10), r


# --- experiment ------------------------------------------------------------------
AB = "arm string, order_placed boolean"


def test_significant_loss_does_not_ship(spark):
    df = spark.range(2000).selectExpr("if(id % 2 = 0, 'control', 'treatment') AS arm", "id % 2 = 0 OR id % 10 < 5 AS order_placed")
    (r,) = ab_readout(df).collect()
    assert r.p_value_ztest < 0.05 and r.ci95_high_pp < 0 and r.decision == "NO-SHIP"


def test_missing_arm(table):
    df = table(AB, ("control", True), ("control", False))
    (r,) = ab_readout(df).collect()
    assert (r.n_control, r.n_treatment, r.z_statistic, r.p_value_ztest, r.decision) == (2, None, None, None, "NO-SHIP")
    assert ab_ztest(df).collect()[0].p_value_two_sided is None


# --- checks ----------------------------------------------------------------------
def test_key_checks(table, rows):
    users = table("user_id string", ("a",), ("b",), ("b",))
    events = table("user_id string", ("a",), ("x",), ("x",), (None,))
    assert rows(quality.pk_violations(users, ["user_id"])) == [("b", 2)]
    assert rows(quality.fk_orphans(events, users, "user_id")) == [("x", 2)]
    assert rows(quality.users_without_session(users.distinct(), events)) == [("b",)]


def test_domain_check(table, rows):
    df = table("traffic_density string, festival string", ("Low", "Yes"), ("low", "Yes"), ("low", None), ("Jam", "Maybe"))
    got = rows(quality.domain_violations(df, {"traffic_density": ("Low", "Jam"), "festival": ("Yes", "No")}))
    assert sorted(got) == [("festival", "Maybe", 1), ("traffic_density", "low", 2)]


def test_profiles(table, rows):
    df = table("a double, b string", (1.0, None), (2.0, "x"), (None, None), (4.0, None))
    assert rows(quality.null_profile(df)) == [("b", 0.75), ("a", 0.25)]
    got = dict(rows(quality.numeric_summary(df, ["a"])))
    assert got == pytest.approx({"count": 3.0, "mean": 7 / 3, "std": 1.5275252316519468, "min": 1.0, "25%": 1.5, "50%": 2.0, "75%": 3.0, "max": 4.0})


def test_profile_of_an_empty_column(table, rows):
    df = table("a double, b double", (None, 1.0))
    got = {r[0]: r[1:] for r in rows(quality.numeric_summary(df, ["a", "b"]))}
    assert got["count"] == (0.0, 1.0) and got["mean"] == (None, 1.0) and got["std"] == (None, None)


def test_calibration_band(table):
    users = table("user_id string, signup_date date", ("u1", date(2024, 1, 1)), ("u2", date(2024, 1, 1)))
    events = table(EVENTS, ("s", "u1", ts("2024-01-02"), "app_open", 0), ("s", "u1", ts("2024-01-02"), "order_placed", 5))
    orders = table(ORDERS, *[(str(i), "u1", ts("2024-01-02"), 10.0) for i in range(4)], ("9", "ghost", ts("2024-01-02"), 10.0),
                   ("10", "u2", ts("2024-02-02"), 10.0))
    got = {r.metric: r for r in calibration_report(users, events, orders, date(2024, 1, 31)).collect()}
    assert got["orders"].value == 6.0 and got["aov_mean"].value == 10.0
    assert got["orders_per_ordering_user:2024-01"].value == 4.0 and got["orders_per_ordering_user:2024-01"].in_band is True
    assert got["orders_per_ordering_user:2024-02"].in_band is False
    assert got["D1_retention"].value == 0.5 and got["D1_retention"].in_band is None
    assert got["sessions:browse"].value == 0.0 and got["overall_conversion"].value == 1.0


# --- skew ------------------------------------------------------------------------
def test_one_user_with_a_third_of_all_events(spark, rows):
    who = "if(id % 3 = 0, 'hot', concat('u', id % 500)) AS user_id"
    when = "timestamp_ntz'2024-01-01' + make_dt_interval(cast(id % 20 as int)) AS event_ts"
    events = spark.range(30000).selectExpr(who, when, "'app_open' AS stage").cache()
    users = events.select("user_id").distinct().withColumn("signup_date", F.lit(date(2024, 1, 1)))
    seen = {(r.user_id, r.event_ts.day - 1) for r in events.collect()}
    everyone = len({u for u, _ in seen})
    got = rows(retention_curve(users, events, date(2024, 1, 31), max_day=19))
    assert got == [(d, sum(n == d for _, n in seen) / everyone, everyone) for d in range(1, 20)]
    (r,) = growth_monthly(events, events.selectExpr("user_id", "event_ts AS order_ts", "0.1D AS order_value")).collect()
    assert (r["MAU"], r["DAU_avg"], r["orders"]) == (everyone, len(seen) / 20, 30000)
    assert r["revenue"] == pytest.approx(3000.0)


@pytest.mark.parametrize("sessions", [5_200, 52_000_000, 52_000_000_000])
def test_agreement_does_not_depend_on_the_size(table, sessions):
    counts = table("n_c long, x_c long, n_t long, x_t long", (sessions, sessions * 3 // 10, sessions, sessions * 385 // 1000))
    assert experiment._agreement(counts, 1e-9).first().agree


def test_money_is_neither_cast_away_nor_cut(table):
    when = datetime(2024, 1, 5)
    orders = table("user_id string, order_ts timestamp_ntz, order_value double", *[("u", when, v) for v in (10.123456, 2e14, 5.0)])
    (row,) = orders_monthly(orders, digits=None).collect()
    assert row.revenue == pytest.approx(200000000000015.123456, rel=1e-15) and row.aov == pytest.approx(row.revenue / 3)
    (row,) = orders_monthly(orders.union(table("user_id string, order_ts timestamp_ntz, order_value double", ("u", when, float("inf"))))).collect()
    assert row.revenue == float("inf")
    exact = orders.select("user_id", "order_ts", F.lit("0.1234567891").cast("decimal(20,10)").alias("order_value"))
    assert orders_monthly(exact, digits=None).first().revenue == pytest.approx(0.3703703673, rel=1e-15)


def test_seventy_stages(table, rows):
    stages = [f"s{i}" for i in range(70)]
    when = datetime(2024, 1, 5)
    schema = "session_id string, user_id string, event_ts timestamp_ntz, stage string, stage_order int"
    whole = [("a", "u", when, s, i) for i, s in enumerate(stages)]
    events = table(schema, *whole, ("b", "v", when, "s64", 64))
    seen = {r.stage: r.sessions for r in funnel(events, stages, "blended").collect()}
    assert seen["s0"] == 1 and seen["s64"] == 2 and seen["s69"] == 1
    assert rows(quality.stage_violations(events, stages)) == [("stage_order_mismatch", 0), ("incomplete_prefix", 1)]
