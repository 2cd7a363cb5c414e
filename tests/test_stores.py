"""Stores that are kept up: days replaced one by one, growth states, bucketed tables, sketches."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from platewise.operators import growth, retention
from platewise.plans import bindings as b
from platewise.plans import incremental
from platewise.plans.catalog import QUERIES
from platewise.sources.writers import save_bucketed, write_days

EVENTS = "user_id long, event_ts timestamp_ntz, stage string"
ORDERS = "user_id long, order_ts timestamp_ntz, order_value double"


def files(path):
    return {p.relative_to(path): p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def test_a_rerun_of_a_day_leaves_the_other_days_alone(table, tmp_path):
    store = tmp_path / "days"
    rows = [(d, v) for d in (1, 2, 3) for v in (d * 10, d * 10 + 1)]
    make = lambda *rows: table("day date, v int", *[(date(2024, 1, d), v) for d, v in rows])
    write_days(make(*rows), str(store))
    before = files(store)
    for _ in range(2):
        write_days(make((2, 77), (2, 78), (2, 79)), str(store))
        got = sorted(tuple(r) for r in make().sparkSession.read.parquet(str(store)).select("day", "v").collect())
        assert got == sorted([(date(2024, 1, d), v) for d, v in rows if d != 2] + [(date(2024, 1, 2), v) for v in (77, 78, 79)])
    after = files(store)
    assert {p: t for p, t in after.items() if "day=2024-01-02" not in str(p)} == {p: t for p, t in before.items() if "day=2024-01-02" not in str(p)}
    write_days(make((4, 1)), str(store))
    assert {p.name for p in store.glob("day=*")} == {f"day=2024-01-0{d}" for d in (1, 2, 3, 4)}


def grown(df):
    return [tuple(r) for r in df.collect()]


def test_growth_store_equals_the_full_run(table, tmp_path):
    import random

    rng = random.Random(7)
    at = lambda: datetime(2024, rng.randint(1, 3), rng.randint(1, 28), rng.randint(0, 23))
    events = [(rng.randint(1, 40), at(), rng.choice(["Open App", "Search"])) for _ in range(800)] + [(None, at(), "Open App"), (3, None, "Open App")]
    orders = [(rng.randint(1, 30), at(), rng.choice([10.25, 7.1, None])) for _ in range(300)] + [(None, at(), 3.0), (4, None, 9.0)]
    full = growth.growth_monthly(table(EVENTS, *events), table(ORDERS, *orders), "Open App")
    store = str(tmp_path / "store")
    spark = full.sparkSession
    key = lambda r: (r[1] is None, r[1])
    cuts = [datetime(2024, 1, 1), datetime(2024, 2, 10), datetime(2024, 3, 5), datetime(2025, 1, 1)]
    for low, high in zip(cuts, cuts[1:]):
        part = lambda rows: [r for r in rows if r[1] is None or low <= r[1] < high]  # noqa: B023, E731
        for _ in range(2):  # a batch that runs twice changes nothing
            incremental.add_batch(spark, store, table(EVENTS, *sorted(part(events), key=key)), table(ORDERS, *part(orders)), "Open App")
    assert grown(incremental.growth(spark, store)) == grown(full)
    assert not [p for p in (tmp_path / "store").iterdir() if p.name.startswith("_")]


def test_a_batch_reads_the_months_it_touches(table, tmp_path, monkeypatch):
    store = str(tmp_path / "store")
    spark = table(EVENTS).sparkSession
    for month in (1, 2, 3):
        incremental.add_batch(spark, store, table(EVENTS, (1, datetime(2024, month, 5), "Open App")), table(ORDERS), "Open App")
    before = files(tmp_path / "store" / "activity")
    incremental.add_batch(spark, store, table(EVENTS, (2, datetime(2024, 3, 6), "Open App")), table(ORDERS), "Open App")
    after = files(tmp_path / "store" / "activity")
    assert {str(p).split("/")[0] for p in before.keys() - after.keys() | after.keys() - before.keys()} == {"month=2024-03-01"}
    assert spark.read.parquet(f"{store}/activity").count() == 4


def test_sketches_merge_and_keep_their_error(spark):
    events = spark.range(60_000).selectExpr("id % 20000 AS user_id", "timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(cast(id % 60 AS int)) AS event_ts", "'Open App' AS stage")
    sketches = growth.activity_sketches(events, "Open App")
    assert sketches.count() == 60
    for grain, exact in (("day", growth.dau), ("week", growth.wau), ("month", growth.mau)):
        known = dict(tuple(r) for r in exact(events, "Open App").collect())
        got = dict(tuple(r) for r in growth.approximate_activity(sketches, grain).collect())
        assert got.keys() == known.keys()
        assert all(abs(got[p] - n) <= growth.sketch_error() * n for p, n in known.items())
    with pytest.raises(ValueError):
        growth.approximate_activity(sketches, "year")


def test_sketches_of_texts_dates_and_nothing(spark):
    dates = spark.sql("SELECT date '2024-01-01' AS user_id, timestamp_ntz '2024-01-01 01:00:00' AS event_ts, 'Open App' AS stage")
    assert [r.users for r in growth.approximate_activity(growth.activity_sketches(dates, "Open App")).collect()] == [1]
    assert growth.approximate_activity(growth.activity_sketches(dates.limit(0), "Open App"), "month").collect() == []


def test_bucketed_users_and_events_need_no_shuffle_for_retention(spark, sf_dir):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        users, events = b.users(spark, sf_dir), b.funnel_events(spark, sf_dir)
        save_bucketed(users, "bucketed_users", "user_id", 4)
        save_bucketed(events, "bucketed_events", "user_id", 4)
        active = lambda u, e: retention._active_days(u, e, b.OPEN_STAGE)
        bucketed = active(spark.table("bucketed_users"), spark.table("bucketed_events"))
        plan = bucketed._jdf.queryExecution().executedPlan().toString()
        assert "Join" in plan and "Exchange" not in plan
        assert "Exchange" in active(users, events)._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, bucketed.collect())) == sorted(map(tuple, active(users, events).collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
        for name in ("bucketed_users", "bucketed_events"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_calibration_reads_each_input_once(spark, sf_dir):
    query = QUERIES["calibration_report"](spark, sf_dir)
    query.collect()
    plan = query._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan") == 2 and plan.count("Exchange") <= 6


def test_cleaning_reads_what_a_column_needs(spark, sf_dir, tmp_path):
    from platewise.operators.cleaning import clean_orders

    b.raw_orders(spark, sf_dir).limit(50).write.parquet(str(tmp_path / "raw"))
    cleaned = clean_orders(spark.read.parquet(str(tmp_path / "raw")))

    def read(name):
        scan = cleaned.select(name)._jdf.queryExecution().executedPlan().collectLeaves().head()
        return {column.strip() for column in scan.requiredSchema().fieldNames()}

    assert read("order_id") == {"ID"}
    assert read("distance_km") == {"Restaurant_latitude", "Restaurant_longitude", "Delivery_location_latitude", "Delivery_location_longitude"}
    assert read("prep_time_min") == {"Order_Date", "Time_Orderd", "Time_Order_picked"}
    assert read("on_time") == {"Time_taken(min)"}
