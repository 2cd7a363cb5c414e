import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from platewise.operators import ordering
from platewise.operators.ordering import default_ranges, exact_median, exact_quantiles, range_borders, row_positions, running_total

SLOW = settings(
    max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow]
)


@SLOW
@given(
    weights=st.dictionaries(st.integers(-1000, 1000), st.integers(1, 9), min_size=1, max_size=60),
    ranges=st.sampled_from([1, 2, 3, 7, 64]),
)
def test_running_total_equals_brute_force(spark, weights, ranges):
    df = spark.createDataFrame(list(weights.items()), "k int, w int")
    got = {r.k: r.before for r in running_total(df, ["k"], "w", ranges=ranges).collect()}
    total = 0
    for k in sorted(weights):
        assert got[k] == total
        total += weights[k]


def test_tied_rows_still_get_every_position(spark):
    df = spark.range(3000).selectExpr("if(id % 3 = 0, 7, id) AS k")
    got = sorted(r.position for r in row_positions(df, ["k"], ranges=16).collect())
    assert got == list(range(3000))


def test_copies_of_one_key_take_no_borders(spark):
    """The key with the smallest hash, very often, leaves as many ranges as without it."""
    keys = spark.range(1000).selectExpr("id AS k")
    least = keys.orderBy(F.xxhash64(F.struct("k"))).first().k
    hot = keys.union(spark.range(5000).selectExpr(f"{least}L AS k")).selectExpr("k", "1 AS w")
    assert 40 <= len(range_borders(hot.groupBy("k").agg(F.sum("w")), ["k"], 64).first()[0]) <= 90
    placed = running_total(hot, ["k"], "w", ranges=64)
    assert placed.agg(F.max(F.col("before") + F.col("w"))).first()[0] == 6000
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" not in plan and "Limit" not in plan


def test_composite_keys_order_by_each_part(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("a", 1), ("b", None)], "s string, n int").selectExpr("*", "1 AS w")
    got = {(r.s, r.n): r.before for r in running_total(df, ["s", "n"], "w", ranges=2).collect()}
    assert got == {("a", 1): 0, ("a", 2): 1, ("b", None): 2, ("b", 1): 3}


def test_no_row(spark):
    df = spark.createDataFrame([], "k int, w int")
    assert running_total(df, ["k"], "w").collect() == []
    assert exact_median(df, "k").collect()[0][0] is None


def test_ranges_follow_the_shuffle_partitions(spark):
    assert default_ranges(spark.range(1)) == 64


@pytest.mark.parametrize("values, median", [([1, 2, 4, 10], 3.0), ([1, 2, 4], 2.0), ([5], 5.0), ([3, None, 1], 2.0)])
def test_median(spark, values, median):
    df = spark.createDataFrame([(v,) for v in values], "v int")
    assert exact_median(df, "v").collect()[0][0] == median


@pytest.mark.parametrize("accuracy", [100_000, 200])
def test_quantiles_of_a_column_with_a_hot_value(spark, monkeypatch, accuracy):
    monkeypatch.setattr(ordering, "SKETCH_ACCURACY", accuracy)
    rng = np.random.default_rng(5)
    a = np.concatenate([np.full(2000, 24.0), rng.normal(30, 9, 4000)])
    b = rng.integers(0, 5, 6000).astype(float)
    df = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, b)], "a double, b double")
    probabilities = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {(r.metric, r.probability): r.quantile for r in exact_quantiles(df, ["a", "b"], probabilities).collect()}
    for name, values in (("a", a), ("b", b)):
        for p in probabilities:
            assert got[name, p] == pytest.approx(np.quantile(values, p), rel=1e-12)
