"""What the physical plans must and must not contain."""

import re

import pytest

from platewise.operators.statistics import pearson_and_anova
from platewise.plans.bindings import line_deliveries
from platewise.plans.catalog import QUERIES


def plan(spark, sf_dir, name):
    return QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_join_and_no_python(spark, sf_dir, name):
    text = plan(spark, sf_dir, name)
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas", "BatchScan"):
        assert operator not in text


@pytest.mark.parametrize("name", ["funnel_first_session", "funnel_by_depth", "dau", "mau", "lifetime_repeat_rate"])
def test_no_global_window_and_one_scan(spark, sf_dir, name):
    text = plan(spark, sf_dir, name)
    assert "Window" not in text
    assert text.count("FileScan") == 1


def test_line_breakdown_needs_no_join(spark, sf_dir):
    assert "Join" not in plan(spark, sf_dir, "delivery_by_weather")
    assert "Join" in plan(spark, sf_dir, "delivery_by_city")


def test_scans_are_pruned(spark, sf_dir):
    text = plan(spark, sf_dir, "dau")
    assert re.search(r"ReadSchema: struct<o_custkey:bigint,o_orderdate:timestamp_ntz>", text)
    text = plan(spark, sf_dir, "funnel_blended")
    assert "Not(EqualTo(event_type,error))" in text and "props" not in text


def test_cutoff_reaches_the_scan(spark, sf_dir):
    assert re.search(r"PushedFilters: \[.*LessThan\(ts,2024-01-21", plan(spark, sf_dir, "retention_curve"))


def test_delay_tests_join_once_and_share_a_pass(spark, sf_dir):
    text = plan(spark, sf_dir, "delay_stats").split("== Initial Plan ==")[-1]
    # the ranks need the joined traffic; whatever repeats of that is one exchange at run time
    joins = [line for line in text.splitlines() if "Join" in line and "l_orderkey" in line]
    ranked = [line for line in text.splitlines() if "HashAggregate" in line and "level" in line and "partial_count" in line]
    assert joins and len(joins) <= len(ranked)
    both = pearson_and_anova(line_deliveries(spark, sf_dir), "time_taken_min", ["distance_km"], "weather")
    text = both._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in text and text.count("FileScan") == 1
