"""Constraint reports in one pass, profiles in two scans, tails of tests over very large tables."""

import math

import pytest
from pyspark.sql import functions as F

from platewise.functions.tails import f_tail
from platewise.operators import ordering
from platewise.operators.quality import Profile, constraint_report, domain_violations, fk_orphans, null_profile, numeric_summary, pk_violations
from platewise.plans.catalog import QUERIES, SUMMARY_COLUMNS, _cleaned


def test_constraint_report_equals_the_single_checks(table):
    child = table("id int, part string, user long, tier string, way string",
                  (1, "a", 1, "Metro", "x"), (1, "a", 2, "metro", "y"), (1, None, 9, None, "x"), (1, None, None, "??", "z"), (None, None, 8, "??", "q"), (None, "b", 9, "Metro", "x"))
    parent = table("user long, tier string", (1, "Metro"), (2, "Town"), (2, "Town"), (None, None))
    empty = table("id int, tier string")
    tables, domains = {"child": child, "parent": parent, "empty": empty}, {"tier": ("Metro", "Town"), "way": ("x", "y")}
    got = {(r.tbl, r.constraint): r.violations for r in constraint_report(tables, {"child": ("id", "part"), "parent": ("user",), "empty": ("id",)}, [("child", "user", "parent")], domains).collect()}
    assert got == {
        ("child", "primary key (id, part)"): pk_violations(child, ["id", "part"]).count(),
        ("parent", "primary key (user)"): 1,
        ("empty", "primary key (id)"): 0,
        ("child", "user in parent"): fk_orphans(child, parent, "user").count(),
        ("child", "labels of tier, way"): domain_violations(child, domains).count(),
        ("parent", "labels of tier"): 0,
        ("empty", "labels of tier"): 0,
    }
    assert got["child", "user in parent"] == 2 and got["child", "primary key (id, part)"] == 2


def test_constraint_report_scans_each_table_once(spark, sf_dir):
    plan = QUERIES["constraint_report"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 3


def test_a_profile_is_two_scans(spark, sf_dir, monkeypatch):
    cleaned, scans = _cleaned(spark, sf_dir), []
    figures = ordering.column_figures
    monkeypatch.setattr("platewise.operators.quality.column_figures", lambda *a, **k: scans.append(1) or figures(*a, **k))
    profile = Profile(cleaned, SUMMARY_COLUMNS)
    summary = profile.summary()
    assert scans == [1] and summary._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert profile.null_rates()._jdf.queryExecution().executedPlan().toString().count("FileScan") == 0
    assert profile.null_rates().collect() == null_profile(cleaned).collect()
    assert summary.collect() == numeric_summary(cleaned, SUMMARY_COLUMNS).collect()


def test_quantiles_of_more_columns_than_a_word_has_bits(spark, monkeypatch):
    monkeypatch.setattr(ordering, "SKETCH_ACCURACY", 100)
    names = [f"c{i}" for i in range(30)]
    df = spark.range(1, 1002).select(*[(F.col("id") * (i + 1)).alias(n) for i, n in enumerate(names)])
    got = {(r.metric, r.probability): r.quantile for r in ordering.exact_quantiles(df, names, [0.25, 0.5, 0.75]).collect()}
    assert got == {(n, p): (1 + 1000 * p) * (i + 1) for i, n in enumerate(names) for p in (0.25, 0.5, 0.75)}


def test_tails_of_very_many_degrees_of_freedom(spark):
    rows = [(f, d1, d2) for d2 in (2.1e6, 1e9, 1e12) for d1 in (1.0, 2.0, 4.0) for f in (1e-8, 0.5, 3.0, 30.0)]
    df = spark.createDataFrame(rows, "f double, d1 double, d2 double")
    for r in df.select("f", "d1", "d2", f_tail(F.col("f"), F.col("d1"), F.col("d2")).alias("p")).collect():
        a, odds = r.d2 / 2, r.d1 * r.f / r.d2
        power = math.exp(-a * math.log1p(odds))
        if r.d1 == 1:
            z = math.sqrt(r.f)
            want = math.erfc(z / math.sqrt(2)) + (z**3 + z) / (2 * r.d2) * math.exp(-z * z / 2) / math.sqrt(2 * math.pi)
            assert r.p == pytest.approx(want, rel=1e-10 if r.d2 > 1e8 else 1e-8)
        else:
            want = power if r.d1 == 2 else power * (1 + a * odds / (1 + odds))
            assert r.p == pytest.approx(want, rel=1e-10)


def test_tails_agree_where_the_method_changes(spark):
    df = spark.createDataFrame([(f, d1) for f in (0.2, 1.0, 2.5, 9.0) for d1 in (1.0, 3.0, 7.0, 40.0)], "f double, d1 double")
    below, above = (f_tail(F.col("f"), F.col("d1"), F.lit(2e6 + step)) for step in (-1e-3, 1e-3))
    assert all(r.x == pytest.approx(r.y, rel=2e-10) for r in df.select(below.alias("x"), above.alias("y")).collect())
