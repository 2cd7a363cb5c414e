"""The whole report: clean the raw orders, run the analyses, write the result tables.

    python -m platewise.plans.reporting --raw raw.csv --data tables/ --out results/ --store shared/

`tables/` holds the four CSV files of users, events, orders and A/B sessions; `results/`
and `shared/` must be folders that all executors share. `shared/` may be left out where
`spark.checkpoint.dir` names one. What the run stores there is removed at its end.
"""

from __future__ import annotations

import argparse
import uuid
from datetime import date

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from platewise.operators.cleaning import clean_orders
from platewise.operators.delivery import (
    delay_combos,
    delay_correlations,
    delay_stats,
    delivery_by,
    delivery_by_traffic,
    delivery_overall,
    on_time_share,
)
from platewise.operators.experiment import ab_chi2, ab_readout, ab_ztest
from platewise.operators.funnel import funnel, funnel_by_depth
from platewise.operators.growth import dau, growth_monthly, growth_monthly_split, lifetime_repeat_rate, mau, wau
from platewise.operators.quality import Profile, constraint_report, row_counts
from platewise.operators.report import key_numbers
from platewise.operators.retention import cohort_retention, cohort_retention_wide, day_points, retention_curve
from platewise.schemas import DOMAINS, FOREIGN_KEYS, PRIMARY_KEYS, TRAFFIC_LEVELS
from platewise.sources.readers import read_parquet_table, read_raw_orders, read_table
from platewise.sources.shared import removed, shared_folder
from platewise.sources.writers import write_csv, write_parquet, write_scalar


def _stored(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    """Written once as parquet and read back: later reads prune columns and skip the parsing."""
    write_parquet(df, path)
    return read_parquet_table(spark, path)


def constraint_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """-> tbl, constraint, violations: offending keys, references and labels of every table"""
    return constraint_report(tables, PRIMARY_KEYS, FOREIGN_KEYS, DOMAINS)


def report_tables(tables: dict[str, DataFrame], analysis_end: date) -> dict[str, DataFrame]:
    """All result tables by name; lazy but for single rows that steer them (profiles, medians)."""
    deliveries = tables["real_orders"]
    users, events = tables["synthetic_users"], tables["synthetic_funnel_events"]
    orders, ab = tables["synthetic_orders"], tables["synthetic_ab_test"]
    curve = retention_curve(users, events, analysis_end)
    profile = Profile(deliveries, ["time_taken_min", "distance_km", "prep_time_min"])
    fractions = {"as_percent": False, "digits": None}
    return {
        "row_counts": row_counts(tables),
        "null_profile": profile.null_rates(),
        "numeric_summary": profile.summary(),
        "funnel_first_session": funnel(events, view="first_session"),
        "funnel_blended_all_sessions": funnel(events, view="blended"),
        "cohort_retention_by_month": cohort_retention_wide(users, events, analysis_end),
        "overall_retention_curve": curve,
        "retention_day_points": day_points(curve),
        "growth_metrics_monthly": growth_monthly(events, orders),
        "lifetime_repeat_rate": lifetime_repeat_rate(orders),
        "delivery_overall": delivery_overall(deliveries),
        "delivery_by_traffic": delivery_by_traffic(deliveries, TRAFFIC_LEVELS, False, **fractions),
        "delivery_by_weather": delivery_by(deliveries, "weather", sort_by_rate=True, **fractions),
        "delivery_by_city": delivery_by(deliveries, "city_type", sort_by_rate=True, **fractions),
        "delivery_by_festival": delivery_by(deliveries, "festival", **fractions),
        "delay_combos": delay_combos(deliveries),
        "delay_correlations": delay_correlations(deliveries),
        "delivery_stats_summary": delay_stats(deliveries),
        "ab_test_result": ab_readout(ab),
        "key_numbers": key_numbers(deliveries, events, orders, ab),
        # the rounded forms, with weeks split at month ends and depth instead of stage seen
        "dau": dau(events),
        "wau": wau(events),
        "mau": mau(events),
        "growth_metrics_monthly_split": growth_monthly_split(events, orders),
        "funnel_by_depth": funnel_by_depth(events),
        "cohort_retention_long": cohort_retention(users, events, analysis_end),
        "ab_test_rounded": ab_ztest(ab),
        "ab_test_chi2": ab_chi2(ab),
        "constraint_violations": constraint_violations(tables),
    }


def run(
    spark: SparkSession, raw_path: str, data_path: str, out_path: str, analysis_end: date, shared: str | None = None
) -> None:
    """`shared`: where intermediate tables go; the folder in `spark.checkpoint.dir` by default."""
    store = f"{(shared or shared_folder(spark)).rstrip('/')}/report-{uuid.uuid4().hex}"
    try:
        _write_report(spark, raw_path, data_path, out_path, analysis_end, store)
    finally:
        removed(spark, store)


def _write_report(spark: SparkSession, raw_path: str, data_path: str, out_path: str, analysis_end: date, store: str) -> None:
    raw = read_raw_orders(spark, raw_path)
    # counted while the cleaned rows are written: the raw file is read once
    read, written = Observation("rows read"), Observation("rows written")
    count = F.count(F.lit(1))
    cleaning = clean_orders(raw.observe(read, count.alias("rows_in"))).observe(written, count.alias("rows_out"))
    cleaned = _stored(spark, cleaning, f"{store}/real_orders")
    write_csv(cleaned, f"{out_path}/real_orders_clean")
    both = spark.createDataFrame([(read.get["rows_in"], written.get["rows_out"])], "rows_in long, rows_out long")
    write_csv(both, f"{out_path}/tables/rows_in_and_out", single_file=True)
    tables = {"real_orders": cleaned}
    for name in ("synthetic_users", "synthetic_funnel_events", "synthetic_orders", "synthetic_ab_test"):
        tables[name] = _stored(spark, read_table(spark, f"{data_path}/{name}.csv", name), f"{store}/{name}")
    for name, result in report_tables(tables, analysis_end).items():
        write_csv(result, f"{out_path}/tables/{name}", single_file=True)
    write_scalar(on_time_share(cleaned), f"{out_path}/tables/delivery_overall_on_time")


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("--raw", required=True, help="raw order CSV")
    parser.add_argument("--data", required=True, help="folder of the other four CSV tables")
    parser.add_argument("--out", required=True, help="result folder, shared by all executors")
    parser.add_argument("--store", help="shared folder for intermediate tables")
    parser.add_argument("--end", type=date.fromisoformat, default=date(2024, 9, 30), help="analysis cutoff")
    args = parser.parse_args()
    spark = SparkSession.builder.appName("product-analytics").config("spark.ui.enabled", "false").getOrCreate()
    run(spark, args.raw, args.data, args.out, args.end, args.store)


if __name__ == "__main__":
    main()
