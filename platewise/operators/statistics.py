"""Correlations and variance tests over distributed data.

Each test reduces the data to one row of (method, statistic, f, dof1, dof2); the
tail probability is evaluated on those rows alone. A two-sided t test with v
degrees of freedom is the F(1, v) test of t squared, so one tail serves all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platewise.functions.numbers import open_ratio, ordinal, ratio
from platewise.functions.tails import f_tail
from platewise.operators.ordering import running_total


def _correlation_row(r: Column, n: Column) -> list[Column]:
    """Columns of a correlation test: r, and t^2 = r^2 (n - 2) / (1 - r^2) as F(1, n - 2)."""
    dof = n - F.lit(2)
    return [
        r.alias("statistic"),
        open_ratio(r * r * dof, F.greatest(1.0 - r * r, F.lit(0.0))).alias("f"),
        F.lit(1.0).alias("dof1"),
        dof.cast("double").alias("dof2"),
    ]


def _moments(df: DataFrame, y: str, predictors: Sequence[str], group: str) -> DataFrame:
    """One row per group with counts, means and central moments, of `y` and of each (x, y)."""
    target = F.col(y).cast("double")
    columns = [F.count(target).alias("n"), F.avg(target).alias("mean"), F.var_pop(target).alias("variance")]
    for i, name in enumerate(predictors):
        x = F.col(name).cast("double")
        both = x.isNotNull() & target.isNotNull()
        x, t = F.when(both, x), F.when(both, target)
        columns += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"x{i}"), F.avg(t).alias(f"y{i}")]
        columns += [F.covar_pop(x, t).alias(f"xy{i}"), F.var_pop(x).alias(f"xx{i}"), F.var_pop(t).alias(f"yy{i}")]
    return df.groupBy(group).agg(*columns)


def pearson_and_anova(df: DataFrame, y: str, predictors: Sequence[str], group: str) -> DataFrame:
    """Pearson r of `y` with each predictor, over the rows where both are known, and the
    one-way analysis of variance of `y` over the groups
    -> test ('pearson' or 'anova'), name (predictor or group), statistic, f, dof1, dof2

    Everything comes from the moments per group: one pass over the data, one row per group
    of the vocabulary after it. Moments of groups add up around the common mean, so no
    digits are lost to large means.
    """
    everywhere = Window.partitionBy()

    def mean_of(value: str, count: Column) -> Column:
        return ratio(F.sum(count * F.col(value)).over(everywhere), F.sum(count).over(everywhere))

    columns, sums = {}, []
    for i in range(len(predictors)):
        n = F.col(f"n{i}")
        dx, dy = (F.col(f"{v}{i}") - mean_of(f"{v}{i}", n) for v in "xy")
        for name, between in (("xy", dx * dy), ("xx", dx * dx), ("yy", dy * dy)):
            columns[f"s{name}{i}"] = n * (F.col(f"{name}{i}") + between)
            sums.append(F.sum(f"s{name}{i}").alias(f"s{name}{i}"))
        sums.append(F.coalesce(F.sum(n), F.lit(0)).alias(f"n{i}"))
    grouped = F.when(F.col(group).isNotNull() & (F.col("n") > 0), F.col("n"))
    shift = F.col("mean") - mean_of("mean", grouped)
    columns |= {"grouped": grouped, "between": grouped * shift * shift, "within": grouped * F.col("variance")}
    sums += [F.sum(c).alias(c) for c in ("grouped", "between", "within")] + [F.count("grouped").alias("groups")]
    total = _moments(df, y, predictors, group).withColumns(columns).agg(*sums)

    rows = []
    for i, name in enumerate(predictors):
        r = ratio(F.col(f"sxy{i}"), F.sqrt(f"sxx{i}") * F.sqrt(f"syy{i}"))
        rows.append(F.struct(F.lit("pearson").alias("test"), F.lit(name).alias("name"), *_correlation_row(r, F.col(f"n{i}"))))
    dof1, dof2 = (F.col("groups") - 1).cast("double"), (F.col("grouped") - F.col("groups")).cast("double")
    f = open_ratio(ratio(F.col("between"), dof1), ratio(F.col("within"), dof2))
    anova = [f.alias("statistic"), f.alias("f"), dof1.alias("dof1"), dof2.alias("dof2")]
    rows.append(F.struct(F.lit("anova").alias("test"), F.lit(group).alias("name"), *anova))
    return total.select(F.explode(F.array(*rows)).alias("row")).select("row.*")


def pearson(df: DataFrame, y: str, predictors: Sequence[str]) -> DataFrame:
    """Pearson r of `y` with each predictor -> predictor, statistic, f, dof1, dof2"""
    rows = pearson_and_anova(df.withColumn("_all", F.lit(1)), y, predictors, "_all").filter("test = 'pearson'")
    return rows.withColumnRenamed("name", "predictor").drop("test")


def anova(df: DataFrame, group: str, y: str) -> DataFrame:
    """One-way analysis of variance of `y` over the groups -> statistic, f, dof1, dof2"""
    return pearson_and_anova(df, y, [], group).drop("test", "name")


def spearman_ordinal(
    df: DataFrame, label: str, levels: Sequence[str], y: str, ranges: int | None = None
) -> DataFrame:
    """Spearman's rho between an ordered label and a number, ties at their mean rank
    -> statistic, f, dof1, dof2

    The data collapses to counts per (level, value) first; ranks are placed on the
    distinct values, not on the rows.
    """
    cells = (
        df.select(ordinal(F.col(label), levels).alias("level"), F.col(y).cast("double").alias("value"))
        .filter(F.col("level").isNotNull() & F.col("value").isNotNull())
        .groupBy("level", "value")
        .agg(F.count("*").alias("n"))
    )

    def mean_rank(name: str) -> Column:
        return (F.col("before") + (F.col("n") + 1) / F.lit(2.0)).alias(name)

    values = cells.groupBy("value").agg(F.sum("n").alias("n"))
    value_ranks = running_total(values, ["value"], "n", "before", ranges).select("value", mean_rank("ry"))
    # One row per level of the vocabulary.
    lower_levels = Window.orderBy("level").rowsBetween(Window.unboundedPreceding, -1)
    level_ranks = (
        cells.groupBy("level")
        .agg(F.sum("n").alias("n"))
        .withColumn("before", F.coalesce(F.sum("n").over(lower_levels), F.lit(0)))
        .select("level", mean_rank("rx"))
    )
    rows = cells.agg(F.sum("n")).scalar()
    centred = (
        cells.join(value_ranks, "value")
        .join(F.broadcast(level_ranks), "level")
        .withColumn("middle", (rows + 1) / F.lit(2.0))
        .select("n", (F.col("rx") - F.col("middle")).alias("dx"), (F.col("ry") - F.col("middle")).alias("dy"))
    )
    sums = centred.agg(
        F.sum(F.col("n") * F.col("dx") * F.col("dy")).alias("sxy"),
        F.sum(F.col("n") * F.col("dx") * F.col("dx")).alias("sxx"),
        F.sum(F.col("n") * F.col("dy") * F.col("dy")).alias("syy"),
        F.sum("n").alias("rows"),
    )
    rho = ratio(F.col("sxy"), F.sqrt("sxx") * F.sqrt("syy"))
    return sums.select(rho.alias("rho"), "rows").select(*_correlation_row(F.col("rho"), F.col("rows")))


def with_p_value(tests: DataFrame) -> DataFrame:
    """Add p_value to rows of (f, dof1, dof2)."""
    return tests.withColumn("p_value", f_tail(F.col("f"), F.col("dof1"), F.col("dof2")))
