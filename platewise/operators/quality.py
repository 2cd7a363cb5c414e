"""Checks of the constraints the model tables rely on, and column profiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.functions.numbers import ordinal, rate
from platewise.operators.ordering import column_figures, quantiles_between
from platewise.operators.sessions import stage_words, union_all
from platewise.schemas import FUNNEL_STAGES


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """-> tbl, rows_loaded"""
    return union_all(
        [df.agg(F.count("*").alias("rows_loaded")).select(F.lit(name).alias("tbl"), "rows_loaded")
         for name, df in tables.items()]
    )


def _null_rates(df: DataFrame, digits: int) -> dict[str, Column]:
    return {c: F.round(rate(F.col(f"`{c}`").isNull()), digits) for c in df.columns}


def _top_rates(rows: DataFrame, k: int) -> DataFrame:
    return rows.orderBy(F.desc("null_rate"), "column_name").limit(k)


def null_profile(df: DataFrame, k: int = 10, digits: int = 3) -> DataFrame:
    """Share of missing values per column, the k highest -> column_name, null_rate

    One pass over the data; equal shares are ordered by column name.
    """
    rates = df.agg(*[value.alias(f"c{i}") for i, value in enumerate(_null_rates(df, digits).values())])
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column_name"), F.col(f"c{i}").alias("null_rate")) for i, c in enumerate(df.columns)]
    )
    return _top_rates(rates.select(F.explode(pairs).alias("pair")).select("pair.*"), k)


QUARTILES = {"25%": 0.25, "50%": 0.5, "75%": 0.75}


class Profile:
    """Null rates of all columns, and totals and quartiles of some, of a table in two scans.

    The first scan runs when the profile is made and fetches one row: the rates, the totals,
    and brackets around the quartiles. The second, only where quartiles are asked for, counts
    what lies inside them.
    """

    def __init__(self, df: DataFrame, columns: Sequence[str], digits: int = 3, nulls: bool = True):
        self.df, self.columns = df, list(columns)
        rates = _null_rates(df, digits) if nulls else {}
        found = column_figures(df, self.columns, list(QUARTILES.values()), {f"null {c}": value for c, value in rates.items()})
        self.figures = {c: found[c] for c in self.columns}
        self.rates = {c: found[f"null {c}"] for c in rates}

    def null_rates(self, k: int = 10) -> DataFrame:
        """-> column_name, null_rate; as `null_profile`"""
        rows = self.df.sparkSession.createDataFrame(list(self.rates.items()), "column_name string, null_rate double")
        return _top_rates(rows, k)

    def summary(self) -> DataFrame:
        """-> statistic, one column per summarised column; as `numeric_summary`"""
        totals = ("count", "mean", "std", "min", "max")
        order = [*totals[:4], *QUARTILES, "max"]
        names = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(s).alias("statistic")) for i, s in enumerate(order)])
        cells = quantiles_between(self.df, self.columns, list(QUARTILES.values()), self.figures)
        # one row with the quartiles of all columns
        wide = cells.agg(
            *[
                F.max(F.when((F.col("metric") == c) & (F.col("probability") == p), F.col("quantile"))).alias(f"q{i}_{name}")
                for i, c in enumerate(self.columns)
                for name, p in QUARTILES.items()
            ]
        )

        def cell(i: int, c: str) -> Column:
            known = {name: F.lit(self.figures[c][name]).cast("double") for name in totals}
            values = [known.get(s, F.col(f"`q{i}_{s}`") if s in QUARTILES else None) for s in order]
            return F.get(F.array(*values), F.col("row.place")).alias(c)

        rows = wide.withColumn("row", F.explode(names)).orderBy("row.place")
        return rows.select("row.statistic", *[cell(i, c) for i, c in enumerate(self.columns)])


def numeric_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, mean, std, min, quartiles and max, one row per statistic
    -> statistic, one column per summarised column

    Quartiles are exact, with linear interpolation. Two scans, of which the first runs at once.
    """
    return Profile(df, columns, nulls=False).summary()


def pk_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys held by more than one row -> keys, rows"""
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).filter(F.col("rows") > 1)


def fk_orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Keys of the child that the parent lacks -> key, rows

    The child collapses to one row per key before the join. A NULL key refers to nothing.
    """
    referenced = child.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("rows"))
    return referenced.join(parent.select(key), key, "left_anti")


def domain_violations(df: DataFrame, domains: Mapping[str, Sequence[str]]) -> DataFrame:
    """Labels outside their accepted values -> column_name, value, rows; NULL passes"""
    cells = F.array(
        *[
            F.when(
                ~F.col(c).isin(*allowed), F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value"))
            )
            for c, allowed in domains.items()
        ]
    )
    return (
        df.select(F.explode(F.array_compact(cells)).alias("cell"))
        .groupBy("cell.column_name", "cell.value")
        .agg(F.count("*").alias("rows"))
    )


def stage_violations(events: DataFrame, stages: Sequence[str] = FUNNEL_STAGES) -> DataFrame:
    """Events whose stage_order disagrees with the stage, and sessions that skip a stage
    -> check, violations

    A session is complete when it shows every stage from the first to its deepest one.
    """
    position = ordinal(F.col("stage"), stages)
    sessions = (
        events.filter(F.col("session_id").isNotNull())
        .groupBy("session_id")
        .agg(
            F.sum(F.coalesce((position != F.col("stage_order")).cast("int"), F.lit(1))).alias("mismatches"),
            stage_words(position, len(stages)).alias("bits"),
            F.max(position).alias("deepest"),
        )
    )
    # All stages up to the deepest one are there: as many bits as it has places.
    seen = F.aggregate("bits", F.lit(0), lambda total, word: total + F.bit_count(word))
    skips = seen != F.col("deepest") + 1
    found = sessions.agg(
        F.coalesce(F.sum("mismatches"), F.lit(0)).alias("mismatches"),
        F.coalesce(F.sum(F.coalesce(skips, F.lit(True)).cast("bigint")), F.lit(0)).alias("skipping"),
    )
    checks = F.array(
        F.struct(F.lit("stage_order_mismatch").alias("check"), F.col("mismatches").alias("violations")),
        F.struct(F.lit("incomplete_prefix").alias("check"), F.col("skipping").alias("violations")),
    )
    return found.select(F.explode(checks).alias("row")).select("row.*")


def users_without_session(users: DataFrame, events: DataFrame, key: str = "user_id") -> DataFrame:
    """Users that never show up in the events -> key"""
    return users.select(key).join(events.select(key).distinct(), key, "left_anti")


def constraint_report(
    tables: Mapping[str, DataFrame],
    primary_keys: Mapping[str, Sequence[str]],
    foreign_keys: Sequence[tuple[str, str, str]],
    domains: Mapping[str, Sequence[str]],
) -> DataFrame:
    """Offending keys, references and labels of all tables, each table read once
    -> tbl, constraint, violations

    A row gives a cell for its key, one for each reference, and one for each label outside its
    domain; a parent's rows give the keys that references may name. All cells are counted by
    constraint and text in one aggregate, combined before the shuffle, so a key that most rows
    hold is one row per task. Counted are distinct keys and labels, as in the single checks.
    """
    checks: list[tuple[str, str, str]] = []
    rows = []
    text = lambda names: F.array(*[F.col(f"`{name}`").cast("string") for name in names])

    def cell(check: int, key: Column, side: str) -> Column:
        return F.struct(F.lit(check).alias("check"), key.alias("key"), *[F.lit(int(side == name)).cast("bigint").alias(name) for name in ("own", "named")])

    cells: dict[str, list[Column]] = {name: [] for name in tables}
    for name, keys in primary_keys.items():
        cells[name].append(cell(len(checks), text(keys), "own"))
        checks.append((name, f"primary key ({', '.join(keys)})", "key"))
    for name, key, parent in foreign_keys:
        # a NULL key refers to nothing
        cells[name].append(F.when(F.col(f"`{key}`").isNotNull(), cell(len(checks), text([key]), "own")))
        cells[parent].append(F.when(F.col(f"`{key}`").isNotNull(), cell(len(checks), text([key]), "named")))
        checks.append((name, f"{key} in {parent}", "reference"))
    for name, df in tables.items():
        own = {c: labels for c, labels in domains.items() if c in df.columns}
        for c, labels in own.items():
            cells[name].append(F.when(~F.col(f"`{c}`").isin(*labels), cell(len(checks), F.array(F.lit(c), F.col(f"`{c}`").cast("string")), "own")))
        if own:
            checks.append((name, f"labels of {', '.join(own)}", "label"))
    for name, df in tables.items():
        if cells[name]:
            rows.append(df.select(F.explode(F.array(*cells[name])).alias("cell")).filter("cell is not null").select("cell.*"))
    kind = F.get(F.array(*[F.lit(kind) for _, _, kind in checks]), F.col("check"))
    wrong = F.when(kind == "key", F.col("own") > 1).when(kind == "reference", (F.col("own") > 0) & (F.col("named") == 0)).otherwise(True)
    counted = union_all(rows).groupBy("check", "key").agg(F.sum("own").alias("own"), F.sum("named").alias("named"))
    found = counted.groupBy("check").agg(F.count_if(wrong).alias("violations"))
    # one row per check from here on; a check without any cell has no violations
    names = F.array(*[F.struct(F.lit(i).alias("check"), F.lit(t).alias("tbl"), F.lit(c).alias("constraint")) for i, (t, c, _) in enumerate(checks)])
    known = found.agg(F.map_from_entries(F.collect_list(F.struct("check", "violations"))).alias("known"))
    return known.select("known", F.explode(names).alias("of")).select(
        "of.tbl", "of.constraint", F.coalesce(F.try_element_at("known", F.col("of.check")), F.lit(0)).alias("violations")
    )
