"""Sinks. Every write replaces what was there, so a rerun is idempotent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _as_csv_text(df: DataFrame) -> DataFrame:
    """Booleans as True/False, timestamps as 'yyyy-MM-dd HH:mm:ss[.f]'."""
    columns = []
    for f in df.schema.fields:
        column = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.BooleanType):
            column = F.initcap(column.cast("string"))
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            column = column.cast("string")
        columns.append(column.alias(f.name))
    return df.select(*columns)


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """CSV with a header line. `single_file` is for report tables of a few rows."""
    text = _as_csv_text(df)
    writer = (text.coalesce(1) if single_file else text).write.mode("overwrite")
    # blanks around a text are part of it
    blanks = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    writer.options(header=True, escape='"', **blanks).csv(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_scalar(df: DataFrame, path: str, digits: int = 4) -> None:
    """A one-row, one-column result as a line 'name=value'."""
    (name,) = df.columns
    line = F.format_string(f"{name}=%.{digits}f", F.col(name).cast("double"))
    df.select(line.alias("value")).coalesce(1).write.mode("overwrite").text(path)


def save_table(df: DataFrame, name: str, fmt: str = "parquet") -> None:
    """Replace a catalog table."""
    df.write.mode("overwrite").format(fmt).saveAsTable(name)


def write_days(df: DataFrame, path: str, column: str = "day") -> None:
    """A store in parquet, one folder per value of a date column; values in `df` replace those
    already there, all others stay as they are. A rerun of a day leaves the same store."""
    # rows of a value meet before the write, in as many tasks as their size asks for
    spread = df.hint("rebalance", column)
    spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def save_bucketed(df: DataFrame, name: str, key: str, buckets: int, fmt: str = "parquet") -> None:
    """Replace a catalog table, dealt into buckets by `key` and sorted by it within.

    Aggregates and joins by the key between tables of equally many buckets need no shuffle.
    """
    # one file per bucket
    dealt = df.repartition(buckets, F.col(f"`{key}`"))
    dealt.write.mode("overwrite").format(fmt).bucketBy(buckets, key).sortBy(key).saveAsTable(name)
