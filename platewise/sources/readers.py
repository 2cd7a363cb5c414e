"""CSV readers. All fields are read as text and typed by explicit rules."""

from __future__ import annotations

import csv
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from platewise.functions.text import number, true_text, whole, without_cr
from platewise.schemas import TABLES


def read_raw_orders(spark: SparkSession, path: str, multi_line: bool = False, broken: str | None = None) -> DataFrame:
    """The raw order files as text columns, named by the header line, which all files must share.

    Fields may be quoted, with doubled quotes inside. `multi_line` also allows line breaks
    inside quotes; a file is then read by one task. `broken` names a further column that holds
    the text of records with too few or too many fields, else NULL.
    """
    options = {"header": True, "inferSchema": False, "quote": '"', "escape": '"', "multiLine": multi_line}
    names = spark.read.options(**options).csv(path).columns
    return _read_texts(spark, path, names, options, broken)


def _read_texts(spark: SparkSession, path: str, header: Sequence[str], options: dict, broken: str | None) -> DataFrame:
    """Text columns. Every file is held to the header as it is read, which costs no further scan."""
    fields = [T.StructField(name, T.StringType(), True) for name in [*header, *([broken] if broken else [])]]
    options = {"enforceSchema": False, **options} | ({"columnNameOfCorruptRecord": broken} if broken else {})
    return spark.read.schema(T.StructType(fields)).options(**options).csv(path)


def _typed(field: T.StructField) -> Column:
    text = F.col(field.name)
    if isinstance(field.dataType, T.BooleanType):
        return true_text(text)
    value = F.nullif(without_cr(text), F.lit(""))
    if isinstance(field.dataType, T.DoubleType):
        return number(value)
    if isinstance(field.dataType, T.IntegerType):
        return whole(value)
    if isinstance(field.dataType, T.StringType):
        return value
    return value.try_cast(field.dataType)


def typed(texts: DataFrame, schema: T.StructType) -> DataFrame:
    """Text columns named like the schema's, each as its type; what does not fit is NULL, or false."""
    return texts.select(*[_typed(f).alias(f.name) for f in schema.fields])


def _checked_header(spark: SparkSession, path: str, names: list[str], sep: str) -> list[str]:
    """The first file's header as it stands, once it is known to name the columns.

    A byte order mark, blanks and a carriage return stay: the other files have them too.
    """
    first = spark.read.option("lineSep", "\n").text(path).first()
    found = next(csv.reader([first.value.removesuffix("\r")], delimiter=sep)) if first else list(names)
    if [name.removeprefix("\ufeff").strip() for name in found] != list(names):
        raise ValueError(f"{path} has the columns {found}, expected {names}")
    return [*found[:-1], found[-1] + "\r" * (bool(first) and first.value.endswith("\r"))]


def read_csv_table(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    sep: str = ",",
    by_position: bool = False,
    multi_line: bool = False,
    broken: str | None = None,
) -> DataFrame:
    """A CSV file with a header line into a typed table.

    The header must name the schema's columns in order, and be the same line in every file: a
    file whose header differs fails the read. With `by_position` headers are skipped unread. Fields may be quoted; empty fields are NULL; booleans are the text 'True' or
    false; a carriage return left on the last field is removed. `multi_line` allows line
    breaks inside quotes. `broken` names a further column that holds the text of records
    with too few or too many fields, else NULL.
    """
    options = {"header": True, "sep": sep, "quote": '"', "escape": '"', "multiLine": multi_line, "enforceSchema": by_position}
    if not multi_line:
        options["lineSep"] = "\n"
    header = schema.names if by_position else _checked_header(spark, path, schema.names, sep)
    if multi_line:
        # there the parser tells line ends and byte order marks itself
        header = [name.removeprefix("\ufeff").removesuffix("\r") for name in header]
    raw = _read_texts(spark, path, header, options, broken).toDF(*schema.names, *([broken] if broken else []))
    return typed(raw, schema) if not broken else raw.select(*[_typed(f).alias(f.name) for f in schema.fields], broken)


def broken_records(df: DataFrame, broken: str) -> DataFrame:
    """One row: how many records of a table read with `broken` were malformed -> broken_records"""
    return df.agg(F.count(broken).alias("broken_records"))


def read_table(spark: SparkSession, path: str, name: str, **options) -> DataFrame:
    """One of the five model tables from CSV; options as for `read_csv_table`."""
    return read_csv_table(spark, path, TABLES[name], **options)


def read_parquet_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
