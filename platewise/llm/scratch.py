"""Intermediate tables in the shared folder that the session names.

A written table cuts the lineage: a task that is lost later reads the table again and
starts no earlier stage anew. `spark.checkpoint.dir` must name storage that the driver and
all executors share. Only where it is unset (local sessions of tests) a folder is made.
"""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

FOLDER = "spark.checkpoint.dir"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_folder(spark: SparkSession) -> str:
    folder = spark.conf.get(FOLDER, None) or spark.sparkContext.getConf().get(FOLDER)
    return (folder or _own_folder()).rstrip("/")


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="scratch-")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read back from a table of their own.

    The shuffle files behind the table are dropped once it is written, and the table
    itself goes when the application ends.
    """
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    try:
        spark.conf.set(CLEANUP, "true")
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    location = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(location)
    return spark.read.schema(df.schema).parquet(path)


def schema_with(df: DataFrame, **kinds: str) -> T.StructType:
    """The schema of `df` and further columns behind it."""
    return T.StructType([*df.schema.fields, *(T.StructField(name, T.DataType.fromDDL(kind)) for name, kind in kinds.items())])


def plainly_named(docs: DataFrame, *keep: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The table with its columns numbered, but those to keep, and what gives them their names back.

    So no name of the caller's clashes with one that an operator uses.
    """
    names = docs.columns
    return docs.toDF(*[name if name in keep else f"column_{i}" for i, name in enumerate(names)]), lambda rows: rows.toDF(*names)


_made: dict[str, Any] = {}


class Sent:
    """A broadcast value of bounded size, made ready once in each worker by `make`."""

    def __init__(self, spark: SparkSession, value: Any, make: Callable[[Any], Any] = lambda value: value):
        self.key, self.make, self.held = uuid.uuid4().hex, make, spark.sparkContext.broadcast(value)

    def get(self) -> Any:
        if self.key not in _made:
            _made.clear()
            _made[self.key] = self.make(self.held.value)
        return _made[self.key]
