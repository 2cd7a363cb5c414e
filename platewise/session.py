"""Local sessions for tests and the benchmark. On a cluster the session is given."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", memory: str = "8g") -> SparkSession:
    """AQE sizes shuffles at run time; the shuffle partition number only caps a local run.

    Call-site capture for every Column call is off: it takes longer than planning.
    """
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("platewise")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores if cores != "*" else os.cpu_count()))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="warehouse-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
