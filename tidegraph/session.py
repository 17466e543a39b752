"""Session settings the library relies on."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


#: Rows that cross to a Python worker at once, where the session doesn't say; long texts make Spark's own 10,000 heavy.
ROWS_AT_ONCE = 500


def ship(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from the folder the driver found it in, and bounds what they get at once.

    On a cluster without a common installation folder, pass the package with ``--py-files`` instead.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_AT_ONCE))
    root = str(Path(__file__).resolve().parent.parent)
    paths = [p for p in spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *paths])
    return spark


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "4g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tidegraph")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)
