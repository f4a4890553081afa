"""Session defaults for local work; on a cluster the submitter's settings win."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

LOCAL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cpus: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A session on this machine, for tests and benchmarks."""
    os.environ.setdefault("PYSPARK_SUBMIT_ARGS", f"--driver-memory {memory} pyspark-shell")
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("bazaarlake")
    for key, value in {**LOCAL_CONF, "spark.sql.shuffle.partitions": str(cpus), **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
