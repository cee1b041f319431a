"""Session defaults shared by tests, the bench and interactive use."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_session(app: str = "vellumark", cores: int | str | None = None, **extra: str) -> SparkSession:
    """A local session with the settings the plans expect; on a cluster the running session is returned."""
    n = cores or os.environ.get("BENCH_CPUS", "8")
    conf = {
        "spark.master": f"local[{n}]",
        "spark.app.name": app,
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.host": "127.0.0.1",
    } | extra
    if SparkSession.getActiveSession() is None and "SPARK_MASTER" in os.environ:
        conf["spark.master"] = os.environ["SPARK_MASTER"]
    spark = SparkSession.builder.config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
