"""Session builder with the settings every query of this package relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution and Arrow exchange; `conf` overrides any setting. The number of shuffle
    partitions is left to the cluster unless it is given; on one machine it is 8."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if shuffle_partitions or (master or "").startswith("local"):
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions or 8)
    settings |= conf
    builder = SparkSession.builder.appName("ledgerloom")
    if master:
        builder = builder.master(master)
    return builder.config(map=settings).getOrCreate()
