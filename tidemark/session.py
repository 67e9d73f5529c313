"""Session set-up shared by the command line, the benchmark and the tests."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_spark(app: str = "tidemark", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """Return a session with UTC time, adaptive plans and the UI switched off.

    ``master`` and ``shuffle_partitions`` stay unset on a cluster, where the submit command fixes them.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()
