"""Session settings that suit the engine; on a cluster, submit-time settings win."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, partitions: int | None = None, **more: str) -> SparkSession:
    builder = SparkSession.builder.appName("loomline")
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.ui.showConsoleProgress": "false"}
    if partitions:
        settings["spark.sql.shuffle.partitions"] = str(partitions)
    for key, value in (settings | more).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
