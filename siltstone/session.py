"""A session with the settings that results depend on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "siltstone", master: str | None = None, **conf: str) -> SparkSession:
    """Adaptive execution, UTC, Arrow; partition sizes are left to the cluster unless given."""
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    return b.config(map=settings).getOrCreate()


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many tasks as the session has cores, where it has fewer.

    For work that costs far more than moving its rows, on files of few row groups; large
    inputs have enough tasks and stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
