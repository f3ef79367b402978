"""Session settings, and a local session for tests and the benchmark."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Adaptive execution sizes and splits shuffle partitions by what they measure.
# Forcing the skew split also covers a join whose result is grouped by the join
# key, at the price of one more shuffle where it applies.
RUN_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Facts stored range by range, or by store-product, then join without an exchange.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
}

# Fixed when a session starts. Recording the call site of every column expression
# slows planning down.
START_SETTINGS = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def prepare(spark: SparkSession) -> SparkSession:
    """Give a running session the settings the reports are run with, and return it.

    To be called once by whoever owns the session: no report calls it. Without them
    results are the same; a hot store-product is then not split where a join is
    followed by a grouping on its keys.
    """
    for name, value in RUN_SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def local_session(cores: int | str = "*", memory: str = "8g", **settings: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("shelflight")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
    )
    for name, value in {**RUN_SETTINGS, **START_SETTINGS, **settings}.items():
        builder = builder.config(name, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session
