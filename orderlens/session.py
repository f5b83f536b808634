"""Session settings that suit the operators on one machine and on a cluster."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Adaptive execution sizes shuffle partitions at run time, splits skewed join
# partitions and turns sort-merge joins into broadcast joins once real sizes are
# known. Zone-free timestamps make the session zone irrelevant to results; it is
# pinned for display.
COMMON_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.session.timeZone": "UTC",
    # Saves several driver round trips for every column expression built.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(cores: int | str = "*", app: str = "orderlens", **settings: str) -> SparkSession:
    """A single-machine session for tests and benchmarks.

    On a cluster use the session the platform provides, with COMMON_SETTINGS and
    ``spark.sql.adaptive.coalescePartitions.initialPartitionNum`` sized to the
    shuffled bytes: adaptive execution merges partitions, but splits none of an
    aggregation.
    """
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    local = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.shuffle.partitions": "8",
    }
    for key, value in {**COMMON_SETTINGS, **local, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
