"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession

FILE_ROWS = 10_000  # rows that a file holds at least, where their number is known


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset, a temporary folder on a single machine and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith(("local[", "local ")) and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return folder or _own_folder()


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="llm-")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def in_files(df: DataFrame, rows: int) -> DataFrame:
    """`df` of about `rows` rows, dealt anew to as many tasks, and so files, as they fill with FILE_ROWS each.

    On a local disk Hadoop starts a process for each file to set its permissions; until
    that runs its own program it counts as a second copy of the executor's memory.
    A coalesce() behind a sort-merge join would keep the memory of each joined
    partition until the task ends.
    """
    return df.repartition(rows // FILE_ROWS + 1)


def saved(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it back: the lineage ends there.

    A lost executor costs later readers nothing, as the files are not on its disk.
    With `rows`, about how many there are, a small table goes to few files.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    (df if rows is None else in_files(df, rows)).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
