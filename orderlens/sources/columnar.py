"""A columnar copy of the nine roles, for repeated analysis of large CSV exports."""

from __future__ import annotations

from pyspark.sql import SparkSession

from orderlens.sources.model import CommerceModel
from orderlens.sources.schemas import ROLE_COLUMNS


def write_roles(model: CommerceModel, out_dir: str) -> None:
    """Write every role as Parquet below ``out_dir``.

    CSV is parsed once; later queries read only the columns they use, with
    filters pushed to the files, and multi-line text no longer limits a file to
    one task.
    """
    for role, df in model.roles.items():
        df.write.mode("overwrite").parquet(f"{out_dir}/{role}")


def model_from_parquet(spark: SparkSession, directory: str, delivered_status: str = "delivered") -> CommerceModel:
    """The model over roles written by :func:`write_roles`."""
    roles = {role: spark.read.parquet(f"{directory}/{role}") for role in ROLE_COLUMNS}
    return CommerceModel.from_roles(spark, roles, delivered_status)
