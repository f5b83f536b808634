"""CSV readers for the nine roles."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderlens.sources.model import CommerceModel
from orderlens.sources.records import csv_records
from orderlens.sources.schemas import COLUMN_ALIASES, ROLE_COLUMNS, ROLE_FILES

# FAILFAST: a value that can't be read as its declared type is an error, not NULL.
_OPTIONS = {"header": True, "quote": '"', "escape": '"', "mode": "FAILFAST"}

# Roles with free text, whose quoted values may hold line breaks.
_MULTI_LINE = {"order_reviews"}


def _matches(spark: SparkSession, pattern: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(path)
    return [status.getPath().toString() for status in found or []]


def role_paths(spark: SparkSession, directory: str) -> dict[str, list[str]]:
    """Files of every role, looked up through the file system Spark itself uses."""
    return {role: _matches(spark, f"{directory}/{name}") for role, name in ROLE_FILES.items()}


def require_inputs(spark: SparkSession, directory: str, roles: Sequence[str] = tuple(ROLE_FILES)) -> dict[str, list[str]]:
    """Fail early, naming every role that has no file in ``directory``."""
    paths = role_paths(spark, directory)
    missing = [f"{role} ({ROLE_FILES[role]})" for role in roles if not paths[role]]
    if missing:
        raise FileNotFoundError(f"no input under {directory} for: {', '.join(missing)}")
    return {role: paths[role] for role in roles}


def read_role(spark: SparkSession, directory: str, role: str) -> DataFrame:
    """Read one role with its declared types.

    Only header lines are looked at beforehand; types are declared, never
    inferred from the data. Columns are matched by name in each file: files with
    the same header are read together. Columns outside the role are pruned by the
    reader. A value that does not fit its type stops the read. Files of reviews are
    split like all others, see :mod:`orderlens.sources.records`.
    """
    paths = require_inputs(spark, directory, [role])[role]
    reader = spark.read.options(**_OPTIONS, multiLine=role in _MULTI_LINE)
    by_header: dict[tuple[str, ...], list[str]] = {}
    for path in paths:
        by_header.setdefault(tuple(reader.csv(path).columns), []).append(path)
    parts = [_read_files(reader, header, files, role) for header, files in by_header.items()]
    return reduce(DataFrame.unionByName, parts)


def _parsed(spark: SparkSession, files: list[str], schema: T.StructType) -> DataFrame:
    """Records of files with line breaks inside values, without the header record."""
    records = csv_records(spark, files).where(F.col("_number") > 1)
    options = {k: str(v) for k, v in _OPTIONS.items() if k != "header"} | {"multiLine": "true"}
    places = ", ".join(f"_c{k} {field.dataType.simpleString()}" for k, field in enumerate(schema))
    row = records.select(F.from_csv("record", places, options).alias("_row"))
    return row.select(*[F.col(f"_row._c{k}").alias(field.name) for k, field in enumerate(schema)])


def _read_files(reader: DataFrameReader, header: Sequence[str], files: list[str], role: str) -> DataFrame:
    wanted = ROLE_COLUMNS[role]
    names = [COLUMN_ALIASES.get(name, name) for name in header]
    absent = sorted(set(wanted) - set(names))
    if absent:
        raise ValueError(f"role {role} lacks columns: {', '.join(absent)}")
    schema = T.StructType(
        [T.StructField(h, T._parse_datatype_string(wanted.get(n, "string"))) for h, n in zip(header, names)]
    )
    source = dict(zip(names, header))
    spark = reader._spark
    df = _parsed(spark, files, schema) if role in _MULTI_LINE else reader.schema(schema).csv(files)
    return df.select(*[F.col(f"`{source[name]}`").alias(name) for name in wanted])


def model_from_csv(spark: SparkSession, directory: str, delivered_status: str = "delivered") -> CommerceModel:
    require_inputs(spark, directory)
    roles = {role: read_role(spark, directory, role) for role in ROLE_COLUMNS}
    return CommerceModel.from_roles(spark, roles, delivered_status)
