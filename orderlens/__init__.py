"""Commerce analytics operators and named queries on PySpark DataFrames."""

from orderlens.sources.columnar import model_from_parquet, write_roles
from orderlens.sources.csv import model_from_csv
from orderlens.sources.model import CommerceModel, StateLookup
from orderlens.sources.star import model_from_star

__all__ = [
    "CommerceModel",
    "StateLookup",
    "model_from_csv",
    "model_from_parquet",
    "model_from_star",
    "write_roles",
]
