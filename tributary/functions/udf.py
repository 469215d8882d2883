"""User functions, usable in every expression of a pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .types import spark_type


def register_function(spark: SparkSession, name: str, f: Callable, returns: str, aggregate: bool = False) -> None:
    """Registers a vectorised function of pandas Series; ``aggregate`` takes series and gives one value."""
    kind = {"functionType": F.PandasUDFType.GROUPED_AGG if aggregate else F.PandasUDFType.SCALAR}
    spark.udf.register(name, F.pandas_udf(f, spark_type(returns), **kind))


def register_table_function(spark: SparkSession, name: str, cls: type, returns: str) -> None:
    """Registers a class with ``eval`` that yields rows."""
    spark.udtf.register(name, F.udtf(cls, returnType=returns))
