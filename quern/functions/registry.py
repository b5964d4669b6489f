"""Named Python functions that queries call, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf


def put(spark: SparkSession, name: str, f: Callable, returns: str) -> None:
    """Registers a function of pandas series under a name, for SQL and `expr`; a later one takes its place."""
    spark.udf.register(name, pandas_udf(f, returns))


def has(spark: SparkSession, name: str) -> bool:
    return spark.catalog.functionExists(name)
