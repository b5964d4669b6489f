"""Tables laid out by the hash of a key: each bucket is what one owner holds.

A lookup reads the files of one bucket, and tables with the same number of buckets are joined and grouped by
the key without an exchange.  The files can be opened by another session, which only needs to know the key and the number of buckets.
A key's rows are in one bucket, so this is for keys none of which has a large share of a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def lay_out(rows: DataFrame, name: str, path: str, key: str, buckets: int) -> DataFrame:
    """Writes a table by the hash of ``key``, a file a bucket, sorted by the key."""
    rows.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).mode("overwrite").option("path", path).saveAsTable(name)
    return rows.sparkSession.table(name)


def open_table(spark: SparkSession, name: str, path: str, schema: str, key: str, buckets: int) -> DataFrame:
    """A laid-out table whose files are there already."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def put(table: DataFrame, name: str, path: str, rows: DataFrame, key: str, buckets: int) -> DataFrame:
    """A new table of the old rows and these, which take the place of rows with their keys; each row goes to its owner."""
    kept = table.join(rows.select(key).distinct(), key, "left_anti")
    return lay_out(kept.unionByName(rows), name, path, key, buckets)


def get(table: DataFrame, key: str, value) -> DataFrame:
    return table.where(F.col(key) == F.lit(value))
