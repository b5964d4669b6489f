"""Stored tables: created where missing, appended to, read by latest write, emptied.

A store is a folder of Parquet files.  Writes are appended with their order in
``seq``, and what a key holds is settled when the store is read, so a write
never rewrites what is there.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY_VALUES = "key string, seq long, value string"
VECTORS = "doc_id long, embedding array<double>, seq long"


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none where there is no folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(x.getPath().getName() for x in fs.listStatus(place)) if fs.exists(place) else []


def remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def listing(spark: SparkSession, *paths: str) -> str:
    """A digest of the names, sizes and times of all files under the paths; other contents give another one."""
    found = []
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = place.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(place, True)
        while files.hasNext():
            f = files.next()
            found.append(f"{f.getPath()}|{f.getLen()}|{f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()[:32]


def stored(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table in a folder; where there is none, it is made, written under a name of its own, and then given this one."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(place):
        draft = f"{path}.{uuid.uuid4().hex}"
        make().write.parquet(draft)
        if not fs.exists(place):
            fs.rename(spark._jvm.org.apache.hadoop.fs.Path(draft), place)
    return spark.read.parquet(path)


@dataclass(frozen=True)
class Store:
    """A stored table; all who name the same path share it."""

    spark: SparkSession
    path: str
    schema: str

    def create(self) -> Store:
        """Makes an empty store, or leaves the one that is there."""
        self.spark.createDataFrame([], self.schema).write.mode("ignore").parquet(self.path)
        return self

    def append(self, rows: DataFrame) -> Store:
        names = [c.split()[0] for c in self.schema.split(", ")]
        rows.select(*names).write.mode("append").parquet(self.path)
        return self

    def read(self) -> DataFrame:
        """Every write."""
        return self.spark.read.schema(self.schema).parquet(self.path)

    def latest(self, key: str, value: str) -> DataFrame:
        """(key, value) of the last write of each key."""
        return self.read().groupBy(key).agg(F.max_by(value, "seq").alias(value))

    def reset(self) -> Store:
        """Takes everything away and leaves an empty store."""
        remove(self.spark, self.path)
        return self.create()
