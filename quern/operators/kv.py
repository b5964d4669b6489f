"""Key-value tables as DataFrame functions.

A table has rows (key, seq, value): ``seq`` is the order of writes.  In an append
table a key has all its values; in an overwriting one the last.  Namespaces are
a column ``gid`` that every function leaves alone when it is given in ``by``.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keys(data: DataFrame) -> DataFrame:
    return data.select("key").distinct()


def get(data: DataFrame, key, by: tuple[str, ...] = ()) -> DataFrame:
    """All values of one key in order; no row if there is none.  The filter reaches the scan."""
    return append_values(data.where(F.col("key") == F.lit(key)), by)


def append_values(data: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(key, values) with every value in the order of writes."""
    return data.groupBy(*by, "key").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "value"))), lambda x: x.value).alias("values"))


def last_values(data: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(key, value) with the last write of each key; one row per key and task is exchanged."""
    return data.groupBy(*by, "key").agg(F.max_by("value", "seq").alias("value"))


def content_key(value: Column) -> Column:
    """SHA-256 of the value as a JSON string."""
    return F.sha2(F.to_json(F.array(value)).substr(F.lit(2), F.length(F.to_json(F.array(value))) - 2).cast("binary"), 256)


@contextmanager
def in_memory(data: DataFrame) -> Iterator[DataFrame]:
    """The table kept by the executors inside a ``with`` block; what doesn't fit their memory is on their disks."""
    held = data.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield held
    finally:
        held.unpersist()


def put(data: DataFrame, writes: DataFrame) -> DataFrame:
    return data.unionByName(writes)


def delete(data: DataFrame, gone: DataFrame) -> DataFrame:
    """The table without the given keys; keys that it doesn't have are no error."""
    return data.join(gone.select("key").distinct(), "key", "left_anti")


def deleted(data: DataFrame, gone: DataFrame) -> DataFrame:
    """What `delete` takes away."""
    return data.join(gone.select("key").distinct(), "key", "left_semi")
