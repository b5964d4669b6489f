"""Keyed map, shuffle and reduce on DataFrames.

Map and reduce are column expressions where they can be, so the optimiser sees
them and sums before the exchange; Python functions are taken too, in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.session import cut

from .prefix import ranked


def emit(data: DataFrame, pairs: Column) -> DataFrame:
    """(key, value): the map step.  ``pairs`` is an array of (key, value) structs; an empty or null one emits nothing, as does a null key or value."""
    return data.select(F.inline(pairs)).toDF("key", "value").where("key is not null and value is not null")


def emit_with(data: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """The map step by a Python function over batches, for what expressions can't say."""

    def run(batches):
        for b in batches:
            yield f(b)

    return data.mapInPandas(run, schema).where("key is not null and value is not null")


def reduce_pairs(pairs: DataFrame, *aggregates: Column) -> DataFrame:
    """One row per key.  Aggregates that can be summed in parts are, before the exchange: they are their own combiners."""
    return pairs.groupBy("key").agg(*aggregates)


def group_segments(pairs: DataFrame, values_per_segment: int = 1_000_000, most: int | None = None) -> DataFrame:
    """(key, segment, values): a key's values, repeats kept, sorted, in segments of so many, numbered from 0, so that no list outgrows a row."""
    return segments(pairs.select("key", "value"), "key", "value", "values", values_per_segment, most)


def segments(rows: DataFrame, key: str, value: str, out: str, per_segment: int, most: int | None = None, distinct: bool = False) -> DataFrame:
    """(key, segment, out): the values of each key in sorted lists of ``per_segment``.

    ``most`` bounds the number of values of a key; where it isn't known they are counted.  If no key has more than a segment,
    one exchange by key does.  Else values are sorted in ranges over all tasks and numbered by how many of their key come before,
    so neither a frequent key nor how the values lie matters.
    """
    rows = rows.select(key, value)
    if most is None:
        rows = cut(rows)  # read twice
        most = rows.groupBy(key).agg(F.count("*").alias("_n")).agg(F.max("_n")).first()[0] or 0
    if most <= per_segment:
        found = F.sort_array(F.collect_set(value) if distinct else F.collect_list(value))
        return rows.groupBy(key).agg(F.lit(0).cast("long").alias("segment"), found.alias(out))
    placed = ranked(rows.distinct() if distinct else rows, [F.col(key), F.col(value)], out="_rank")
    firsts = placed.groupBy(key).agg(F.min("_rank").alias("_first"))
    placed = placed.join(firsts, key).withColumn("segment", F.floor((F.col("_rank") - F.col("_first")) / per_segment))
    return placed.groupBy(key, "segment").agg(F.sort_array(F.collect_list(value)).alias(out))


def reduce_with(pairs: DataFrame, f: Callable[[object, Iterator[pd.Series]], Iterable], schema: str) -> DataFrame:
    """The reduce step by a Python function f(key, batches): the key's values in ascending order, in batches of bounded size, of which it holds one at a time.

    f gives rows as tuples; it may stop reading early.  Rows without a key are left out.  A key's rows are read by one task, but never held together.
    """
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def run(batches):
        source = _Runs(batches)
        while start := source.next_key():
            (key,), out = start, []
            for row in f(key, source.values(key)):
                out.append(row)
                if len(out) == 10_000:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            source.skip(key)
            if out:
                yield pd.DataFrame(out, columns=names)

    sorted_ = pairs.where("key is not null").select("key", "value").repartition("key").sortWithinPartitions("key", "value")
    return sorted_.mapInPandas(run, schema)


class _Runs:
    """Batches of rows sorted by key, given out key by key."""

    def __init__(self, batches: Iterator[pd.DataFrame]):
        self.batches, self.rest = batches, None

    def _fill(self) -> bool:
        while self.rest is None or self.rest.empty:
            self.rest = next(self.batches, None)
            if self.rest is None:
                return False
        return True

    def next_key(self) -> tuple | None:
        return (self.rest["key"].iloc[0],) if self._fill() else None

    def values(self, key) -> Iterator[pd.Series]:
        while self._fill() and self.rest["key"].iloc[0] == key:
            same = (self.rest["key"] == key).to_numpy()
            n = len(same) if same.all() else int(same.argmin())
            part, self.rest = self.rest["value"].iloc[:n], self.rest.iloc[n:]
            yield part

    def skip(self, key) -> None:
        for _ in self.values(key):
            pass


def rounds(data: DataFrame, step: Callable[[DataFrame, int], DataFrame], most: int, done: Callable[[DataFrame], bool] | None = None) -> DataFrame:
    """Repeats a job on its own result at most so often; the lineage is cut after each round."""
    for i in range(most):
        data = cut(step(data, i))
        if done is not None and done(data):
            break
    return data


def save(result: DataFrame, path: str | None = None, table: str | None = None) -> DataFrame:
    """Keeps a job's result distributed, as files or a table, instead of bringing it to the driver."""
    if table:
        result.write.mode("overwrite").saveAsTable(table)
        return result.sparkSession.table(table)
    result.write.mode("overwrite").parquet(path)
    return result.sparkSession.read.schema(result.schema).parquet(path)


def reduce_side_join(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Joins (key, value) tables by key: what tagging both and reducing by key would do, left to the planner."""
    return left.withColumnRenamed("value", "left_value").join(right.withColumnRenamed("value", "right_value"), "key", how)
