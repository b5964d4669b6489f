"""Helpers shared by the training-data operators.

Intermediate tables go to the folder that the session names in
``spark.checkpoint.dir``; a private folder is made only where that setting is
empty, as in local tests.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word characters of the contracts: everything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_own_dirs: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, without a trailing slash."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="quern-")
    return _own_dirs[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quern/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: it cuts the lineage, and outlives executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quern_path = path
    return out


def drop_written(df: DataFrame) -> None:
    """Delete a table that ``written`` made and that no later plan reads."""
    path = getattr(df, "_quern_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def parts_of(rows: DataFrame, size: str, task_bytes: int) -> int:
    """How many tasks rows that stand for ``size`` bytes each are dealt over; a given number is kept, where small rows would be merged."""
    total = rows.agg(F.sum(size)).first()[0] or 0
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-int(total) // task_bytes))


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def sha256_hex(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, though f names it often."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def running(numbers: Column, combine: Callable[[Column, Column], Column], chunk: int = 256) -> Column:
    """An array's elements combined from the first, or from 0, up to each one, in two steps, as growing an array copies it."""
    n, zero = F.size(numbers), F.lit(0).cast("long")

    def grow(acc: Column, x: Column) -> Column:
        return F.concat(acc, F.array(combine(F.coalesce(F.try_element_at(acc, F.lit(-1)), zero), x.cast("long"))))

    none = F.array().cast("array<long>")
    parts = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / chunk).cast("int")), lambda c: F.aggregate(F.slice(numbers, c * chunk + 1, F.lit(chunk)), none, grow))
    sums = bound(
        parts,
        lambda p: bound(
            F.aggregate(p, F.array(zero), lambda acc, x: F.concat(acc, F.array(combine(F.element_at(acc, -1), F.element_at(x, -1))))),
            lambda before: F.flatten(F.transform(p, lambda x, i: F.transform(x, lambda y: combine(y, F.get(before, i))))),
        ),
    )
    return F.when(n > 0, sums).otherwise(none)


def running_sum(numbers: Column) -> Column:
    return running(numbers, lambda a, b: a + b)


def slices(text: Column, bounds: Column, chunk: int = 1024) -> Column:
    """The parts of a text for an array of (start, end) code points, in time that grows with their lengths alone.

    `substr` counts from the start of a text each time; here it counts from the start of a chunk.
    """

    def part(chunks: Column, start: Column, end: Column) -> Column:
        first, last = (start / chunk).cast("int"), ((end - 1) / chunk).cast("int")
        at = lambda c: F.greatest(start - c * chunk, F.lit(0))
        inside = F.transform(F.sequence(first, last), lambda c: F.substr(F.get(chunks, c), at(c) + 1, F.least(end - c * chunk, F.lit(chunk)) - at(c)))
        return F.when(end > start, F.array_join(inside, "")).otherwise("")

    return bound(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{chunk}}}"), F.lit(0)), lambda chunks: F.transform(bounds, lambda b: part(chunks, b["start"].cast("int"), b["end"].cast("int"))))


def join_counted(rows: DataFrame, side: DataFrame, on: str, total: int, count: str = "n", how: str = "inner") -> DataFrame:
    """``rows`` joined with ``side``, which has one row a key and in ``count`` the key's number of rows in ``rows``.

    ``total`` is the number of rows, so at most a thousand keys have more than a thousandth of them; those are
    broadcast, and their rows stay where they are.  All other keys meet in an exchange that none of them bends.
    """
    often = F.col(count) * 1000 > total
    hot = F.broadcast(side.where(often).drop(count))
    cold = side.where(~often).drop(count).hint("merge")
    return rows.join(hot, on).unionByName(rows.join(hot.select(on), on, "left_anti").join(cold, on, how), allowMissingColumns=True)
