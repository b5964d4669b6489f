"""Python table functions that SQL calls: several rows for each row, or for each partition of a table."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import LongType, StructType, TimestampType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn


def put(spark: SparkSession, name: str, f: Callable[..., Iterable[tuple]], returns: str) -> None:
    """Registers a map that gives any number of rows: ``SELECT t.*, p.* FROM t, LATERAL name(t.x) p``."""

    class Rows:
        def eval(self, *args):
            yield from f(*args)

    spark.udtf.register(name, udtf(Rows, returnType=returns))


class Sessions:
    """Rows of each key, cut where the time between two of them exceeds a gap: ``sessions(TABLE(t), 'user_id', 'ts', 1800)``.

    The schema follows the table's: the key as it is, then the session's number, first and last time, and number of rows.
    Spark brings the rows of a key together, sorted by time; one row of each session is held.
    """

    @staticmethod
    def analyze(table: AnalyzeArgument, key: AnalyzeArgument, time: AnalyzeArgument, seconds: AnalyzeArgument) -> AnalyzeResult:
        if not isinstance(table.dataType, StructType) or not {key.value, time.value} <= set(table.dataType.names):
            raise ValueError(f"sessions needs a table with the columns {key.value} and {time.value}")
        schema = StructType().add(table.dataType[key.value]).add("session", LongType()).add("began", TimestampType()).add("ended", TimestampType()).add("n", LongType())
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn(key.value)], orderBy=[OrderingColumn(time.value)])

    def __init__(self):
        self.now, self.number = None, 0

    def eval(self, row, key: str, time: str, seconds: int):
        at = row[time]
        if self.now and (at is None or self.now[2] is None or (at - self.now[2]).total_seconds() <= seconds):
            self.now = (self.now[0], self.now[1], at, self.now[3] + 1)
            return
        if self.now:
            yield self._row()
        self.now = (row[key], at, at, 1)

    def _row(self) -> tuple:
        key, began, ended, n = self.now
        self.number += 1
        return key, self.number, began, ended, n

    def terminate(self):
        if self.now:
            yield self._row()


def register(spark: SparkSession) -> None:
    spark.udtf.register("sessions", udtf(Sessions))
