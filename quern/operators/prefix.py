"""Ranges, running sums and ranks over a whole table, in two steps, so that no task sorts everything."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.session import cut


def _below(x: Column, bounds: Column, bits: int = 10) -> Column:
    """How many of the sorted ``bounds``, fewer than 2^bits, aren't above x: a binary search."""
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(bits))])
    return F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.get(bounds, at + step - 1) <= x, step).otherwise(F.lit(0)))


def _quantiles(order: str, parts: int) -> Column:
    none = F.array().cast("array<bigint>")
    if parts < 2:
        return F.max(none)
    return F.coalesce(F.percentile_approx(F.col(order).cast("bigint"), [i / parts for i in range(1, parts)], 20 * parts), none)


def with_range(data: DataFrame, order: str, rows_per_range: int, out: str = "_range", most: int = 1 << 18) -> DataFrame:
    """Adds the number of the row's range of the whole-number column ``order``; ranges ascend and hold about so many rows.

    Bounds are quantiles, so it doesn't matter how the numbers lie, and no sum or difference of them is
    taken.  They come in two levels, roots of the number of ranges, and travel as one row
    of at most ``most`` numbers.  Equal numbers share a range; null is in range -1.
    """
    n = min(most, max(1, -(-data.count() // rows_per_range)))
    first = math.ceil(math.sqrt(n))
    second = -(-n // first)
    outer = cut(data.agg(_quantiles(order, first).alias("_outer")))
    at = _below(F.col(order), F.col("_outer"))
    # At most ``first`` rows of as many numbers from here on; single rows are broadcast.
    inner = data.select(order).join(F.broadcast(outer)).groupBy(at.alias("_at")).agg(_quantiles(order, second).alias("_bounds"))
    inner = inner.agg(F.map_from_entries(F.collect_list(F.struct("_at", "_bounds"))).alias("_m"))
    lists = F.transform(F.sequence(F.lit(0), F.lit(first - 1)), lambda i: F.coalesce(F.try_element_at("_m", i), F.array().cast("array<bigint>")))
    bounds = cut(outer.join(F.broadcast(inner)).select("_outer", lists.alias("_inner")))
    placed = data.join(F.broadcast(bounds)).withColumn("_at", at)
    number = F.col("_at") * second + _below(F.col(order), F.get("_inner", F.col("_at")))
    return placed.withColumn(out, F.when(F.col(order).isNotNull(), number).otherwise(-1)).drop("_outer", "_inner", "_at")


def running_sum(data: DataFrame, value: str, order: str, keys: list[str] = (), out: str = "running", rows_per_range: int = 100_000) -> DataFrame:
    """Adds the sum of ``value`` over rows of the same keys up to and with this one, by the whole-number column ``order``.

    ``order`` is cut into ranges of about equally many rows; sums of ranges are added up first, then rows inside each.
    """
    keys = list(keys)
    rows = with_range(data, order, rows_per_range)
    sums = rows.groupBy(*keys, "_range").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_inside", F.sum(value).over(inside))
    return rows.join(sums, [*keys, "_range"]).withColumn(out, F.col("_before") + F.col("_inside")).drop("_range", "_before", "_inside")


def ranked(data: DataFrame, order: list[Column], parts: int | None = None, out: str = "rank") -> DataFrame:
    """Adds the place of each row in the given order, from 0; the result is a table in the shared folder.

    Rows are sorted in ranges; a row's place is its number in its range and the sizes of the ranges before, one number each.
    """
    parts = parts or data.sparkSession.sparkContext.defaultParallelism
    # The upper bits of the identifier are the range, the lower 33 count its rows; they hold in the written table.
    rows = cut(data.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    sizes = rows.groupBy(F.shiftright("_id", 33).alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    sizes = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    at = F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.join(F.broadcast(sizes), F.shiftright("_id", 33) == F.col("_part")).withColumn(out, at).drop("_id", "_part", "_before")
