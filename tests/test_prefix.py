"""Ranges, running sums and ranks against plain lists."""

import random

from pyspark.sql import functions as F

from quern.operators import prefix


def numbers(spark, values):
    return spark.createDataFrame([(v, i) for i, v in enumerate(values)], "x long, i long")


def test_ranges_ascend_and_are_even_wherever_the_numbers_lie(spark):
    values = list(range(3000)) + [2**55, -(2**62) - 5, 2**62 + 7, -(2**63), 2**63 - 1]
    got = prefix.with_range(numbers(spark, values), "x", 100).orderBy("x").select("_range").collect()
    found = [r._range for r in got]
    assert found == sorted(found) and len(set(found)) >= 20
    assert max(found.count(r) for r in set(found)) < 400


def test_equal_numbers_and_nulls(spark):
    got = prefix.with_range(numbers(spark, [7] * 500 + [None] * 3 + [8]), "x", 10).select("x", "_range").distinct().collect()
    at = {r.x: r._range for r in got}
    assert len(got) == 3 and at[None] == -1 and at[7] <= at[8]
    assert prefix.with_range(numbers(spark, []), "x", 10).count() == 0


def test_running_sums(spark):
    rng = random.Random(4)
    values = rng.sample(range(-(2**40), 2**62), 700)
    rows = numbers(spark, values).withColumn("k", F.col("x") % 3)
    for keys in ([], ["k"]):
        got = {r.x: r.running for r in prefix.running_sum(rows.withColumn("one", F.lit(1)), "one", "x", keys, rows_per_range=50).collect()}
        same = (lambda a, b: True) if not keys else (lambda a, b: (abs(a) % 3) * (1 if a > 0 else -1) == (abs(b) % 3) * (1 if b > 0 else -1))
        assert got == {v: sum(1 for u in values if u <= v and same(u, v)) for v in values}


def test_ranks(spark):
    values = random.Random(5).sample(range(10_000), 900)
    got = {r.x: r["rank"] for r in prefix.ranked(numbers(spark, values), [F.col("x").desc()], 7).collect()}
    assert got == {v: i for i, v in enumerate(sorted(values, reverse=True))}
    assert prefix.ranked(numbers(spark, []), [F.col("x")]).count() == 0
