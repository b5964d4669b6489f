"""Golden results: map, shuffle and reduce, and key-value tables."""

import pandas as pd
from pyspark.sql import functions as F

from quern.functions import text
from quern.operators import kv, mapreduce

READINGS = [
    ("000", "006701199099999 1950 0515070049999999N9 +0000 1+9999"),
    ("106", "004301199099999 1950 0515120049999999N9 +0022 1+9999"),
    ("212", "004301199099999 1950 0515180049999999N9 -0011 1+9999"),
    ("318", "004301265099999 1949 0324120040500001N9 +0111 1+9999"),
    ("424", "004301265099999 1949 0324180040500001N9 +0078 1+9999"),
]


def test_max_temperature_by_year(spark):
    rows = spark.createDataFrame(READINGS, "key string, value string")
    f = text.fields(F.col("value"))
    pairs = mapreduce.emit(rows, F.array(F.struct(F.get(f, F.lit(1)), text.leading_int(F.get(f, F.lit(3))))))
    out = mapreduce.reduce_pairs(pairs, F.max("value").alias("top")).collect()
    assert {r.key: r.top for r in out} == {"1950": 22, "1949": 111}


def test_word_count_keeps_case_and_punctuation(spark):
    lines = ["It was the best of times, it was the worst of times,", "it was  the age"]
    rows = spark.createDataFrame(list(enumerate(lines)), "k int, value string")
    pairs = mapreduce.emit(rows, F.transform(text.fields(F.col("value")), lambda w: F.struct(w, F.lit(1))))
    got = {r.key: r.n for r in mapreduce.reduce_pairs(pairs, F.sum("value").alias("n")).collect()}
    assert got == {"It": 1, "was": 3, "the": 3, "best": 1, "of": 2, "times,": 2, "it": 2, "worst": 1, "age": 1}


def test_nulls_are_not_emitted(spark):
    rows = spark.createDataFrame([("a", None), (None, 1), ("b", 2)], "k string, v int")
    assert mapreduce.emit(rows, F.array(F.struct("k", "v"))).collect() == [("b", 2)]


def test_python_map_and_reduce(spark):
    rows = spark.createDataFrame([(1,), (2,), (3,)], "x long")
    pairs = mapreduce.emit_with(rows, lambda b: pd.DataFrame({"key": ["odd" if x % 2 else "even" for x in b.x], "value": b.x}), "key string, value long")
    out = mapreduce.reduce_with(pairs, lambda k, batches: [(k, sum(int(b.sum()) for b in batches))], "key string, total long")
    assert {r.key: r.total for r in out.collect()} == {"odd": 4, "even": 2}


def test_a_reducer_sees_sorted_batches_and_may_stop(spark):
    """One key has nearly all of two million values; no batch is larger than a few thousand of them."""
    pairs = spark.range(2_000_000).select(F.when(F.col("id") % 1000 == 0, F.concat(F.lit("k"), (F.col("id") % 7).cast("string"))).otherwise("hot").alias("key"), (-F.col("id")).alias("value"))

    def check(key, batches):
        largest, n, last, ordered = 0, 0, None, True
        for b in batches:
            largest, n = max(largest, len(b)), n + len(b)
            ordered &= b.is_monotonic_increasing and (last is None or b.iloc[0] >= last)
            last = b.iloc[-1]
        yield key, largest, n, bool(ordered)

    got = {r.key: r for r in mapreduce.reduce_with(pairs, check, "key string, largest long, n long, ordered boolean").collect()}
    assert got["hot"].n == 1_998_000 and got["hot"].largest <= 10_000 and all(r.ordered for r in got.values()) and sum(r.n for r in got.values()) == 2_000_000
    first = mapreduce.reduce_with(pairs, lambda k, batches: [(k, int(next(batches).iloc[0]))], "key string, least long")
    assert {r.key: r.least for r in first.collect()}["hot"] == -1_999_999
    many = mapreduce.reduce_with(pairs.where("key = 'k1'"), lambda k, batches: ((k, int(x)) for b in batches for x in b for _ in range(100)), "key string, x long")
    assert many.count() == 100 * pairs.where("key = 'k1'").count()


def test_segments_by_number_of_values(spark):
    rows = spark.createDataFrame([("a", x) for x in (5, 1 << 60, -7, 5, 12, 80)] + [("b", 3)], "k string, v long")
    got = {(r.k, r.segment): r.o for r in mapreduce.segments(rows, "k", "v", "o", 2).collect()}
    assert got == {("a", 0): [-7, 5], ("a", 1): [5, 12], ("a", 2): [80, 1 << 60], ("b", 0): [3]}
    got = {(r.k, r.segment): r.o for r in mapreduce.segments(rows, "k", "v", "o", 3, distinct=True).collect()}
    assert got == {("a", 0): [-7, 5, 12], ("a", 1): [80, 1 << 60], ("b", 0): [3]}
    assert mapreduce.segments(rows, "k", "v", "o", 9, most=7, distinct=True).where("k = 'a'").first().o == [-7, 5, 12, 80, 1 << 60]


def test_table_functions(spark):
    from quern.functions import tables

    tables.put(spark, "twice", lambda x: [(x, i) for i in range(x or 0)], "x long, i long")
    assert spark.sql("SELECT t.id, f.i FROM range(3) t, LATERAL twice(t.id) f").collect() == [(1, 0), (2, 0), (2, 1)]
    tables.register(spark)
    t = spark.sql("SELECT * FROM VALUES (1, timestamp'2024-01-01 00:00:00'), (1, timestamp'2024-01-01 02:00:00'), (1, timestamp'2024-01-01 00:30:00'), (2, null) v(who, at)")
    got = spark.sql("SELECT * FROM sessions(TABLE({t}), 'who', 'at', 3600)", t=t)
    assert got.columns[0] == "who" and sorted((r.who, r.session, r.n) for r in got.collect()) == [(1, 1, 2), (1, 2, 1), (2, 1, 1)]
    import pytest

    with pytest.raises(Exception, match="sessions needs"):
        spark.sql("SELECT * FROM sessions(TABLE({t}), 'nobody', 'at', 1)", t=t)


def test_rounds_end_early_and_results_are_kept(spark, tmp_path):
    start = spark.createDataFrame([(1,)], "x long")
    out = mapreduce.rounds(start, lambda df, i: df.select((F.col("x") * 2).alias("x")), 10, lambda df: df.first().x >= 8)
    assert out.collect() == [(8,)]
    assert mapreduce.save(out, str(tmp_path / "kept")).collect() == [(8,)]
    assert mapreduce.save(out, table="kept_rows").collect() == [(8,)]


def test_reduce_side_join(spark):
    a = spark.createDataFrame([("k", 1), ("l", 2)], "key string, value int")
    b = spark.createDataFrame([("k", "x"), ("k", "y")], "key string, value string")
    assert sorted(mapreduce.reduce_side_join(a, b).collect()) == [("k", 1, "x"), ("k", 1, "y")]


def log(spark):
    return spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("a", 3, "z")], "key string, seq long, value string")


def test_append_and_last_write(spark):
    assert {r.key: r["values"] for r in kv.append_values(log(spark)).collect()} == {"a": ["x", "z"], "b": ["y"]}
    assert {r.key: r.value for r in kv.last_values(log(spark)).collect()} == {"a": "z", "b": "y"}


def test_get_put_delete(spark):
    t = log(spark)
    assert kv.get(t, "a").first()["values"] == ["x", "z"]
    assert kv.get(t, "nobody").isEmpty()
    more = kv.put(t, spark.createDataFrame([("c", 4, "w")], t.schema))
    gone = spark.createDataFrame([("a",), ("nobody",)], "key string")
    assert sorted(r.key for r in kv.keys(kv.delete(more, gone)).collect()) == ["b", "c"]
    assert sorted(r.value for r in kv.deleted(more, gone).collect()) == ["x", "z"]


def test_namespaces_stay_apart(spark):
    t = spark.createDataFrame([("all", "k", 1, "x"), ("mine", "k", 2, "y")], "gid string, key string, seq long, value string")
    got = {(r.gid, r.key): r["values"] for r in kv.append_values(t, ("gid",)).collect()}
    assert got == {("all", "k"): ["x"], ("mine", "k"): ["y"]}


def test_content_key_is_of_the_json_string(spark):
    import hashlib
    import json

    for v in ("plain", 'q"uote\\ \n', "é"):
        row = spark.createDataFrame([(v,)], "v string").select(kv.content_key(F.col("v")).alias("k")).first()
        assert row.k == hashlib.sha256(json.dumps(v, ensure_ascii=False).encode()).hexdigest()
