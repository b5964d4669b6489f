"""Collections of sorted runs, tables laid out by owner, and the index that notices other data."""

import shutil

import pytest
from pyspark.sql import functions as F
from quern.sources import buckets
from quern.sources.runs import RunStore

SCHEMA = "key string, seq long, value double"


def writes(spark, i):
    """Write i touches every third of 30 keys."""
    return spark.createDataFrame([(f"k{j:02d}", i, float(100 * i + j)) for j in range(30) if (i + j) % 3 == 0], SCHEMA)


def test_fifty_appends_merges_and_a_reader_in_between(spark, tmp_path):
    store = RunStore.create(spark, str(tmp_path / "c"), SCHEMA, buckets=2, fanout=4)
    want, between = {}, None
    for i in range(50):
        store.append(writes(spark, i))
        want |= {r.key: r.value for r in writes(spark, i).collect()}
        if i == 20:
            between, then, version = store.read(), dict(want), store.state()["version"]
    state = store.state()
    # Every level has fewer runs than make a merge; each append added one run.
    assert max([r["level"] for r in state["runs"]]) >= 2 and all(sum(r["level"] == n for r in state["runs"]) < 4 for n in range(4))
    assert {r.key: r.value for r in store.read().collect()} == want
    assert {r.key: r.value for r in between.collect()} == then == {r.key: r.value for r in store.read(version).collect()}
    # Another session finds it by its path alone.
    other = RunStore(spark.newSession(), str(tmp_path / "c"))
    assert [r.value for r in other.get("k05").collect()] == [want["k05"]] and other.get("nobody").count() == 0
    store.vacuum(keep=1)
    assert store.versions() == [state["version"]] and {r.key: r.value for r in store.read().collect()} == want


def test_a_lookup_reads_one_bucket(spark, tmp_path):
    store = RunStore.create(spark, str(tmp_path / "c"), SCHEMA, buckets=4)
    store.append(writes(spark, 0))
    read = {f.split("_bucket=")[1].split("/")[0] for f in store.get("k03").inputFiles()}
    assert len(read) > 1  # of the files of the table
    plan = store.get("k03")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_bucket" in plan and "EqualTo(key,k03)" in plan.split("PushedFilters")[1]


def test_deletes_late_writes_and_nulls(spark, tmp_path):
    store = RunStore.create(spark, str(tmp_path / "c"), SCHEMA, buckets=2, fanout=3)
    store.append(spark.createDataFrame([("a", 5, 1.0), ("b", 5, 2.0), ("c", None, 3.0), (None, 1, 4.0), ("d", 1, None)], SCHEMA))
    store.append(spark.createDataFrame([("a", 4, 9.0)], SCHEMA))  # late: an older write changes nothing
    store.delete(spark.createDataFrame([("b",), ("x",)], "key string"), 6)
    assert {r.key: r.value for r in store.read().collect()} == {"a": 1.0, "c": 3.0, "d": None}
    store.append(spark.createDataFrame([("b", 7, 8.0)], SCHEMA))
    assert {r.key: r.value for r in store.merge(all_levels=True).read().collect()} == {"a": 1.0, "b": 8.0, "c": 3.0, "d": None}
    assert len(store.state()["runs"]) == 1
    assert RunStore.create(spark, str(tmp_path / "d"), SCHEMA).read().count() == 0
    with pytest.raises(FileNotFoundError):
        RunStore(spark, str(tmp_path / "none")).read()


def test_two_writers_both_get_in(spark, tmp_path):
    """A writer whose number was taken meanwhile commits on top of the other."""
    one = RunStore.create(spark, str(tmp_path / "c"), SCHEMA, buckets=2)
    two = RunStore(spark, str(tmp_path / "c"))
    state = one.state()
    run = one._run(writes(spark, 1).withColumn("_gone", F.lit(False)), 0)
    two.append(writes(spark, 2))
    assert not one._publish(state["version"] + 1, state | {"runs": [run]})
    assert one._commit([], [run]) and len(two.state()["runs"]) == 2
    assert not one._commit([{"name": "runs/gone"}], [])


def files_read(df):
    """How many files the tasks of a scan are to read."""
    tasks = df._jdf.queryExecution().executedPlan().collectLeaves().head().inputRDD().partitions()
    return len({f.filePath().toString() for t in tasks for f in t.files()})


def test_layout_by_owner(spark, tmp_path):
    rows = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("x"))
    a = buckets.lay_out(rows, "owner_a", str(tmp_path / "a"), "k", 8)
    b = buckets.lay_out(rows.where("k % 3 = 0").withColumnRenamed("x", "y"), "owner_b", str(tmp_path / "b"), "k", 8)
    joined = a.hint("merge").join(b.hint("merge"), "k").groupBy("k").agg(F.sum("x").alias("x"))
    assert joined.count() == 334 and "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    one = buckets.get(a, "k", 77)
    assert [tuple(r) for r in one.collect()] == [(77, 154)] and files_read(buckets.get(a, "k", 77)) == 1 and files_read(a) == 8
    again = buckets.open_table(spark.newSession(), "owner_again", str(tmp_path / "a"), "k long, x long", "k", 8)
    assert again.count() == 1000 and files_read(buckets.get(again, "k", 3)) == 1
    new = buckets.put(a, "owner_c", str(tmp_path / "c"), spark.createDataFrame([(5, -1), (5000, -2)], "k long, x long"), "k", 8)
    assert new.count() == 1001 and sorted(r.x for r in new.where("k in (5, 5000)").collect()) == [-2, -1]


def test_the_index_notices_other_documents(spark, sf, tmp_path):
    from quern.plans import catalogue

    for t in ("documents", "embeddings", "benchmark"):
        source = spark.read.parquet(f"{sf}/{t}.parquet")
        (source.limit(40) if t == "documents" else source).write.parquet(str(tmp_path / f"{t}.parquet"))
    folder = str(tmp_path)
    first = {r.word for r in catalogue.lexicon_load(spark, folder).collect()}
    again = catalogue._lexicon(spark.newSession(), folder)
    assert {r.word for r in again.collect()} == first and len(first) > 3
    shutil.rmtree(tmp_path / "documents.parquet")
    spark.createDataFrame([(1, "x\nzebra quagga"), (2, "y\nzebra okapi")], "doc_id long, text string").withColumn("source", F.lit("s")).write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.word for r in catalogue.lexicon_load(spark, folder).collect()} >= {"zebra", "quagga", "okapi"}
    assert not first & {"zebra", "quagga", "okapi"} and len({r.word for r in catalogue.lexicon_load(spark, folder).collect()}) < 8
    assert {r.doc_id for r in catalogue.search_text(spark, folder).collect()} <= {1, 2}
    catalogue.drop_index(spark, folder)
    assert {r.word for r in catalogue.lexicon_load(spark, folder).collect()} >= {"zebra"}
