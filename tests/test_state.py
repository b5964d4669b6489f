"""Streams with state: what they know, and that they forget."""

import time

from pyspark.sql import functions as F
from quern.operators import tfidf
from quern.sources.tables import stop_words
from quern.streaming import streams


def test_running_statistics_over_many_batches(spark, tmp_path):
    """Five batches of three documents, in runs that go on from the checkpoint."""
    docs = [(i, " ".join(f"q{chr(97 + (i * j) % 7)}" for j in range(i % 5 + 1)) if i % 6 else None) for i in range(15)]
    for n in range(5):
        spark.createDataFrame(docs[3 * n : 3 * n + 3], "doc_id long, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "docs"))
        stream = streams.stream_table(spark, str(tmp_path / "docs"))
        seen = streams.online_statistics(stream, stop_words(spark), str(tmp_path / "s"), str(tmp_path / "c"))
    whole = spark.createDataFrame(docs, "doc_id long, text string")
    want = tfidf.online_idf(tfidf.term_freq(tfidf.words(whole)), whole)
    rows = lambda df: sorted(tuple(r) for r in df.select("doc_id", "word", "n_docs", "df").collect())
    assert rows(seen) == rows(want) and seen.count() > 15
    # The state is a count for each word, of the last two batches.
    assert len(list((tmp_path / "s" / "counts").iterdir())) <= 2 + 1
    assert spark.read.parquet(str(tmp_path / "s" / "counts" / "n=4")).count() == 8


def test_known_for_a_time_only(spark, tmp_path):
    got, held = [], []

    def run(keys):
        spark.createDataFrame([(k,) for k in keys], "key string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = streams.stream_table(spark, str(tmp_path / "in"))
        q = streams.first_seen_for(stream, "key", 60.0).writeStream.foreachBatch(lambda rows, i: got.append(sorted(r.key for r in rows.collect()))).option("checkpointLocation", str(tmp_path / "c")).trigger(once=True).start()
        q.awaitTermination(60)
        held.extend(streams.sizes_of_batches(q))

    run(["a", "b", "a", None])
    run(["a", "c"])
    assert [x for x in got if x] == [["a", "b"], ["c"]] and held[-1]["state_rows"] == 3 and sum(b["rows"] for b in held) >= 6


def test_event_time_bounds_the_state(spark, tmp_path):
    """After the watermark has passed, a key's row leaves the state."""
    rows = [[("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:10:00")], [("b", "2024-01-02 00:00:00")], [("c", "2024-01-03 00:00:00"), ("b", "2024-01-03 00:00:00")]]
    sizes = []
    for n, part in enumerate(rows):
        spark.createDataFrame(part, "key string, t string").withColumn("ts", F.col("t").cast("timestamp")).drop("t").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = streams.stream_table(spark, str(tmp_path / "in"))
        q = streams.first_seen(stream, "key", "ts", "1 hour").writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
        sizes.append(streams.sizes_of_batches(q)[-1]["state_rows"])
    assert sizes[-1] <= 3 and sizes[0] == 1


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    from quern.sources.runs import RunStore

    store = RunStore.create(spark, str(tmp_path / "store"), "key string, seq long, value long", buckets=2)
    for n in range(3):
        spark.createDataFrame([("a", n, n), (f"k{n}", n, 10 * n)], "key string, seq long, value long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = streams.stream_table(spark, str(tmp_path / "in"))
    streams.into_runs(stream, store, str(tmp_path / "c"))
    want = {"a": 2, "k0": 0, "k1": 10, "k2": 20}
    assert {r.key: r.value for r in store.read().collect()} == want
    # The checkpoint is lost: everything comes again.
    streams.into_runs(stream, store, str(tmp_path / "d"))
    assert {r.key: r.value for r in store.read().collect()} == want
