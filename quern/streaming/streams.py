"""Structured Streaming: micro-batch upserts, stateful de-duplication, running statistics."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import tokens
from quern.operators import tfidf
from quern.operators.vector_store import upsert
from quern.session import cut, shared_folder
from quern.sources.runs import RunStore
from quern.sources.stores import folder_names, remove


def stream_table(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """A table's files as a stream; the schema comes from the files that are there.

    A table may be one file: file streams take folders, so its folder is watched for that name.
    """
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isFile():
        return reader.option("pathGlobFilter", place.getName()).parquet(place.getParent().toString())
    return reader.parquet(path)


def run_to_end(stream: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str | None = None, mode: str = "append") -> None:
    """Runs a stream over all that is available, batch by batch, and waits."""
    place = checkpoint or f"{shared_folder(stream.sparkSession)}/stream/{uuid.uuid4().hex}"
    query = stream.writeStream.outputMode(mode).foreachBatch(batch).option("checkpointLocation", place).trigger(availableNow=True).start()
    query.awaitTermination()


def _finished(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the tables ``n=...`` in a folder that were written to their end."""
    names = [x for x in folder_names(spark, folder) if x.startswith("n=")]
    return sorted(int(x[2:]) for x in names if "_SUCCESS" in folder_names(spark, f"{folder}/{x}"))


def read_collection(spark: SparkSession, root: str) -> DataFrame | None:
    """(doc_id, embedding), the latest of each id: the last flush, and the writes that wait for the next one; None if nothing was written."""
    flushed = _finished(spark, f"{root}/flushed")
    last = flushed[-1] if flushed else -1
    waiting = [f"{root}/buffer/n={i}" for i in _finished(spark, f"{root}/buffer") if i > last]
    base = spark.read.parquet(f"{root}/flushed/n={last}") if flushed else None
    if not waiting:
        return base
    writes = spark.read.parquet(*waiting)
    return upsert(writes.select("doc_id", "embedding").limit(0) if base is None else base, writes)


def upsert_stream(stream: DataFrame, folder: str | None = None, checkpoint: str | None = None, flush_at: int = 3000) -> DataFrame:
    """Vectors (doc_id, embedding, seq) into a collection that keeps the latest of each id.

    A batch is written to a buffer under its number, so a batch that is run again writes the same folder once more.
    When ``flush_at`` rows or more wait there, and at least as many as the collection has, they are merged
    into its next version and older files go; so a row is rewritten about as often as the collection doubles.
    All that a restart needs to know is in the folder and the checkpoint.
    """
    spark = stream.sparkSession
    root = folder or f"{shared_folder(spark)}/collection/{uuid.uuid4().hex}"

    def batch(rows: DataFrame, i: int) -> None:
        rows.select("doc_id", "embedding", "seq").write.mode("overwrite").parquet(f"{root}/buffer/n={i}")
        flushed = [n for n in _finished(spark, f"{root}/flushed") if n < i]
        last = flushed[-1] if flushed else -1
        waiting = [n for n in _finished(spark, f"{root}/buffer") if last < n <= i]
        many = spark.read.parquet(*[f"{root}/buffer/n={n}" for n in waiting]).count()
        if many < flush_at or flushed and many < spark.read.parquet(f"{root}/flushed/n={last}").count():
            return
        merged = read_collection(spark, root)
        if i not in _finished(spark, f"{root}/flushed"):
            merged.write.mode("overwrite").parquet(f"{root}/flushed/n={i}")
        for n in waiting:
            remove(spark, f"{root}/buffer/n={n}")
        for n in flushed:
            remove(spark, f"{root}/flushed/n={n}")

    run_to_end(stream, batch, checkpoint)
    found = read_collection(spark, root)
    return spark.createDataFrame([], stream.select("doc_id", "embedding").schema) if found is None else found


def collected(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All rows that a stream gives, as a table; in update mode a row for each change.  No batch, no rows."""
    spark = stream.sparkSession
    root = f"{shared_folder(spark)}/rows/{uuid.uuid4().hex}"
    run_to_end(stream, lambda rows, i: rows.withColumn("batch", F.lit(i)).write.mode("overwrite").parquet(f"{root}/b={i}"), mode=mode)
    if not folder_names(spark, root):
        return spark.createDataFrame([], stream.schema).withColumn("batch", F.lit(0))
    return spark.read.parquet(root).drop("b")


def first_seen(stream: DataFrame, key: str, time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Each key once; with an event time, repeats are known for so long and the state stays bounded."""
    if time is None:
        return stream.dropDuplicates([key])
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def running_doc_freq(stream: DataFrame) -> DataFrame:
    """(word, df) as documents come in; a word counts once per document."""
    return stream.select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("word")).groupBy("word").agg(F.count("*").alias("df"))


def into_runs(stream: DataFrame, store: RunStore, checkpoint: str | None = None) -> RunStore:
    """Appends a stream to a collection of sorted runs, a run a batch.

    A batch that is run again after a failure appends the same rows with the same ``seq``, which changes nothing that is read.
    """
    run_to_end(stream, lambda rows, i: store.append(rows), checkpoint)
    return store


def first_seen_for(stream: DataFrame, key: str, seconds: float) -> DataFrame:
    """(key): a key when it is first seen, and again when it comes back later than so many seconds after that; older keys leave the state.

    For keys without an event time.  Times run out in every batch, so such a stream is run by a clock or once; it never has all it waits for.
    """
    millis = int(seconds * 1000)

    def see(name, batches, state):
        for _ in batches:
            pass
        if state.hasTimedOut:
            state.remove()
        elif not state.exists:
            state.update((True,))
            state.setTimeoutDuration(millis)
            yield pd.DataFrame({key: [name[0]]})

    kind = dict(stream.dtypes)[key]
    return stream.select(key).where(F.col(key).isNotNull()).groupBy(key).applyInPandasWithState(see, f"{key} {kind}", "seen boolean", "append", "ProcessingTimeTimeout")


def online_statistics(stream: DataFrame, stop: DataFrame, folder: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """(doc_id, word, n, size, n_docs, df): each word of each document with how many documents had come by then, and how many of them with the word.

    Documents (doc_id, text) are taken batch by batch, by doc_id inside a batch.  What a batch has to know of those before is a count for
    each word, in a table with the batch's number; a batch that is run again reads the table before it and writes its own once more.
    """
    spark = stream.sparkSession
    root = folder or f"{shared_folder(spark)}/online/{uuid.uuid4().hex}"
    schema = "word string, df long"

    def batch(rows: DataFrame, i: int) -> None:
        rows = cut(rows.select("doc_id", "text"))
        done = [n for n in _finished(spark, f"{root}/counts") if n < i]
        counts = spark.read.schema(schema).parquet(f"{root}/counts/n={done[-1]}") if done else spark.createDataFrame([], schema)
        earlier = counts.where("word = ''").agg(F.coalesce(F.sum("df"), F.lit(0)).alias("earlier"))  # one row
        seen = tfidf.online(rows, stop, counts.withColumnRenamed("df", "known")).join(F.broadcast(earlier))
        out = seen.select("doc_id", "word", "n", "size", (F.col("n_docs") + F.col("earlier")).alias("n_docs"), "df")
        out.write.mode("overwrite").parquet(f"{root}/seen/n={i}")
        # No word is empty: that row counts documents.
        documents = rows.agg(F.count_distinct("doc_id").alias("df")).select(F.lit("").alias("word"), "df")
        new = tfidf.doc_freq(spark.read.schema(out.schema).parquet(f"{root}/seen/n={i}")).unionByName(documents)
        counts.unionByName(new).groupBy("word").agg(F.sum("df").alias("df")).write.mode("overwrite").parquet(f"{root}/counts/n={i}")
        for n in done[:-1]:
            remove(spark, f"{root}/counts/n={n}")

    run_to_end(stream.select("doc_id", "text"), batch, checkpoint)
    found = [f"{root}/seen/n={n}" for n in _finished(spark, f"{root}/seen")]
    return spark.read.parquet(*found) if found else spark.createDataFrame([], "doc_id long, word string, n long, size long, n_docs long, df long")


def sizes_of_batches(query) -> list[dict]:
    """What a stream's own progress reports say of each batch: rows, seconds and rows of state; nothing is counted again."""
    return [
        {"batch": p["batchId"], "rows": p["numInputRows"], "seconds": p["durationMs"].get("triggerExecution", 0) / 1000, "state_rows": sum(s["numRowsTotal"] for s in p["stateOperators"])}
        for p in query.recentProgress
    ]
