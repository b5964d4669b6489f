"""Readers: typed tables, word-vector text files, stop words, node lists and key-value logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: English function words that carry no meaning of their own.
STOP_WORDS = (
    "a an and are as at be but by for from had has have he her his i if in into is it its me my no nor not of on or our "
    "she so than that the their them then there these they this those to was we were what when which who will with you your"
).split()


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """A Parquet table of a folder; only the named columns are read."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many parts as there are cores, if it has fewer: a small table is often one file and so one task.

    A table of many files is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def stop_words(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(word): the lines of a text file, or the list above."""
    if path:
        return spark.read.text(path).select(F.trim("value").alias("word")).where("word <> ''").distinct()
    return spark.range(1).select(F.explode(F.array(*map(F.lit, STOP_WORDS))).alias("word"))


def word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(word, vec) from a folder of ``word x1 x2 ...`` lines; the first definition by file and line wins."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    parts = F.split(F.trim("value"), " +")
    rows = lines.where(F.trim("value") != "").select(
        F.element_at(parts, 1).alias("word"),
        F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: x.try_cast("float")).alias("vec"),
        F.struct("file", "block", "line").alias("place"),
    )
    return rows.groupBy("word").agg(F.min_by("vec", "place").alias("vec"))


def node_list(spark: SparkSession, path: str) -> DataFrame:
    """(ip) from a text file with one address a line."""
    return spark.read.text(path).select(F.trim("value").alias("ip")).where("ip <> ''")


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """(key, seq, value): a folder of text files, one per key, one value per line; blank lines are no values."""
    rows = spark.read.text(path).select("value", F.regexp_extract("_metadata.file_name", r"^(.*?)(?:\.[^.]*)?$", 1).alias("key"), F.monotonically_increasing_id().alias("seq"))
    return rows.where(F.trim("value") != "").select("key", "seq", "value")
