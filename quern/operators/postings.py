"""A stored inverted index: posting lists in blocks of differences, in folders by a hash of the word, sorted by word.

A block has at most `BLOCK` ascending ids of one word, as the first id and the steps from each to the next, which Parquet packs into few
bits.  A lookup reads the folder of its word's hash, and in it the row groups whose range of words has it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.session import cut
from quern.sources.stores import remove

from .prefix import with_range

BLOCK, BUCKETS, PER_LIST = 1024, 16, 1_000_000
#: Rows, and bytes of rows, that a task groups at once; ids that a task merges.
HELD_ROWS, HELD_BYTES, IDS_PER_TASK = 1_000_000, 1 << 25, 4_000_000
SCHEMA = "word string, block long, first long, last long, steps array<long>, bucket int"


def _bucket(word: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(buckets)).cast("int")


def build(words: DataFrame, path: str, most: int | None = None, buckets: int = BUCKETS, per_list: int = PER_LIST) -> None:
    """Writes the index of (word, doc_id), each document of a word once or more; ``most`` is a bound on the documents of a word, if one is known.

    Every task writes pieces of lists of the rows it has; pieces are exchanged by their words, and merged as they come, so neither a list
    nor a word's rows are held whole.  What is held of a word is a range of ``per_list`` documents: a column ``_range``, ascending
    with doc_id, says which; it is found here if it isn't given and a word may have more.  A word without any known id has an empty block.
    """
    spark, parts = words.sparkSession, f"{path}.pieces"
    if "_range" not in words.columns:
        words = words.withColumn("_range", F.lit(0)) if most is not None and most <= per_list else with_range(cut(words), "doc_id", per_list)
    rows = words.where("word is not null").select("word", F.col("_range").cast("int").alias("_range"), F.col("doc_id").cast("long").alias("doc_id"))
    rows.mapInArrow(_pieces, "word string, _range int, first long, steps array<long>").write.mode("overwrite").parquet(parts)
    pieces = spark.read.schema("word string, _range int, first long, steps array<long>").parquet(parts)
    total = pieces.agg(F.sum(F.size("steps").cast("long"))).first()[0] or 0
    shards = max(1, -(-total // (buckets * IDS_PER_TASK)))
    place = _bucket(F.col("word"), buckets) * shards + F.pmod(F.hash("word"), F.lit(shards)).cast("int")
    merged = pieces.repartitionById(buckets * shards, place).sortWithinPartitions("word", "_range").mapInArrow(_merged, SCHEMA.rpartition(",")[0])
    merged.withColumn("bucket", _bucket(F.col("word"), buckets)).sortWithinPartitions("bucket", "word", "block").write.partitionBy("bucket").mode("overwrite").parquet(path)
    remove(spark, parts)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, _range, first, steps) of the rows of a task, a bounded number of rows at a time."""
    held, n, size = [], 0, 0
    for b in batches:
        held, n, size = held + [b], n + b.num_rows, size + b.nbytes
        if n >= HELD_ROWS or size >= HELD_BYTES:
            yield from _grouped(pa.Table.from_batches(held))
            held, n, size = [], 0, 0
    if n:
        yield from _grouped(pa.Table.from_batches(held))


def _grouped(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    words = rows.column("word").combine_chunks().dictionary_encode()
    code, range_, known = words.indices.to_numpy(), rows.column("_range").to_numpy(), rows.column("doc_id").is_valid().to_numpy()
    bare = np.setdiff1d(code[~known], code[known])
    code, ids, range_ = _ascending(code[known], rows.column("doc_id").drop_null().to_numpy(), range_[known])
    at, steps, _ = _blocks((code[1:] != code[:-1]) | (range_[1:] != range_[:-1]), ids)
    found = pa.table({"word": words.dictionary.take(pa.array(code[at])), "_range": range_[at], "first": ids[at], "steps": steps})
    if len(bare):
        none = pa.table({"word": words.dictionary.take(pa.array(bare)), "_range": np.full(len(bare), -1, np.int32), "first": pa.nulls(len(bare), pa.int64()), "steps": pa.array([[]] * len(bare), pa.list_(pa.int64()))})
        found = pa.concat_tables([found, none])
    yield from found.to_batches(BLOCK)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Full blocks of pieces that are sorted by word and range; the last range read is held until the next one begins."""
    held, n, open_ = [], 0, None
    for b in batches:
        held, n = held + [b], n + b.num_rows + len(b.column("steps").flatten())
        if n >= HELD_ROWS:
            rows = pa.Table.from_batches(held)
            of_last = pc.and_(pc.equal(rows.column("word"), rows.column("word")[-1]), pc.equal(rows.column("_range"), rows.column("_range")[-1]))
            done = rows.num_rows - pc.sum(of_last).as_py()
            if done:
                found, open_ = _packed(rows.slice(0, done), open_, False)
                yield from found.to_batches(BLOCK)
                rest = rows.slice(done)
                held, n = rest.to_batches(), rest.num_rows + pc.sum(pc.list_value_length(rest.column("steps"))).as_py()
    if held:
        yield from _packed(pa.Table.from_batches(held), open_, True)[0].to_batches(BLOCK)


def _packed(rows: pa.Table, open_: tuple | None, whole: bool) -> tuple[pa.Table, tuple | None]:
    """Blocks of these pieces, and (word, number of its blocks so far, ids that don't fill one) of the last word if they aren't the ``whole`` rest."""
    word, before, kept = open_ or (rows.column("word")[0].as_py(), 0, np.empty(0, np.int64))
    words = pa.chunked_array([pa.array([word], pa.string()), *rows.column("word").chunks]).combine_chunks().dictionary_encode()
    ids, lengths = _decoded(rows)
    code, ids = np.repeat(words.indices.to_numpy(), np.append(len(kept), lengths)), np.append(kept, ids)
    code, ids, _ = _ascending(code, ids, code)
    last, open_ = len(words.dictionary) - 1, None
    if not whole:
        n = int((code == last).sum())
        end = len(ids) - n % BLOCK
        open_ = words.dictionary[last].as_py(), n // BLOCK + (0 if last else before), ids[end:].copy()
        code, ids = code[:end], ids[:end]
    at, steps, number = _blocks(code[1:] != code[:-1], ids)
    ends = np.append(at[1:], len(ids))[: len(at)] - 1
    found = pa.table({"word": words.dictionary.take(pa.array(code[at])), "block": number + np.where(code[at] == 0, before, 0), "first": ids[at], "last": ids[ends], "steps": steps})
    bare = np.setdiff1d(np.arange(last + whole), code)
    bare = bare[(bare > 0) | (before == 0)]
    if len(bare):
        nulls = pa.nulls(len(bare), pa.int64())
        none = pa.table({"word": words.dictionary.take(pa.array(bare)), "block": np.zeros(len(bare), np.int64), "first": nulls, "last": nulls, "steps": pa.array([[]] * len(bare), pa.list_(pa.int64()))})
        found = pa.concat_tables([found, none])
    return found, open_


def _ascending(code: np.ndarray, ids: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted by code and id, each pair once."""
    order = np.lexsort((ids, code))
    code, ids = code[order], ids[order]
    new = np.ones(len(ids), bool)
    new[1:] = (code[1:] != code[:-1]) | (ids[1:] != ids[:-1])
    return code[new], ids[new], other[order[new]]


def _blocks(changes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, pa.ListArray, np.ndarray]:
    """Lists of ascending ids, one ending at each of ``changes``, in blocks: where each block begins, its steps, its number in its list."""
    here = np.arange(len(ids))
    starts = np.zeros(len(ids), np.int64)
    starts[1:][changes] = here[1:][changes]
    inside = here - np.maximum.accumulate(starts) if len(ids) else here
    at = np.flatnonzero(inside % BLOCK == 0)
    steps = np.diff(ids, prepend=ids[:1])
    steps[at] = 0
    return at, pa.ListArray.from_arrays(pa.array(np.append(at, len(ids)), pa.int32()), pa.array(steps)), inside[at] // BLOCK


def _decoded(rows: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all rows one after another, and how many each has: one sum over all steps, less what it had before each list."""
    column = rows.column("steps")
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    sums = np.cumsum(lists.flatten().to_numpy(zero_copy_only=False))
    some = lengths > 0
    starts = (np.cumsum(lengths) - lengths)[some]
    first = pc.fill_null(rows.column("first"), 0).to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else pc.fill_null(rows.column("first"), 0).to_numpy()
    return sums + np.repeat(first[some] - sums[starts], lengths[some]), lengths


def blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def lists(rows: DataFrame) -> DataFrame:
    """(word, ids) of blocks, a row for each."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                found, lengths = _decoded(part)
                yield pa.RecordBatch.from_arrays([part.column("word"), pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)), pa.int32()), pa.array(found))], ["word", "ids"])

    return rows.select("word", "first", "steps").mapInArrow(run, "word string, ids array<long>")


def ids(rows: DataFrame) -> DataFrame:
    """(word, doc_id) of blocks."""
    return lists(rows).select("word", F.explode("ids").alias("doc_id"))


def lookup(spark: SparkSession, path: str, word: str, buckets: int = BUCKETS) -> DataFrame:
    """(word, doc_id) of one word; the bucket is a constant, so other folders aren't read."""
    bucket = spark.range(1).select(_bucket(F.lit(word), buckets)).first()[0]
    return ids(blocks(spark, path).where((F.col("bucket") == bucket) & (F.col("word") == word)))
