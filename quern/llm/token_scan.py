"""Token counts by a separator scan of flat token files.

A token file is a row of little-endian numbers of 2 or 4 bytes and nothing else: no index, no
header.  Each document ends with the end-of-document identifier.

`scan` cuts files into blocks of equal length without looking into them.  Each
block is searched by itself, vectorised, and gives its separators; a prefix
scan over the blocks' summaries (separators before the block, and the place of
the last one) then stitches documents that go over block boundaries, of which
there may be many in one document.  Lengths are differences of absolute places,
so no token is read twice and a hot file is dealt over as many tasks as it has blocks.

Defined results
---------------
* two separators in a row: a document without tokens;
* tokens after the last separator: a last document, marked ``ended`` = false;
* an empty file: no documents; a file whose size isn't a multiple of the width: an error;
* null text: a document without tokens; repeated rows: a document each;
* an empty table: no documents; null doc_id: a document as any other; extra columns are ignored;
* texts are encoded whole, whatever their length;
* identifiers that stand for the separator never come from a text, as texts are
  encoded as ordinary text.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import parts_of, written
from .files import Writer, open_store

#: Fixed value: the splitting pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def vocabulary(path: str = VOCABULARY) -> dict[bytes, int]:
    """Read on the driver from a public vocabulary file; it has one line per identifier."""
    store, name = open_store(path)
    with store.open_input_stream(name) as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f.read().splitlines() if x)}


def write_token_files(documents: DataFrame, folder: str, ranks: dict[bytes, int], separator: int | None = None) -> DataFrame:
    """One flat file per task; lazily gives (file, seq, doc_id): which document each separator ends.

    The rows say nothing of where a document stands.  Write them before they are read twice.
    """
    spark = documents.sparkSession
    end = len(ranks) if separator is None else separator
    shared = spark.sparkContext.broadcast(ranks)  # one vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken
        from pyspark import TaskContext

        batch = next(batches, None)
        if batch is None:
            return
        coder = tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=shared.value, special_tokens={})
        kind = np.dtype("<u2") if max(end, len(shared.value)) < 1 << 16 else np.dtype("<u4")
        name, seq = f"{folder}/part-{TaskContext.get().partitionId():06d}.{kind.itemsize * 8}.tok", 0
        with Writer(name) as out:
            while batch is not None:
                for text in batch.column(1):
                    ids = coder.encode_ordinary((text.as_py() or ""))
                    ids.append(end)
                    out.append(np.array(ids, kind).tobytes())
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(np.arange(seq, seq + n)), batch.column(0)], names=["file", "seq", "doc_id"])
                seq += n
                batch = next(batches, None)

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "file string, seq long, doc_id long")


def width_of(file: str) -> int:
    """Bytes of a token, from the file's name: ``.16.tok`` or ``.32.tok``; 2 where the name doesn't say it."""
    named = re.search(r"\.(16|32)\.tok$", file)
    return int(named.group(1)) // 8 if named else 2


def token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(file, size, width) of the token files in a folder."""
    store, path = open_store(folder)
    scheme = folder[: folder.index(path)] if path in folder else ""
    found = [(scheme + x.path, x.size, width_of(x.path)) for x in store.get_file_info(fs.FileSelector(path, allow_not_found=True)) if x.path.endswith(".tok")]
    return spark.createDataFrame(found, "file string, size long, width int")


SUMMARY = "file string, block long, tokens long, marks array<int>"


def _searched(files: DataFrame, separator: int, block_tokens: int, task_bytes: int) -> DataFrame:
    """The separators of each block, by their place in it."""
    many = F.ceil(F.col("size") / (F.col("width") * block_tokens)).cast("long")
    blocks = files.where("size > 0").select("file", "size", "width", F.explode(F.sequence(F.lit(0).cast("long"), many - 1)).alias("block"))
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("tokens", pa.int64()), ("marks", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                width = row["width"]
                step = block_tokens * width
                if row["size"] % width:
                    raise ValueError(f"{row['file']}: {row['size']} bytes aren't a whole number of tokens")
                store, path = open_store(row["file"])
                with store.open_input_file(path) as f:
                    data = np.frombuffer(f.read_at(min(step, row["size"] - row["block"] * step), row["block"] * step), f"<u{width}")
                marks = np.flatnonzero(data == separator).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([row["file"]]), pa.array([row["block"]]), pa.array([len(data)]), pa.array([marks], pa.list_(pa.int32()))], schema=schema)

    return blocks.repartition(parts_of(files, "size", task_bytes), "file", "block").mapInArrow(run, SUMMARY)


def scan(files: DataFrame, separator: int, width: int | None = None, block_tokens: int = 4 << 20, stretch: int = 1024, task_bytes: int = 32 << 20) -> DataFrame:
    """file, seq, start, n_tokens, ended: every document of the files, in order.

    ``width`` is the bytes of a token where it isn't to be what `token_files` says.  A task reads about ``task_bytes``.

    The prefix scan has two steps, blocks in stretches and stretches in a file, so that its longest row of summaries stays short.
    """
    # Written, as the scan below goes over the summaries more than once and should not read the files again.
    files = files if width is None else files.withColumn("width", F.lit(width))
    found = written(_searched(files, separator, block_tokens, task_bytes), "separators").withColumn("stretch", F.expr(f"block div {stretch}"))
    found = found.withColumns({
        "base": F.col("block") * block_tokens,
        "n": F.size("marks").cast("long"),
    }).withColumn("last", F.when(F.col("n") > 0, F.col("base") + F.element_at("marks", -1)))
    inner = Window.partitionBy("file", "stretch").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = found.groupBy("file", "stretch").agg(F.sum("n").alias("n"), F.max("last").alias("last"), F.max(F.col("base") + F.col("tokens")).alias("end"))
    outer = Window.partitionBy("file").orderBy("stretch")
    before = outer.rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("file", "stretch", "end", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.max("last").over(before).alias("last0"), F.lead("stretch").over(outer).isNull().alias("final"))
    blocks = found.select("file", "stretch", "block", "base", "tokens", "marks", "n", "last", F.coalesce(F.sum("n").over(inner), F.lit(0)).alias("n1"), F.max("last").over(inner).alias("last1"))
    blocks = blocks.join(sums, ["file", "stretch"])
    first, previous = F.col("n0") + F.col("n1"), F.coalesce("last1", "last0", F.lit(-1).cast("long"))
    starts = F.concat(F.array(previous + 1), F.transform("marks", lambda m: F.col("base") + m + 1))
    ended = blocks.withColumn("starts", starts).select(
        "file", first.alias("first"), F.posexplode(F.transform("marks", lambda m, i: F.struct(F.get("starts", i).alias("start"), (F.col("base") + m).alias("end")))).alias("i", "doc")
    )
    ended = ended.select("file", (F.col("first") + F.col("i")).alias("seq"), "doc.start", (F.col("doc.end") - F.col("doc.start")).alias("n_tokens"), F.lit(True).alias("ended"))
    tail = blocks.where(F.col("final") & (F.col("base") + F.col("tokens") == F.col("end")))
    last = F.coalesce("last", previous)
    tail = tail.select("file", (first + F.col("n")).alias("seq"), (last + 1).alias("start"), (F.col("end") - last - 1).alias("n_tokens"), F.lit(False).alias("ended")).where("n_tokens > 0")
    return ended.unionByName(tail)
