"""Mixing sources to target weights, by blocks of equal length.

1. The words of a source's documents, in one order, are one long sequence, cut
   into blocks of ``block`` words (the last one may be shorter).  Places in the
   sequence come from a prefix scan in two steps, over many buckets per source,
   so a source with a third of all rows isn't in one task.
2. Targets become whole numbers of blocks, the slots of the output, dealt over
   output shards.  Each shard's counts by source are multinomial draws under
   the condition that all shards together give those numbers, which makes them
   multivariate hypergeometric; they are drawn down a binary tree of shards,
   each node with its own seed, so a shard computes its counts and its first
   slot of every source by itself.
3. Slot number q of a source is the block at index p(q mod B) of its B blocks;
   p is a Feistel permutation keyed by source and pass q div B.  Each
   pass takes every block once, so no block is taken more often than there are
   passes, and no document more than ``most`` times its size.
4. Slots and blocks are joined by (source, index).

Reruns give the same mix: it depends on the rows and the seed alone.

Defined results
---------------
* null text: no words; null source: a source of its own, last in order;
* equal rows: each its own; equal doc_ids in one order by size, then by a hash of the text;
* null doc_id: as any other value; texts are cut whole, whatever their length;
* an empty table, or one without words: nothing is taken;
* extra columns are ignored by `taken`, and `mixed_blocks` never returns them.
What the driver gathers is one row for each distinct source.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD

WEIGHTS = (5.0, 2.0, 1.0)


def water_fill(sizes: np.ndarray, weights: np.ndarray, most: float) -> np.ndarray:
    """Shares of all sizes by weight; those above ``most`` times their size stop there and the rest is shared again."""
    targets, total = np.zeros(len(sizes)), float(sizes.sum())
    free = np.ones(len(sizes), bool)
    while free.any():
        left = total - most * float(sizes[~free].sum())
        share = left * weights / weights[free].sum()
        over = free & (share > most * sizes)
        if not over.any():
            targets[free] = share[free]
            break
        free &= ~over
    targets[~free] = most * sizes[~free]
    return targets


@dataclass(frozen=True)
class Plan:
    """What is known of each source, in order: key, size in words, target, blocks, slots."""

    keys: list[str]
    sizes: np.ndarray
    targets: np.ndarray
    blocks: np.ndarray
    slots: np.ndarray
    block: int
    seed: int
    shard_slots: int

    @property
    def shards(self) -> int:
        return int(-(-int(self.slots.sum()) // self.shard_slots))


def source_key(source: Column) -> Column:
    """Sorts as the sources do by code point, null last; never null."""
    return F.when(source.isNull(), "1").otherwise(F.concat(F.lit("0"), source))


def make_plan(sized: DataFrame, weights=WEIGHTS, most: float = 3.0, block: int = 64, seed: int = 17, shard_slots: int = 4096) -> Plan:
    """``sized``: rows (source_key, size)."""
    rows = sorted((r[0], int(r[1])) for r in sized.groupBy("source_key").agg(F.sum("size")).collect())
    sizes = np.array([r[1] for r in rows], np.int64)
    w = np.resize(np.array(weights, float), len(rows))
    targets = water_fill(sizes, w, most) if sizes.sum() else np.zeros(len(rows))
    blocks = -(-sizes // block)
    passes = np.divide(targets, sizes, out=np.zeros(len(rows)), where=sizes > 0)
    slots = np.minimum(np.rint(passes * blocks), np.floor(most) * blocks).astype(np.int64)
    return Plan([r[0] for r in rows], sizes, targets, blocks, slots, block, seed, shard_slots)


# ------------------------------------------------------------------ slots


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of x."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def permuted(i: np.ndarray, n: int, key: np.ndarray, rounds: int = 4) -> np.ndarray:
    """A permutation of 0..n-1 for each key: a Feistel network over the next power of four, walked until it is inside."""
    half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, at = i.astype(np.uint64), np.arange(len(i))
    key = key.astype(np.uint64)
    while len(at):
        left, right, k = out[at] >> half, out[at] & mask, key[at]
        for r in range(rounds):
            left, right = right, left ^ (_mixed(right + k + np.uint64((r + 1) * 0x9E3779B97F4A7C15 % 2**64)) & mask)
        out[at] = (left << half) | right
        at = at[out[at] >= np.uint64(n)]
    return out.astype(np.int64)


def drawn(counts: np.ndarray, want: int, rng: np.random.Generator) -> np.ndarray:
    """Counts by colour of ``want`` items taken at random, all sets alike, from ``counts`` of each: any number of items.

    Every item is taken with probability want / all, which is a binomial draw for each colour; the
    difference to ``want``, about its root, is put right by drawing so many items more, or by putting
    so many of the taken ones back, in the same way.
    """
    total = int(counts.sum())
    if want > total - want:
        return counts - drawn(counts, total - want, rng)
    if want <= 32:
        out, left = np.zeros_like(counts), counts.copy()
        for _ in range(want):
            i = int(np.searchsorted(np.cumsum(left), rng.integers(int(left.sum())), side="right"))
            out[i] += 1
            left[i] -= 1
        return out
    out = rng.binomial(counts, want / total)
    gap = want - int(out.sum())
    return out + drawn(counts - out, gap, rng) if gap > 0 else out - drawn(out, -gap, rng) if gap else out


def shard_counts(slots: np.ndarray, shard: int, shards: int, shard_slots: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts by source of one shard, and how many slots of each source earlier shards have."""
    low, high, counts, base = 0, shards, slots.copy(), np.zeros_like(slots)
    while high - low > 1:
        mid = (low + high) // 2
        left = drawn(counts, (mid - low) * shard_slots, np.random.default_rng([seed, low, high]))
        if shard < mid:
            high, counts = mid, left
        else:
            low, base, counts = mid, base + left, counts - left
    return counts, base


def slots(spark: SparkSession, plan: Plan) -> DataFrame:
    """Every slot of the mix: shard, slot, source_index, block."""
    schema = pa.schema([("shard", pa.int64()), ("slot", pa.int32()), ("source_index", pa.int32()), ("block", pa.int64())])
    if not plan.shards:
        return spark.createDataFrame([], "shard long, slot int, source_index int, block long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                counts, base = shard_counts(plan.slots, shard, plan.shards, plan.shard_slots, plan.seed)
                index, block = [], []
                for s in np.flatnonzero(counts):
                    q = base[s] + np.arange(counts[s])
                    key = _mixed((q // plan.blocks[s]).astype(np.uint64) + _mixed(np.array([plan.seed * 1_000_003 + int(s)], np.uint64)))
                    block.append(permuted(q % plan.blocks[s], int(plan.blocks[s]), key))
                    index.append(np.full(len(q), s, np.int32))
                order = np.random.default_rng([plan.seed, shard, plan.shards, 1]).permutation(int(counts.sum())).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(order), shard, np.int64)), pa.array(order), pa.array(np.concatenate(index)), pa.array(np.concatenate(block))], schema=schema)

    return spark.range(plan.shards).mapInArrow(run, "shard long, slot int, source_index int, block long")


# ------------------------------------------------------------------ blocks


def bucket(buckets: int) -> Column:
    """By doc_id and text, as many rows may have one id, or none."""
    return F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(buckets))


def with_places(docs: DataFrame, plan: Plan, bucket_words: int = 1_000_000) -> DataFrame:
    """Adds source_index, source_size, target and start, the number of words before the document in its source.

    ``docs``: source_key, doc_id, text_key, size and whatever else is to be kept.  A source is cut into
    buckets of about ``bucket_words`` words, so a task sorts as much of the largest source as of any other.
    Equal rows are told apart by nothing, so it doesn't matter which comes first.
    """
    buckets = max(64, -(-int(plan.sizes.max(initial=0)) // bucket_words))
    rows = docs.withColumn("bucket", bucket(buckets))
    sums = rows.groupBy("source_key", "bucket").agg(F.sum("size").alias("words"))
    w = Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("source_key", "bucket", F.coalesce(F.sum("words").over(w), F.lit(0)).alias("base"))
    known = docs.sparkSession.createDataFrame(
        [(k, i, int(s), float(t)) for i, (k, s, t) in enumerate(zip(plan.keys, plan.sizes, plan.targets, strict=True))],
        "source_key string, source_index int, source_size long, target double",
    )
    bases = bases.join(known, "source_key")
    inner = Window.partitionBy("source_key", "bucket").orderBy("doc_id", "size", "text_key").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("upto", F.sum("size").over(inner))
    return rows.join(bases, ["source_key", "bucket"]).withColumn("start", F.col("base") + F.col("upto") - F.col("size")).drop("bucket", "base", "upto", "text_key")


def _span(block: int) -> tuple[Column, Column]:
    return F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}")


def _words_in(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def sized(documents: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return documents.select(source_key(F.col("source")).alias("source_key"), "doc_id", F.xxhash64(text).alias("text_key"), _words_in(text).alias("size"))


def taken(documents: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, size, source_size, target (its source's) and taken (words in the mix, repeats counted)."""
    spark = documents.sparkSession
    sizes = sized(documents)
    plan = make_plan(sizes, **options)
    docs = with_places(sizes, plan)
    first, last = _span(plan.block)
    parts = docs.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(first, last))))
    words = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * plan.block) - F.greatest(F.col("start"), F.col("block") * plan.block)
    parts = parts.withColumn("words", words)
    times = slots(spark, plan).groupBy("source_index", "block").agg(F.count("*").alias("times"))
    # Both sides grow with the input, whatever the planner thinks of rows that Python makes.
    joined = parts.join(times.hint("merge"), ["source_index", "block"], "left")
    # (source, start) tells rows with words apart; those without are as many as they were, in `zero`.
    got = joined.groupBy("doc_id", "source_index", "start", "size", "source_size", "target").agg(
        F.coalesce(F.sum(F.col("words") * F.coalesce("times", F.lit(0))), F.lit(0)).alias("taken"), F.count("*").alias("rows")
    )
    again = F.when(F.col("size") > 0, F.lit(1)).otherwise(F.col("rows")).cast("int")
    return got.withColumn("_again", F.explode(F.array_repeat(F.lit(0), again))).select("doc_id", "size", "source_size", "target", "taken")


def mixed_blocks(documents: DataFrame, **options) -> DataFrame:
    """The mix itself: shard, slot, source, block, doc_ids (of its pieces), text.

    The words of a block are joined by single spaces.
    """
    spark = documents.sparkSession
    plan = make_plan(sized(documents), **options)
    text = F.coalesce("text", F.lit(""))
    rows = documents.select(source_key(F.col("source")).alias("source_key"), "doc_id", "source", text.alias("text"), F.xxhash64(text).alias("text_key"), _words_in(text).alias("size"))
    # Words are split after the exchange: an array of them is larger than their text.
    docs = with_places(rows.where("size > 0"), plan).withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).drop("text")
    first, last = _span(plan.block)

    def piece(b: Column) -> Column:
        low = F.greatest(b * plan.block - F.col("start"), F.lit(0))
        n = F.least((b + 1) * plan.block - F.col("start"), F.col("size")) - low
        return F.struct(b.alias("block"), F.array_join(F.slice("words", (low + 1).cast("int"), n.cast("int")), " ").alias("text"))

    parts = docs.select("source_index", "source", "doc_id", "start", F.inline(F.transform(F.sequence(first, last), piece)))
    blocks = parts.groupBy("source_index", "block").agg(F.first("source").alias("source"), F.sort_array(F.collect_list(F.struct("start", "doc_id", "text"))).alias("pieces"))
    return slots(spark, plan).hint("merge").join(blocks, ["source_index", "block"]).select(
        "shard",
        "slot",
        "source",
        "block",
        F.transform("pieces", lambda p: p.doc_id).alias("doc_ids"),
        F.array_join(F.transform("pieces", lambda p: p.text), " ").alias("text"),
    )
