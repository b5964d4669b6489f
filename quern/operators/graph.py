"""Links: extraction, adjacency, inversion, and frontier expansion in rounds."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from quern.functions.text import plain_title
from quern.session import cut

from .prefix import ranked


#: So many pairs that a task tells apart take about 200 MB.
PAIRS = 2_000_000


def two_hop(left: DataFrame, right: DataFrame, pairs_per_task: int = PAIRS) -> DataFrame:
    """(src, n): how many distinct targets each source reaches over two links, by way of any middle.

    Exact, so every pair of source and target is met: for graphs whose middles have few links.  `two_hop_sketch` is for the others.
    Middles, and then pairs, are dealt over as many tasks as it takes for ``pairs_per_task`` pairs in each, repeats counted.
    """
    a = cut(left.select("src", F.col("dst").alias("mid")).distinct())
    b = cut(right.select(F.col("src").alias("mid"), "dst").distinct())
    pairs = a.groupBy("mid").agg(F.count("*").alias("x")).join(b.groupBy("mid").agg(F.count("*").alias("y")), "mid")
    n = pairs.agg(F.sum(F.col("x") * F.col("y"))).first()[0] or 0
    parts = max(left.sparkSession.sparkContext.defaultParallelism, -(-n // pairs_per_task))
    met = a.repartition(parts, "mid").join(b.repartition(parts, "mid").hint("merge"), "mid").select("src", "dst")
    return met.repartition(parts, "src", "dst").distinct().groupBy("src").agg(F.count("*").alias("n"))


def two_hop_sketch(left: DataFrame, right: DataFrame, bits: int = 12) -> DataFrame:
    """(src, n): about how many, from a sketch of 2^``bits`` registers for each middle's targets; a source's sketches are merged.

    What is exchanged grows with the links, not with pairs of them: a middle with a third of all links is one sketch.
    The standard error is about 0.8 / sqrt(2^bits).
    """
    b = right.groupBy(F.col("src").alias("mid")).agg(F.hll_sketch_agg("dst", F.lit(bits)).alias("sketch"))
    a = left.select("src", F.col("dst").alias("mid"))
    return a.join(b, "mid").groupBy("src").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n"))


#: So many titles, or a filter of at most so many bytes, are sent to every task.
FEW, FILTER_BYTES = 200_000, 32 << 20
_MAP_BITS = 1 << 15


def bloom_filter(keys: DataFrame, column: str, n: int, bits_per_key: int = 10, hashes: int = 4) -> tuple[DataFrame, int] | None:
    """(maps): one row with the bit maps of a Bloom filter of so many keys, and how many maps there are; None if it would outgrow `FILTER_BYTES`.

    The maps are built by an aggregate, in parts before the exchange.
    """
    maps = max(1, -(-n * bits_per_key // _MAP_BITS))
    if maps * _MAP_BITS // 8 > FILTER_BYTES:
        return None
    at = F.explode(F.array(*[_bit(F.col(column), i, maps) for i in range(hashes)]))
    rows = keys.select(at.alias("at")).groupBy(F.floor(F.col("at") / _MAP_BITS).cast("int").alias("map")).agg(F.bitmap_construct_agg(F.col("at") % _MAP_BITS).alias("bits"))
    return rows.agg(F.map_from_entries(F.collect_list(F.struct("map", "bits"))).alias("maps")), maps


def _bit(key: Column, i: int, maps: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(i), key), F.lit(maps * _MAP_BITS))


def maybe_in(key: Column, maps: Column, n_maps: int, hashes: int = 4) -> Column:
    """Whether a key may be in the filter; false is certain."""

    def on(at: Column) -> Column:
        inside = (at % _MAP_BITS).cast("int")
        byte = F.conv(F.hex(F.substring(F.try_element_at(maps, F.floor(at / _MAP_BITS).cast("int")), F.floor(inside / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return F.coalesce(F.floor(byte / F.pow(F.lit(2), inside % 8)).cast("int") % 2, F.lit(0)) == 1

    out = on(_bit(key, 0, n_maps))
    for i in range(1, hashes):
        out = out & on(_bit(key, i, n_maps))
    return out


def unseen_filtered(titles: DataFrame, visited: DataFrame, n_visited: int, few: int = FEW) -> DataFrame:
    """`unseen`, with as few titles exchanged as the number of visited ones allows.

    Few visited titles are sent to every task.  More go there as a Bloom filter: titles that it knows to be new stay
    where they are, and only possible repeats are exchanged for the exact test.  Beyond `FILTER_BYTES` all are exchanged.
    """
    if n_visited <= few:
        return unseen(titles, F.broadcast(visited))
    made = bloom_filter(visited, "title", n_visited)
    if made is None:
        return unseen(titles, visited)
    maps, n = made
    marked = titles.join(F.broadcast(cut(maps))).withColumn("_maybe", maybe_in(F.col("title"), F.col("maps"), n)).drop("maps")  # one row of checked size
    new = marked.where(~F.col("_maybe")).drop("_maybe")
    return new.unionByName(unseen(marked.where("_maybe").drop("_maybe"), visited))


def unseen(titles: DataFrame, visited: DataFrame) -> DataFrame:
    return titles.join(visited, "title", "left_anti")


#: So many rows are picked by a limit, which one task merges; more are ranked in ranges, to the same result.
TOP = 100_000


def kept_of(n: int, alpha: float, beta: int) -> int:
    return min(n, max(beta, int(n * alpha)))


def prune(titles: DataFrame, alpha: float = 0.001, beta: int = 500, seed: int | None = None, n: int | None = None) -> DataFrame:
    """At most max(beta, alpha * n) of n titles: by a hash of the title, or at random with a seed."""
    keep = kept_of(titles.count() if n is None else n, alpha, beta)
    by = F.xxhash64("title", F.lit(seed)) if seed is not None else F.sha2(F.col("title").cast("binary"), 256)
    if keep <= TOP:
        return titles.orderBy(by, "title").limit(keep)
    return ranked(titles.withColumn("_by", by), [F.col("_by"), F.col("title")]).where(F.col("rank") < keep).drop("_by", "rank")


@dataclass
class Crawl:
    """fetched (round, title), extracted (round, title; the links of each round), both without repeats inside a round; ``figures`` has seconds and rows of each round."""

    fetched: DataFrame
    extracted: DataFrame
    rounds: int
    figures: list[dict] = field(default_factory=list)


def crawl(seeds: DataFrame, links: DataFrame, rounds: int, alpha: float = 0.001, beta: int = 500) -> Crawl:
    """Expands a frontier of titles over ``links`` (src, dst) that a page source gives.

    A round prunes the frontier, which has no visited titles, drops odd ones, fetches the rest and takes
    the plain titles they link to; those not visited are the next frontier.
    Ends early with an empty frontier.  Each round is written to the shared folder, and what it wrote is counted as it is written.
    """
    spark = links.sparkSession
    links = cut(links.select("src", "dst").where(plain_title(F.col("dst"))))  # every round reads them
    frontier, n_frontier = counted(seeds.select("title").distinct())
    visited = spark.createDataFrame([], "round int, title string")
    extracted = visited
    done, n_visited, figures = 0, 0, []
    for i in range(1, rounds + 1):
        began = time.perf_counter()
        now = prune(frontier, alpha, beta, n=n_frontier).where(plain_title(F.col("title")))
        now, fetched = counted(now.select(F.lit(i).alias("round"), "title"))
        if not fetched:
            break
        done, n_visited = i, n_visited + fetched
        visited = visited.unionByName(now)
        # At most max(beta, alpha * n) titles are fetched a round.
        sources = now.select(F.col("title").alias("src"))
        found = links.join(F.broadcast(sources) if fetched <= FEW else sources, "src", "left_semi")
        found, n_found = counted(found.select(F.lit(i).alias("round"), F.col("dst").alias("title")).distinct())
        extracted = extracted.unionByName(found)
        figures.append({"round": i, "fetched": fetched, "extracted": n_found, "seconds": time.perf_counter() - began})
        if i == rounds:
            break
        frontier, n_frontier = counted(unseen_filtered(found.select("title"), visited.select("title"), n_visited))
    return Crawl(visited, extracted, done, figures)


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """The rows written to the shared folder, and their number, which is observed on the way."""
    seen = Observation()
    out = cut(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return out, seen.get["n"]


def crawl_stats(result: Crawl) -> DataFrame:
    """One row: pages fetched, distinct titles extracted, rounds."""
    fetched = result.fetched.agg(F.count("*").alias("n_fetched"))
    titles = result.extracted.agg(F.count_distinct("title").alias("n_pages"))
    return fetched.join(F.broadcast(titles)).withColumn("rounds", F.lit(result.rounds))  # one row each


def throughput(result: Crawl) -> DataFrame:
    """(round, fetched, extracted, seconds, per_second) from what was observed while the rounds ran; nothing is counted again."""
    spark = result.fetched.sparkSession
    rows = [(f["round"], f["fetched"], f["extracted"], f["seconds"], f["extracted"] / f["seconds"]) for f in result.figures]  # a row a round
    return spark.createDataFrame(rows, "round int, fetched long, extracted long, seconds double, per_second double")


def save_stats(stats: DataFrame, path: str) -> DataFrame:
    """Writes a job's statistics as JSON, and reads them back."""
    stats.write.mode("overwrite").json(path)
    return stats.sparkSession.read.schema(stats.schema).json(path)
