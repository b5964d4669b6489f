"""Nearest neighbours by inner product with vantage-point trees, one tree per shard.

The largest inner product is the smallest distance once vectors get one more component, sqrt(M^2 - |x|^2) with M
the largest length, and queries a zero there: |q - x|^2 = |q|^2 + M^2 - 2 qx.  So the triangle
inequality holds, and a subtree whose distances to its vantage point lie in [lo, hi] has nothing nearer to
a query at distance d from that point than max(lo - d, d - hi).  A search goes into a subtree where that bound is at most
``factor`` times the distance of the k-th neighbour found so far: a factor of one loses nothing, smaller ones visit less.

The top of the tree, at most ``CELLS`` cells, is fitted on a bounded sample (``SAMPLE`` rows); every row is placed in a cell
by it.  Cells are cut by a hash of the id into shards of about ``ROWS`` rows, so a cell with a third of all
rows is many shards, and each shard gets a tree of its own, kept as one row of the index.

A query first asks one shard of the cell it lies in, which bounds its k-th neighbour; then all shards of the cells that
the bound doesn't exclude.  Shards meet queries in blocks of bounded size.  `tuned` measures the recall of several factors for a bounded
number of queries against factor one and takes the smallest that reaches a given recall.

Rows are (vec_id, embedding).  A null id or vector, a zero vector, or a component that is null or not finite takes a row out; shorter
vectors are read with zeros at their end.  An id stands for one row: of repeated ones that of the smallest vector.
Equal scores go by id.  Other columns are ignored; an empty table has an empty index and no result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written
from .vector_blocks import finite, largest, matrix, padded

SAMPLE, CELLS, ROWS, LEAF, ASKED = 8192, 256, 4096, 128, 1024
FACTORS = (0.0, 0.02, 0.04, 0.07, 0.12, 0.15, 0.2, 0.4, 1.0)
#: What rounding can take from a distance or a product, as a share of the lengths.
SLACK = 1e-7
SHARD = "cell int, sub int, n long, ids array<long>, sizes array<int>, vectors array<double>, points array<double>, ranges array<double>"


@dataclass
class Tree:
    """A full binary tree in heap order.  Per inner node a vantage point and the ranges of distances on its two sides: [lo, hi] within the median, then beyond."""

    points: np.ndarray
    ranges: np.ndarray

    @property
    def leaves(self) -> int:
        return len(self.points) + 1

    def place(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row: a row goes within where its distance is at most the median."""
        at = np.zeros(len(rows), np.int64)
        for _ in range(self.leaves.bit_length() - 1):
            d = np.sqrt(np.square(rows - self.points[at]).sum(axis=1))
            at = 2 * at + 1 + (d > self.ranges[at, 0, 1])
        return at - len(self.points)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """For each query and leaf, what the distance is at least."""
        low = np.zeros((len(queries), 1))
        if len(self.points):
            d = distances(queries, self.points)
            for level in range(self.leaves.bit_length() - 1):
                nodes = slice(2**level - 1, 2 ** (level + 1) - 1)
                lo, hi = self.ranges[nodes, :, 0], self.ranges[nodes, :, 1]
                own = np.maximum(lo[None] - d[:, nodes, None], d[:, nodes, None] - hi[None])
                low = np.maximum(low[:, :, None], own).reshape(len(queries), -1)
        return low


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squares = np.square(a).sum(axis=1)[:, None] + np.square(b).sum(axis=1) - 2 * (a @ b.T)
    return np.sqrt(np.maximum(squares, 0))


def lifted(rows: np.ndarray, longest: float) -> np.ndarray:
    """Rows with the component that makes them all equally long."""
    return np.hstack([rows, np.sqrt(np.maximum(longest**2 - np.square(rows).sum(axis=1), 0))[:, None]])


def fit(rows: np.ndarray, levels: int, tight: bool) -> tuple[Tree, np.ndarray]:
    """A tree of so many levels, and the leaf of each row.  ``tight`` ranges are those of these rows; others hold for any row that `place` deals by the median."""
    inner = 2**levels - 1
    points, ranges = np.zeros((inner, rows.shape[1])), np.zeros((inner, 2, 2))
    ranges[:, :, 0], ranges[:, :, 1] = np.inf, -np.inf  # nothing there
    at = np.zeros(len(rows), np.int64)
    for node in range(inner):
        mine = np.flatnonzero(at == node)
        if not len(mine):
            points[node], ranges[node] = 0, [[0, np.inf], [np.inf, -np.inf]] if tight else [[0, np.inf], [np.inf, np.inf]]
            at[mine] = 2 * node + 1
            continue
        # The row farthest from the first one stands at the edge, where distances differ most.
        d = np.sqrt(np.square(rows[mine] - rows[mine[0]]).sum(axis=1))
        points[node] = rows[mine[np.argmax(d)]]
        d = np.sqrt(np.square(rows[mine] - points[node]).sum(axis=1))
        median = np.partition(d, (len(d) - 1) // 2)[(len(d) - 1) // 2]
        beyond = d > median
        for side, x in enumerate((d[~beyond], d[beyond])):
            if tight and len(x):
                ranges[node, side] = x.min(), x.max()
            elif not tight:
                ranges[node, side] = ((0, median), (median, np.inf))[side]
        at[mine] = 2 * node + 1 + beyond
    return Tree(points, ranges), at - inner


@dataclass
class Index:
    """``shards`` has a row a shard (`SHARD`); ``top`` deals rows and queries over cells, ``subs`` says in how many shards each cell lies."""

    shards: DataFrame
    top: Tree
    subs: DataFrame
    dim: int
    longest: float

    def queries(self, rows: DataFrame) -> DataFrame:
        """(query_id, v) of rows (query_id, vec); those that can't be asked are left out, an id is asked once."""
        rows = rows.where(F.col("query_id").isNotNull() & finite(F.col("vec")) & F.exists("vec", lambda x: x != 0))
        rows = rows.groupBy("query_id").agg(F.min(F.col("vec").cast("array<double>")).alias("v"))
        return rows.select("query_id", F.slice(padded(F.col("v"), self.dim), 1, self.dim).alias("v")) if self.dim else rows.where("false")


def build(rows: DataFrame, rows_per_shard: int = ROWS, leaf: int = LEAF, sample: int = SAMPLE) -> Index:
    """The index of all rows (vec_id, embedding)."""
    spark = rows.sparkSession
    rows = rows.where(F.col("vec_id").isNotNull() & finite(F.col("embedding")) & F.exists("embedding", lambda x: x != 0))
    rows = written(rows.groupBy("vec_id").agg(F.min(F.col("embedding").cast("array<double>")).alias("v")), "vp-rows")
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    n, dim, square = rows.agg(F.count("*"), F.max(F.size("v")), F.max(square)).first()
    dim, longest = dim or 0, float(np.sqrt(square or 0.0))
    rows = rows.select("vec_id", padded(F.col("v"), dim).alias("v"))
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow()
    levels = max(0, min(-(-n // rows_per_shard), CELLS, picked.num_rows // 32) - 1).bit_length()
    top, _ = fit(lifted(matrix(picked.column("v"), dim), longest), levels, tight=False)

    def place(batches):
        for b in batches:
            if b.num_rows:
                yield b.append_column("cell", pa.array(top.place(lifted(matrix(b.column("v"), dim), longest)), pa.int32()))

    placed = written(rows.mapInArrow(place, "vec_id long, v array<double>, cell int"), "vp-placed")
    subs = written(placed.groupBy("cell").agg(F.ceil(F.count("*") / rows_per_shard).cast("int").alias("subs")), "vp-cells")
    sub = F.pmod(F.xxhash64("vec_id", F.lit(3)), F.col("subs")).cast("int").alias("sub")
    dealt = placed.join(F.broadcast(subs), "cell").select("cell", sub, "vec_id", "v")  # a row a cell, CELLS at most

    def grow(t: pa.Table) -> pa.Table:
        t = t.sort_by("vec_id")
        v, ids = matrix(t.column("v"), dim), t.column("vec_id").to_numpy()
        tree, at = fit(lifted(v, longest), max(0, -(-len(v) // leaf) - 1).bit_length(), tight=True)
        order = np.argsort(at, kind="stable")
        lists = {"ids": ids[order], "sizes": np.bincount(at, minlength=tree.leaves).astype(np.int32), "vectors": v[order].ravel(), "points": tree.points.ravel(), "ranges": tree.ranges.ravel()}
        columns = {"cell": t.column("cell")[:1].combine_chunks(), "sub": t.column("sub")[:1].combine_chunks(), "n": pa.array([len(v)])}
        return pa.table(columns | {k: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x)) for k, x in lists.items()})

    shards = written(dealt.groupBy("cell", "sub").applyInArrow(grow, SHARD), "vp-shards")
    return Index(shards, top, subs, dim, longest)


def _search(shard: pa.Table, asked: pa.Table, k: int, dim: int, longest: float) -> pa.Table:
    """The k nearest of each query in a shard, of those that its bound ``least`` lets through."""
    ids, sizes, vectors, points, ranges = (shard.column(c).combine_chunks().flatten().to_numpy() for c in ("ids", "sizes", "vectors", "points", "ranges"))
    vectors, points, ranges = vectors.reshape(-1, dim), points.reshape(-1, dim + 1), ranges.reshape(-1, 2, 2)
    ends = np.cumsum(sizes)
    q, query, factor = matrix(asked.column("v"), dim), asked.column("query_id").to_numpy(), asked.column("factor").to_numpy()
    low = Tree(points, ranges).bounds(np.hstack([q, np.zeros((len(q), 1))]))
    length = np.sqrt(np.square(q).sum(axis=1))
    slack = SLACK * longest * length
    best, who = np.full((len(q), k), -np.inf), np.full((len(q), k), np.iinfo(np.int64).max)
    floor = asked.column("least").to_numpy().copy()  # the k-th score found elsewhere

    def look(mine: np.ndarray, leaf: int) -> None:
        rows = slice(ends[leaf] - sizes[leaf], ends[leaf])
        least = np.maximum(floor[mine], best[mine, -1])
        a, x = np.nonzero(q[mine] @ vectors[rows].T >= (least - slack[mine])[:, None])
        # One order of additions for every pair, so equal vectors score the same to the last bit.
        exact = np.zeros(len(a))
        for j in range(dim):
            exact += q[mine[a], j] * vectors[rows][x, j]
        new = np.full((len(mine), sizes[leaf]), -np.inf)
        new[a, x] = exact
        new[query[mine][:, None] == ids[rows][None, :]] = -np.inf
        scores = np.hstack([best[mine], new])
        names = np.hstack([who[mine], np.broadcast_to(ids[rows], new.shape)])
        r, c = largest(scores, k, -np.inf, names)
        place = np.arange(len(r)) - np.searchsorted(r, r)
        best[mine], who[mine] = -np.inf, np.iinfo(np.int64).max
        best[mine[r], place], who[mine[r], place] = scores[r, c], names[r, c]

    home = np.argmin(low, axis=1)
    for leaf in range(len(sizes)):
        if sizes[leaf] and len(mine := np.flatnonzero(home == leaf)):
            look(mine, leaf)
    for leaf in np.argsort(low.mean(axis=0)):
        reach = np.sqrt(np.maximum(length**2 + longest**2 - 2 * np.maximum(floor, best[:, -1]), 0))
        near = low[:, leaf] <= factor * reach + SLACK * (longest + length)
        if sizes[leaf] and len(mine := np.flatnonzero(near & (home != leaf))):
            look(mine, leaf)
    r, c = np.nonzero((best > -np.inf) & (best >= floor[:, None]))
    return pa.table({"ask": asked.column("ask").to_numpy()[r], "vec_id": who[r, c], "score": best[r, c]})


def _ask(index: Index, asked: DataFrame, k: int) -> DataFrame:
    """(ask, vec_id, score): shards against the queries (cell, sub, ask, query_id, v, factor, least) that were sent to them, in blocks."""
    dim, longest = index.dim, index.longest
    asked = written(asked, "vp-asked")
    blocks = asked.groupBy("cell", "sub").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("blocks"))
    asked = asked.join(blocks.hint("shuffle_hash"), ["cell", "sub"]).withColumn("block", F.pmod(F.xxhash64("ask"), F.col("blocks")).cast("int")).drop("blocks")
    shards = index.shards.join(blocks.hint("merge"), ["cell", "sub"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    asked = asked.select(*[F.col(c).alias(c) for c in asked.columns])
    met = shards.groupBy("cell", "sub", "block").cogroup(asked.groupBy("cell", "sub", "block"))
    empty = pa.table({"ask": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
    return met.applyInArrow(lambda s, a: _search(s, a, k, dim, longest) if s.num_rows and a.num_rows else empty, "ask long, vec_id long, score double")


def _routed(index: Index, asked: DataFrame, home: bool) -> DataFrame:
    """Sends queries to the cell they lie in, or to all others that their bound doesn't exclude."""
    top, dim, longest = index.top, index.dim, index.longest
    names = [c for c in asked.columns]

    def route(batches):
        for b in batches:
            if not b.num_rows:
                continue
            q = matrix(b.column("v"), dim)
            low = top.bounds(np.hstack([q, np.zeros((len(q), 1))]))
            if home:
                r, c = np.arange(len(q)), np.argmin(low, axis=1)
            else:
                length = np.sqrt(np.square(q).sum(axis=1))
                reach = np.sqrt(np.maximum(length**2 + longest**2 - 2 * b.column("least").to_numpy(), 0))
                reach = b.column("factor").to_numpy() * reach + SLACK * (longest + length)
                own = np.zeros(low.shape, bool)
                own[np.arange(len(q)), np.argmin(low, axis=1)] = True
                r, c = np.nonzero(own | (low <= reach[:, None]))
            yield pa.RecordBatch.from_arrays([*[x.take(pa.array(r)) for x in b.columns], pa.array(c, pa.int32())], names=[*names, "cell"])

    kinds = ", ".join(f"{c} {t}" for c, t in asked.dtypes)
    return asked.mapInArrow(route, f"{kinds}, cell int").join(F.broadcast(index.subs), "cell")  # a row a cell, CELLS at most


def _top(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("ask").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _found(index: Index, asked: DataFrame, k: int) -> DataFrame:
    """(ask, rank, vec_id, score) of queries (ask, query_id, v, factor)."""
    first = F.pmod(F.xxhash64("query_id", F.lit(5)), F.col("subs")).cast("int").alias("sub")
    asked = asked.withColumn("least", F.lit(float("-inf")))
    at_home = _routed(index, asked, home=True).select(*asked.columns, "cell", first)
    near = written(_ask(index, at_home, k), "vp-first")
    bound = near.groupBy("ask").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
    asked = asked.join(bound, "ask", "left").withColumn("least", F.coalesce("kth", "least")).drop("kth")
    # The first shard is asked again with its bound, as what it has below that no longer counts.
    everywhere = _routed(index, asked, home=False)
    everywhere = everywhere.select(*asked.columns, "cell", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("sub"))
    return _top(_ask(index, everywhere, k), k)


def tuned(index: Index, queries: DataFrame, k: int, recall: float, most: int = 128) -> tuple[float, dict[float, float]]:
    """The smallest factor whose results for at most ``most`` queries hold this share of the exact ones, and the share of each factor."""
    some = queries.orderBy(F.xxhash64("query_id"), "query_id").limit(most)
    grid = F.explode(F.array(*[F.struct(F.lit(g).cast("long").alias("g"), F.lit(float(f)).alias("factor")) for g, f in enumerate(FACTORS)]))
    asked = some.select("query_id", "v", grid.alias("x")).select("query_id", "v", "x.g", "x.factor")
    asked = written(asked.withColumn("ask", F.row_number().over(Window.orderBy("query_id", "g")).cast("long")), "vp-tune")  # ``most`` queries
    found = _found(index, asked.select("ask", "query_id", "v", "factor"), k).join(F.broadcast(asked.select("ask", "query_id", "g")), "ask").select("query_id", "g", "vec_id")
    found = written(found, "vp-tuned")
    exact = found.where(F.col("g") == len(FACTORS) - 1).select("query_id", "vec_id")
    counts = dict(found.join(exact.select("query_id", "vec_id"), ["query_id", "vec_id"], "left_semi").groupBy("g").count().collect())  # a row a factor
    whole = counts.get(len(FACTORS) - 1, 0)
    shares = {f: counts.get(g, 0) / whole if whole else 1.0 for g, f in enumerate(FACTORS)}
    return min(f for f in FACTORS if shares[f] >= recall), shares


def search(index: Index, queries: DataFrame, k: int = 20, factor: float | None = None, recall: float = 0.97) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest to each query (query_id, vec), but for the row of its own id.

    With ``factor`` None the factor is tuned to this recall.
    """
    asked = written(index.queries(queries), "vp-queries")
    if factor is None:
        factor = tuned(index, asked, k, recall)[0]
    asked = asked.select(F.col("query_id").alias("ask"), "query_id", "v", F.lit(float(factor)).alias("factor"))
    return _found(index, asked, k).select(F.col("ask").alias("query_id"), F.col("rank").cast("int").alias("rank"), "vec_id", "score")
