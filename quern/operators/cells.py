"""A clustered vector index: cells of near vectors, stored by cell, of which a search reads a few.

Centroids are fitted by spherical k-means on a bounded sample; every vector is then put into the cell of its nearest
centroid and written there, so the index is a folder of cells and a search for few queries reads their cells' files alone.
A query probes the ``probes`` nearest cells; inside them the search is exact.  Cells are cut into blocks by a hash of the id, so a
crowded cell is many groups of bounded size.

Vectors without length are in no cell; vectors of another length than the sample's first are refused.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions.vectors import as_double, norm
from quern.session import cut

from .blocks import largest, matrix

#: Rows that the centroids are fitted on, and how many cells there are at most: their product bounds what the driver holds.
SAMPLE, MOST_CELLS, PER_CELL = 16_384, 1024, 64
BLOCK_ROWS, BLOCK_QUERIES = 4096, 1024
DIGITS = 6


def _units(rows: np.ndarray) -> np.ndarray:
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def fit(rows: np.ndarray, cells: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    """Unit centroids; started far apart, empty ones are put on the rows that lie worst."""
    rng = np.random.default_rng(seed)
    start = [int(rng.integers(len(rows)))]
    near = rows @ rows[start[0]]
    while len(start) < cells:  # each next start is drawn by its distance to those before
        p = np.maximum(1 - near, 0) + 1e-12
        start.append(int(rng.choice(len(rows), p=p / p.sum())))
        near = np.maximum(near, rows @ rows[start[-1]])
    centroids = rows[start]
    for _ in range(rounds):
        likeness = rows @ centroids.T
        at = np.argmax(likeness, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, at, rows)
        lost = np.flatnonzero(np.linalg.norm(sums, axis=1) == 0)
        sums[lost] = rows[np.argsort(likeness.max(axis=1), kind="stable")[: len(lost)]]
        centroids = _units(sums)
    return centroids


@dataclass
class CellIndex:
    """``path`` holds (doc_id, v, cell) by cell, v of length one; ``sizes`` is (cell, rows), ``centroids`` one row a cell."""

    path: str
    schema: str
    sizes: DataFrame
    centroids: np.ndarray

    def rows(self, spark) -> DataFrame:
        return spark.read.schema(self.schema).parquet(self.path)


def build(vectors: DataFrame, path: str, cells: int | None = None) -> CellIndex:
    """Writes the index of vectors (doc_id, embedding) to a folder."""
    v = as_double(F.col("embedding"))
    rows = vectors.where("doc_id is not null and embedding is not null").select("doc_id", v.alias("v")).withColumn("n", norm(F.col("v"))).where("n > 0")
    rows = cut(rows.select("doc_id", F.transform("v", lambda x: x / F.col("n")).alias("v")))
    total = rows.count()
    kind = dict(rows.dtypes)["doc_id"]
    picked = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).select("v").toArrow()
    if not total:
        centroids = np.zeros((0, 0))
    else:
        dim = len(picked.column("v")[0])
        sample = matrix(picked.column("v"), dim)
        centroids = fit(sample, cells or max(1, min(MOST_CELLS, round(total**0.5), -(-len(sample) // PER_CELL) * 4)))

    def place(batches):
        for b in batches:
            if b.num_rows:
                yield b.append_column("cell", pa.array(np.argmax(matrix(b.column("v"), centroids.shape[1]) @ centroids.T, axis=1), pa.int32()))

    placed = rows.mapInArrow(place, f"doc_id {kind}, v array<double>, cell int")
    # A cell's rows go to as many tasks as the hash of their ids says, so a crowded cell isn't one task's.
    crowd = max(1, -(-total // (max(1, len(centroids)) * BLOCK_ROWS)))
    placed.repartition(F.col("cell"), F.pmod(F.xxhash64("doc_id"), F.lit(crowd))).write.partitionBy("cell").mode("overwrite").parquet(path)
    index = CellIndex(path, f"doc_id {kind}, v array<double>, cell int", None, centroids)
    index.sizes = cut(index.rows(vectors.sparkSession).groupBy("cell").agg(F.count("*").alias("rows")))
    return index


def search(index: CellIndex, queries: DataFrame, k: int, probes: int = 4) -> DataFrame:
    """(query_id, rank, doc_id, distance) of the k nearest among the probed cells, for queries (query_id, vec); distances are cosine, rounded, ties go by id."""
    spark, centroids = queries.sparkSession, index.centroids
    dim = centroids.shape[1]
    kinds = dict(queries.dtypes)["query_id"], index.schema.split()[1].rstrip(",")
    q = queries.where("query_id is not null and vec is not null").select("query_id", as_double(F.col("vec")).alias("v")).withColumn("n", norm(F.col("v"))).where("n > 0")
    q = q.select("query_id", F.transform("v", lambda x: x / F.col("n")).alias("v"))

    def route(batches):
        for b in batches:
            if b.num_rows and len(centroids):
                r, c = largest(matrix(b.column("v"), dim) @ centroids.T, probes, -np.inf)
                yield pa.RecordBatch.from_arrays([*[x.take(pa.array(r)) for x in b.columns], pa.array(c, pa.int32())], names=["query_id", "v", "cell"])

    asked = cut(q.mapInArrow(route, f"query_id {kinds[0]}, v array<double>, cell int"))
    crowds = asked.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("a")).join(index.sizes, "cell")
    crowds = crowds.select("cell", "a", F.ceil(F.col("rows") / BLOCK_ROWS).cast("int").alias("r"))
    known = sorted(x.cell for x in crowds.select("cell").collect())  # a row a cell, `MOST_CELLS` at most
    # The cells are folders: naming them leaves the others unread.
    rows = index.rows(spark).where(F.col("cell").isin(known) if known else F.lit(False))
    crowds = F.broadcast(crowds)
    at = F.pmod(F.xxhash64("doc_id"), F.col("r")).cast("int")  # of one type on both sides, as groups are dealt by a hash
    rows = rows.join(crowds, "cell").select("doc_id", "v", "cell", at.alias("sub"), F.explode(F.sequence(F.lit(0), F.col("a") - 1)).alias("block"))
    at = F.pmod(F.xxhash64("query_id"), F.col("a")).cast("int")
    asked = asked.join(crowds, "cell").select("query_id", F.col("v").alias("q"), "cell", at.alias("block"), F.explode(F.sequence(F.lit(0), F.col("r") - 1)).alias("sub"))

    def compare(t: pa.Table, a: pa.Table) -> pa.Table:
        t = t.sort_by("doc_id")
        d = np.round(1 - matrix(a.column("q"), dim) @ matrix(t.column("v"), dim).T, DIGITS) + 0.0
        r, c = largest(-d, k, -np.inf)
        return pa.table({"query_id": a.column("query_id").take(pa.array(r)), "doc_id": t.column("doc_id").take(pa.array(c)), "distance": d[r, c]})

    groups = ["cell", "sub", "block"]
    found = rows.groupBy(*groups).cogroup(asked.groupBy(*groups)).applyInArrow(compare, f"query_id {kinds[0]}, doc_id {kinds[1]}, distance double")
    order = Window.partitionBy("query_id").orderBy("distance", "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "distance")


def compared(index: CellIndex, queries: DataFrame, probes: int = 4) -> float:
    """The share of all pairs of queries and vectors that a search compares."""
    sizes = {r.cell: r.rows for r in index.sizes.collect()}  # a row a cell
    asked = matrix(queries.select(as_double(F.col("vec")).alias("v")).toArrow().column("v"), index.centroids.shape[1])
    r, c = largest(_units(asked) @ index.centroids.T, probes, -np.inf)
    return sum(sizes.get(int(x), 0) for x in c) / (len(asked) * sum(sizes.values()))
