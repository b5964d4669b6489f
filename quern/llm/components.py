"""Connected components of an edge table: contracted in parts, then by alternating stars.

First each task contracts its edges, ``PORTION`` at a time: nodes that they join are linked to the
smallest of them.  That leaves a star for each component of a portion, and it is all there is
to do where one portion holds all edges.  Else rounds follow, each of which
links every node's larger neighbours to its smallest one (large
star), then its smaller neighbours and itself to the smallest of them (small
star), until nothing changes; the rounds grow with the logarithm of the longest
path.  A node's neighbours are never gathered in one row or task: their minimum is
summed before the exchange, and joined back by broadcast for the few nodes with more than a
thousandth of all edges.  Each round is written to the shared folder, so the
lineage stays short and a lost executor costs one round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, join_counted, written

#: Edges that a task contracts at once.
PORTION = 1_000_000


def contract(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) of all nodes but the smallest ones."""
    nodes, at = np.unique(np.r_[a, b], return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        if (low == high).all():
            break
        np.minimum.at(root, high, low)
        while (root != (up := root[root])).any():
            root = up
    other = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[other], nodes[root[other]]


def _contracted(edges: DataFrame, portion: int) -> DataFrame:
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def close() -> pa.RecordBatch:
            node, root = contract(*(np.concatenate([x.column(i).to_numpy() for x in held]) for i in (0, 1)))
            return pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], schema=schema)

        for batch in batches:
            for part in (batch.slice(i, portion) for i in range(0, batch.num_rows, portion)):
                if held and size + part.num_rows > portion:
                    yield close()
                    held, size = [], 0
                held.append(part)
                size += part.num_rows
        if held:
            yield close()

    return edges.mapInArrow(run, "a long, b long")


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n"))
    return join_counted(both.where("b > a"), least, "a", 2 * total).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    least = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    joined = join_counted(down, least, "a", down.count()).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    out = written(joined.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
    drop_written(down)
    return out


def connected_components(edges: DataFrame, portion: int = PORTION) -> DataFrame:
    """Rows (node, root) for every node with an edge except the roots; ``edges`` has integers a and b.

    The root is the smallest node of a component.  Loops and null ends are ignored.
    """
    given = written(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b"), "edges")
    total = given.count()
    now = written(_contracted(given.coalesce(max(1, -(-total // portion))), portion), "edges")
    drop_written(given)
    seen = None
    while total > portion:  # one portion is complete
        state = tuple(now.agg(F.count("*"), F.bit_xor("b"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())
        if state == seen:
            break
        seen, before = state, now
        now = _small_star(_large_star(now, state[0]))
        drop_written(before)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
