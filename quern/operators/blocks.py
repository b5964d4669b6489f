"""Matrices of Arrow columns, the k largest of each row, and meetings of blocks of rows with blocks of queries."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """Rows of a column of lists of ``dim`` numbers."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), dim)


def largest(scores: np.ndarray, k: int, none, ids: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest of each row, larger ones first; ties by ``ids``, or by column; ``none`` is no score."""
    n = scores.shape[1]
    least = np.partition(scores, n - k, axis=1)[:, n - k, None] if n > k else none
    r, c = np.nonzero((scores >= least) & (scores > none))
    order = np.lexsort((c if ids is None else ids[r, c], -scores[r, c], r))
    r, c = r[order], c[order]
    first = np.arange(len(r)) - np.searchsorted(r, r) < k
    return r[first], c[first]


def meet(rows: DataFrame, asked: DataFrame, key: str, asked_key: str, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str, per_block: int, asked_per_block: int, n_rows: int, n_asked: int) -> DataFrame:
    """``run`` over every pair of a block of rows and a block of queries.

    Blocks are dealt by a hash of the key, so they are even whatever the rows hold; each pair is a group of its
    own, of bounded size, and a task holds one at a time.  Rows are copied once for each block of queries, and the other way round.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    r, a = max(4 * cores, -(-n_rows // per_block)), max(1, -(-n_asked // asked_per_block))
    of_row = F.pmod(F.xxhash64(key), F.lit(r))
    of_asked = F.pmod(F.xxhash64(asked_key), F.lit(a))
    left = rows.withColumn("_pair", F.explode(F.transform(F.sequence(F.lit(0), F.lit(a - 1)), lambda i: i * r + of_row)))
    right = asked.withColumn("_pair", F.explode(F.transform(F.sequence(F.lit(0), F.lit(r - 1)), lambda i: of_asked * r + i)))
    right = right.select(*[F.col(c).alias(c) for c in right.columns])  # both sides often come from one table
    return left.groupBy("_pair").cogroup(right.groupBy("_pair")).applyInArrow(run, schema)
