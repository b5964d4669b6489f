"""Vector collections: upsert, exact cosine search, quantisation; `cells` has the clustered index.

A collection is a table (doc_id, embedding).  Distances are compared as they are
given, rounded to `DIGITS` places, and ties go by id, so that noise in the last bits orders nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions.vectors import as_double, cosine_distance, norm

from .blocks import largest, matrix, meet

DIGITS = 6
#: Queries of at most so many bytes are sent to every task at once.
BLOCK_BYTES = 16 << 20
#: Beyond it, rows and queries of a block.
BLOCK_ROWS, BLOCK_QUERIES = 4096, 1024
#: Distances that a task holds at once; it has a few arrays of so many numbers.
CELLS = 1 << 20


def _distance(*args, **kwargs) -> Column:
    return (F.round(cosine_distance(*args, **kwargs), DIGITS) + F.lit(0.0)).alias("distance")


def upsert(current: DataFrame, writes: DataFrame) -> DataFrame:
    """The latest vector of each id; ``seq`` orders the writes, and all of them come after ``current``."""
    old = current.select("doc_id", "embedding", F.lit(None).cast("long").alias("seq"))
    both = old.unionByName(writes.select("doc_id", "embedding", F.col("seq").cast("long")))
    # Nulls don't compare: what was there before counts as the smallest.
    return both.groupBy("doc_id").agg(F.max_by("embedding", F.coalesce("seq", F.lit(-(1 << 62)))).alias("embedding"))


def nearest(vectors: DataFrame, query: DataFrame, k: int) -> DataFrame:
    """(rank, doc_id, distance) of the k nearest to one query (vec); ties by id, vectors without length left out."""
    one = query.select(as_double(F.col("vec")).alias("q")).withColumn("nq", norm(F.col("q")))
    pairs = vectors.join(F.broadcast(one.limit(1)))  # one row
    found = pairs.select("doc_id", _distance(F.col("embedding"), F.col("q"), norm_b=F.col("nq"))).where("distance is not null")
    top = found.orderBy("distance", "doc_id").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy("distance", "doc_id")))  # k rows


def nearest_batch(vectors: DataFrame, queries: DataFrame, k: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, rank, doc_id, distance) for every query (query_id, vec); vectors without length are left out.

    Queries of at most ``block_bytes`` go to every task, which reads its vectors in batches, takes products of matrices of at most
    `CELLS` numbers and keeps the k nearest of each query as it reads.  More queries meet the vectors in blocks of bounded size.
    """
    n, size = queries.agg(F.count("*"), F.sum(8 * F.size("vec") + 64)).first()
    q = queries.where("vec is not null").select("query_id", as_double(F.col("vec")).alias("v")).withColumn("n", norm(F.col("v"))).where("n > 0")
    v = vectors.where("embedding is not null").select("doc_id", as_double(F.col("embedding")).alias("v")).withColumn("n", norm(F.col("v"))).where("n > 0")
    schema = f"query_id {dict(q.dtypes)['query_id']}, doc_id {dict(v.dtypes)['doc_id']}, distance double"

    def compare(rows: pa.Table, asked: pa.Table) -> pa.Table:
        if not (rows.num_rows and asked.num_rows):
            return pa.table({"query_id": asked.column("query_id")[:0], "doc_id": rows.column("doc_id")[:0], "distance": pa.array([], pa.float64())})
        rows, dim = rows.sort_by("doc_id"), len(asked.column("v")[0])
        v, n = matrix(rows.column("v"), dim).T, rows.column("n").to_numpy()
        step, out = max(1, CELLS // rows.num_rows), []
        for at in range(0, asked.num_rows, step):
            part = asked.slice(at, step)
            d = np.round(1 - matrix(part.column("v"), dim) @ v / (part.column("n").to_numpy()[:, None] * n), DIGITS) + 0.0
            r, c = largest(-d, k, -np.inf)
            out.append(pa.table({"query_id": part.column("query_id").take(pa.array(r)), "doc_id": rows.column("doc_id").take(pa.array(c)), "distance": d[r, c]}))
        return pa.concat_tables(out)

    if (size or 0) > block_bytes:
        found = meet(v, q, "doc_id", "query_id", compare, schema, BLOCK_ROWS, BLOCK_QUERIES, vectors.count(), n)
    else:
        asked = q.toArrow()  # of checked size

        def run(batches):
            kept = None
            for b in batches:
                new = compare(pa.Table.from_batches([b]), asked)
                kept = new if kept is None else _nearer(pa.concat_tables([kept, new]), k)
            if kept is not None:
                yield from kept.combine_chunks().to_batches()

        found = v.mapInArrow(run, schema)
    order = [F.col("distance"), F.col("doc_id")]
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "distance")


def _nearer(found: pa.Table, k: int) -> pa.Table:
    """The k nearest of each query."""
    found = found.sort_by([("query_id", "ascending"), ("distance", "ascending"), ("doc_id", "ascending")])
    codes = found.column("query_id").combine_chunks().dictionary_encode().indices.to_numpy()
    place = np.arange(len(codes)) - np.searchsorted(codes, codes)  # codes ascend, as queries are sorted
    return found.filter(pa.array(place < k))


def quantised(vectors: DataFrame) -> DataFrame:
    """(doc_id, scale, codes): vectors as whole numbers from -127 to 127 times a scale of their own."""
    top = F.array_max(F.transform(as_double(F.col("embedding")), lambda x: F.abs(x)))
    scale = F.when(top > 0, top / 127).otherwise(F.lit(1.0))
    return vectors.withColumn("scale", scale).select("doc_id", "scale", F.transform(as_double(F.col("embedding")), lambda x: F.round(x / F.col("scale")).cast("tinyint")).alias("codes"))


def restored(codes: DataFrame) -> DataFrame:
    return codes.select("doc_id", F.transform("codes", lambda x: x * F.col("scale")).alias("embedding"))
