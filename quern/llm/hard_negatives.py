"""Hard negatives by slots of scores.

An anchor's positives are its nearest rows of the same label.  A positive of score p allows
negatives with scores from ``low`` to ``high`` hundredths of p, so each positive has its own window, and the windows of
an anchor overlap.  Their upper limits, in descending order, split all scores into
disjoint slots: slot i has the scores up to limit i and above limit i + 1.  A negative falls into one
slot; each block keeps its first k per slot and blocks are merged by slot.  What a window holds
is the first k of its slot and all later ones, since scores fall from slot to slot, down to the window's lower limit.

Scores are whole numbers: components are floor(scale * x), and products are added without rounding.

Rows are (vec_id, label, embedding, anchor).  A null id, label or vector, or a component that is null or not finite, takes a row out; shorter
vectors are read with zeros at their end, so an empty one scores 0.  An id stands for one row: of repeated ones,
that of the smallest label, then vector, is taken.  Equal scores go by id.
Other columns are ignored, whatever their names; an empty table has no result.  Scores beyond a long fail the query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written
from .vector_blocks import NONE, finite, largest, matrix, meet, padded

#: Rows and anchors of a block; a task holds one block of each and their scores, 8 bytes a pair.
ROWS, ANCHORS = 4096, 1024


def _scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, without rounding."""
    most = float(np.abs(anchors).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(1, rows.shape[1])
    if most < 2**53:
        return (anchors @ rows.T).astype(np.int64)
    exact = np.array([[int(x) for x in a] for a in anchors], object) @ np.array([[int(x) for x in v] for v in rows], object).T
    if any(abs(x) >= 2**63 for x in exact.flat):
        raise OverflowError("a score doesn't fit a long")
    return exact.astype(np.int64)


def _block(rows: pa.Table, asked: pa.Table, dim: int, scale: float):
    """A pair of blocks as (ids, labels, anchor ids, anchor labels, scores); rows in the order of their ids."""
    rows = rows.sort_by("vec_id")
    codes = [np.floor(scale * matrix(t.column("v"), dim)) for t in (asked, rows)]
    columns = [t.column(c).to_numpy() for t, c in ((rows, "vec_id"), (rows, "label"), (asked, "anchor_id"), (asked, "label"))]
    return *columns, _scores(*codes)


def _positives(k: int, dim: int, scale: float):
    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        ids, labels, anchors, own, s = _block(rows, asked, dim, scale)
        s[(labels[None, :] != own[:, None]) | (ids[None, :] == anchors[:, None])] = NONE
        a, x = largest(s, k, NONE)
        return pa.table({"anchor_id": anchors[a], "positive_id": ids[x], "score": s[a, x]})

    return run


def _negatives(n_limits: int, k: int, dim: int, scale: float):
    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        ids, labels, anchors, own, s = _block(rows, asked, dim, scale)
        s[labels[None, :] == own[:, None]] = NONE
        limits = matrix(asked.column("limits"), n_limits)
        slot = np.zeros(s.shape, np.int8)
        for i in range(n_limits):
            slot += s <= limits[:, i, None]
        found = []
        for i in range(1, n_limits + 1):
            a, x = largest(np.where(slot == i, s, NONE), k, NONE)
            found.append(pa.table({"anchor_id": anchors[a], "slot": np.full(len(a), i, np.int32), "negative_id": ids[x], "score": s[a, x]}))
        return pa.concat_tables(found)

    return run


def mine(rows: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256.0) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for anchors among ``rows``."""
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite(F.col("embedding")))
    rows = rows.groupBy("vec_id").agg(F.min(F.struct(F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"))).alias("r"), F.bool_or("anchor").alias("anchor"))
    rows = written(rows.select("vec_id", "r.label", "r.v", "anchor"), "negatives-rows")
    n, n_anchors, dim = rows.agg(F.count("*"), F.count_if("anchor"), F.max(F.size("v"))).first()
    dim = dim or 0
    rows = rows.withColumn("v", padded(F.col("v"), dim))
    anchors = rows.where("anchor").select(F.col("vec_id").alias("anchor_id"), "label", "v")
    rows = rows.select("vec_id", "label", "v")
    sizes = (ROWS, ANCHORS, n, n_anchors)

    near = meet(rows, anchors, "vec_id", "anchor_id", _positives(positives, dim, scale), "anchor_id long, positive_id long, score long", *sizes)
    place = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.col("score").desc(), "positive_id"))
    near = near.withColumn("place", place).where(F.col("place") <= positives)
    # At most ``positives`` entries each.
    mine_ = near.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("place", "positive_id", "score"))).alias("positives"))
    mine_ = written(mine_, "negatives-positives")

    limits = F.expr(f"transform(positives, p -> ({int(high)} * p.score) div 100)")
    none = F.array_repeat(F.lit(NONE), positives)
    asked = anchors.join(mine_.select("anchor_id", F.slice(F.concat(limits, none), 1, positives).alias("limits")), "anchor_id")
    found = meet(rows, asked, "vec_id", "anchor_id", _negatives(positives, negatives, dim, scale), "anchor_id long, slot int, negative_id long, score long", *sizes)
    place = F.row_number().over(Window.partitionBy("anchor_id", "slot").orderBy(F.col("score").desc(), "negative_id"))
    found = found.withColumn("place", place).where(F.col("place") <= negatives)
    # Slots in order are scores in order: at most ``positives * negatives`` entries.
    slots = found.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("slot", "place", "negative_id", "score"))).alias("found"))

    asked = mine_.join(slots, "anchor_id").select("anchor_id", "found", F.inline("positives"))
    asked = asked.withColumnRenamed("score", "positive_score")
    suffix = F.slice(F.filter("found", lambda x: x["slot"] >= F.col("place")), 1, negatives)
    p, x = F.col("positive_score"), F.col("negative_score")
    out = asked.select("anchor_id", "positive_id", "positive_score", F.posexplode(suffix).alias("at", "n"))
    out = out.select("anchor_id", "positive_id", (F.col("at") + 1).alias("rank"), "n.negative_id", "positive_score", F.col("n.score").alias("negative_score"))
    return out.where((low * p <= 100 * x) & (100 * x <= high * p))
