"""Vectors as the vector operators read them: cleaned and padded; blocks and matrices are those of the library."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.operators.blocks import largest, matrix, meet

__all__ = ["NONE", "finite", "largest", "matrix", "meet", "padded"]

#: Stands for "no score".
NONE = np.iinfo(np.int64).min


def finite(vector: Column) -> Column:
    """Whether a vector is there and every component is a finite number."""
    sound = F.forall(vector.cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(sound, F.lit(False))


def padded(vector: Column, dim: int) -> Column:
    """In double precision, with zeros up to ``dim`` components."""
    v = vector.cast("array<double>")
    return F.concat(v, F.array_repeat(F.lit(0.0), F.lit(dim) - F.size(v)))
