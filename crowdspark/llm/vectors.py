"""Vectors as integers: which rows take part, and their components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Components stand for floor(SCALE * x); beyond MOST (an x of 16,384) they stay at that, so that 64-bit sums are exact.
SCALE, MOST = 256.0, 1 << 22


def whole(vector: Column) -> Column:
    """Whether a vector has components, all of them finite."""
    broken = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~broken, F.lit(False))


def integers(vectors: pa.Array, dim: int) -> np.ndarray:
    """The integer components of vectors of ``dim`` numbers each, without nulls."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.clip(np.floor(flat * SCALE), -MOST, MOST).astype(np.int64).reshape(len(vectors), dim)
