"""Integer vectors that several operators on embeddings share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

#: Entries at or beyond it have no exact integer form in a double; their vectors count as not finite.
MOST = 2.0**50

ship(__name__)


def integer_vectors(vectors: DataFrame, scale: int, shift: int, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """Rows id, x (floor(scale * c) + shift of each component, as longs), and the number of components.

    Rows whose vector is null, empty, or holds a null or non-finite component (or one of 2**50 and more) are left out, and so are
    those of another length than most rows have (of lengths as frequent, the longer counts). Without any row the number is 0.
    """
    c = F.col("v")
    fine = F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < MOST))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(c.isNotNull() & (F.size(c) > 0) & fine)
    most = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    n = most["n"] if most else 0
    return rows.where(F.size("v") == n).select("id", F.transform("v", lambda e: F.floor(e * scale) + shift).alias("x")), n


def matrix(column: pa.Array, n: int) -> np.ndarray:
    """Lists of n longs as an array of rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
