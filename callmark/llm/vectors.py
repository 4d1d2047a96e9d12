"""What the operators on embeddings share: which rows have a usable vector, and Arrow batches as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dimension(rows: DataFrame, vector_col: str = "embedding") -> int:
    """The most frequent length of the vectors (of several, the greatest), 0 without any."""
    sizes = rows.where(F.size(vector_col) > 0).groupBy(F.size(vector_col).alias("d")).agg(F.count("*").alias("n"))
    most = sizes.agg(F.max(F.struct("n", "d")).alias("m")).first()["m"]
    return most["d"] if most else 0


def finite(rows: DataFrame, d: int, vector_col: str = "embedding") -> DataFrame:
    """Rows whose vector has d entries, none of them null, NaN or infinite.  Shorter and longer ones lack a place for each component."""
    v = F.col(vector_col)
    whole = F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    return rows.where((F.size(v) == d) & whole)


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """A column of vectors of d entries each as doubles."""
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, d)
