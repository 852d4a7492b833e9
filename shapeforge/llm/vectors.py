"""What the two operators on embeddings share: which vectors take part, and how they are read in numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Not null, not empty, no null or non-finite component, not zero."""
    v = vector.cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def usable_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``vec_id long, v`` of the rows that take part; float vectors stay float (half the bytes to move), others are double."""
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    return rows if dict(rows.dtypes)["v"] == "array<float>" else rows.select("vec_id", F.col("v").cast("array<double>").alias("v"))


def matrix(column, dtype=np.float64) -> np.ndarray:
    """A pandas column of equally long vectors as a matrix."""
    return np.array(column.tolist(), dtype=dtype) if len(column) else np.zeros((0, 0), dtype)
