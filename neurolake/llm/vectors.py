"""What both embedding operators do first: one valid vector per id."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def one_per_id(embeddings: DataFrame) -> DataFrame:
    """``vec_id, embedding`` with one row an id: of rows that repeat an id, the smallest vector in array order (nulls last)."""
    return embeddings.select(F.col("vec_id").cast("long"), "embedding").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def valid(vectors: DataFrame) -> DataFrame:
    """Those that can be compared: not null, finite, not zero, and of the length that most such vectors have."""
    inf = float("inf")
    good = vectors.where("vec_id is not null and embedding is not null").where(
        F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < inf)) & F.exists("embedding", lambda x: x != 0)
    )
    length = good.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).first()
    return good.where(F.size("embedding") == (length["d"] if length else 0))


def stacked(column) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of ``a`` with those of ``b``, summed component after component: equal to the last bit in any block."""
    total = np.zeros(len(a))
    for at in range(0, len(a), 1 << 10):  # a slice stays in a core's cache, turned so that a component is a row
        some = slice(at, at + (1 << 10))
        first, *rest = np.ascontiguousarray((a[some] * b[some]).T)
        total[some] = first
        for parts in rest:
            total[some] += parts
    return total
