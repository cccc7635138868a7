"""Vector columns: which rows take part, and their passage to numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, FloatType

from .shared import written


def finite(vector: Column) -> Column:
    """Not null, not empty, all components finite numbers, and one of them not zero."""
    good = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)) & ~F.isnan(x.cast("double")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & good & F.exists(vector, lambda x: x != 0), F.lit(False))


def stored_as(kind: DataType) -> str:
    """numpy type in which components travel without loss."""
    return "<f4" if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else "<f8"


def valid_vectors(rows: DataFrame) -> DataFrame:
    """The rows whose `vector` takes part: finite, and of the most frequent length."""
    rows = rows.where(finite(F.col("vector")))
    length = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("vector") == (length[0][0] if length else 0))


def numbered(rows: DataFrame, key: str, name: str) -> DataFrame:
    """The rows as a table with `row`, a number of its own for each, rising with the key (nulls first).

    Ranges are of key and vector, so rows of one key may lie in several tasks. The table
    fixes the numbers: later steps, retried tasks too, read them.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(key), F.xxhash64("vector")]
    return written(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("row", F.monotonically_increasing_id()), name)


def matrix(column, dtype: str) -> np.ndarray:
    """Rows of equal binary length as a matrix of doubles."""
    data = list(column)
    return np.frombuffer(b"".join(data), dtype).reshape(len(data), -1).astype(np.float64)


def packed(vectors, dtype: str) -> list[bytes]:
    return [np.asarray(v, dtype).tobytes() for v in vectors]


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Centroids by Lloyd's rounds; centroids that lose all rows are drawn anew."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        at = nearest(x, c)
        n = np.bincount(at, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(1, n)[:, None], x[rng.integers(len(x), size=k)])
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Index of the nearest centroid of each row."""
    half = (c * c).sum(1) / 2
    return np.concatenate([(x[i : i + 4096] @ c.T - half).argmax(1) for i in range(0, len(x), 4096)]) if len(x) else np.empty(0, np.int64)
