"""Data-dependent bins under differential privacy: PrivTree splitting and DAWA's dynamic programme.

Spark counts a fine public histogram; the bins are chosen on the driver from that bounded table.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encode import uniform_bin


def fine_histogram(df: DataFrame, column: str, lo: float, hi: float, bins: int) -> np.ndarray:
    """Counts of equal-width bins over public bounds; values outside count in the end bins."""
    x = F.least(F.greatest(F.col(column).cast("double"), F.lit(lo)), F.lit(hi))
    out = np.zeros(bins)
    for r in df.where(F.col(column).isNotNull()).groupBy(uniform_bin(x, lo, hi, bins).alias("b")).count().collect():
        out[r["b"]] = r["count"]
    return out


def privtree(counts: np.ndarray, epsilon: float, theta: float = 0.0, rng: np.random.Generator | None = None) -> list[int]:
    """Edges (bin numbers, last one excluded) of a private binary splitting of a histogram whose size is a power of two.

    A node splits while its count, less decay for each level of depth, plus Laplace noise
    is above theta; the noise does not grow with the number of levels.
    """
    rng = rng or np.random.default_rng()
    scale = 3.0 / epsilon  # (2 * fanout - 1) / (fanout - 1) for fanout 2
    decay = scale * math.log(2)
    upto = np.concatenate([[0], np.cumsum(counts)])
    edges, todo = [], [(0, len(counts), 0)]
    while todo:
        a, b, depth = todo.pop()
        score = max(theta - decay, upto[b] - upto[a] - depth * decay)
        if b - a > 1 and score + rng.laplace(0, scale) > theta:
            mid = (a + b) // 2
            todo += [(mid, b, depth + 1), (a, mid, depth + 1)]
        else:
            edges.append(a)
    return sorted(edges)


def dawa(counts: np.ndarray, epsilon: float, ratio: float = 0.25, rng: np.random.Generator | None = None) -> list[int]:
    """Start of each bucket of the least-cost partition into buckets of power-of-two length.

    A bucket costs its noisy deviation from uniformity plus the noise of one count.
    """
    rng = rng or np.random.default_rng()
    first, second = epsilon * ratio, epsilon * (1 - ratio)
    n = len(counts)
    cost: dict[tuple[int, int], float] = {}
    size = 1
    while size <= n:
        for a in range(0, n - size + 1):
            x = counts[a : a + size]
            noisy = np.abs(x - x.mean()).sum() + (rng.laplace(0, 2 * math.log2(max(2, n)) / first) if size > 1 else 0.0)
            cost[a, a + size] = max(0.0, noisy) + 1 / second
        size *= 2
    best, back = [0.0] + [math.inf] * n, [0] * (n + 1)
    for b in range(1, n + 1):
        size = 1
        while size <= b:
            if best[b - size] + cost[b - size, b] < best[b]:
                best[b], back[b] = best[b - size] + cost[b - size, b], b - size
            size *= 2
    starts, b = [], n
    while b:
        b = back[b]
        starts.append(b)
    return sorted(starts)
