"""Filtering of public rows by kernel distance to a private mean embedding.

Rows of each block are dropped one at a time while that brings the block's mean embedding
closer to the private one. A block is bounded, so the blocks are tasks of bounded size, and
a dropped candidate changes the block's sum by one vector: a step costs one number a row.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.noise import keyed_gaussian
from .features import doubles, inner

#: Rows of a block, in expectation.
BLOCK = 256


def embedded(vector: Column, frequencies: Sequence[Sequence[float]], label: Column | None = None, labels: Sequence[object] = ()) -> Column:
    """Random Fourier features of a vector, in one slot for each label: an array of 2 x frequencies x labels numbers.

    The square distance of two means of such arrays is the estimated maximum mean
    discrepancy of the joint distribution of vectors and labels.
    """
    v, scale = doubles(vector), math.sqrt(1 / len(frequencies))
    turns = F.transform(F.array(*[F.array(*map(F.lit, map(float, w))) for w in frequencies]), lambda w: inner(v, w))
    waves = F.concat(F.transform(turns, lambda t: scale * F.cos(t)), F.transform(turns, lambda t: scale * F.sin(t)))
    if label is None:
        return waves
    return F.flatten(F.array(*[F.when(label == x, waves).otherwise(F.transform(waves, lambda _: F.lit(0.0))) for x in labels]))


def mean_embedding(df: DataFrame, features: Column, sigma: float = 0.0, seed: str = "embedding") -> np.ndarray:
    """The mean of an array column over all rows, with keyed Gaussian noise of deviation sigma in each entry; rows whose array is null or holds a null do not count."""
    rows = df.select(features.alias("f")).where("f is not null and not exists(f, x -> x is null)")
    means = rows.select(F.posexplode("f").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("x"))
    means = means.select("i", F.col("x") + (keyed_gaussian(seed, sigma, "i") if sigma else F.lit(0.0)).alias("x"))
    return np.array([r[1] for r in sorted(means.collect())])  # as many numbers as an embedding has


def greedy(x: np.ndarray, target: np.ndarray, patience: float) -> tuple[np.ndarray, list[float]]:
    """(the step at which each row of a block is dropped, from 1, 0 for kept rows; the square distance before each step and at the end).

    A step drops the row whose loss brings the mean closest to the target (ties to the
    first), if the distance falls by more than `patience` times its mean share a row. The
    last row stays.
    """
    n = len(x)
    dropped, alive = np.zeros(n, np.int64), np.ones(n, bool)
    gram, at_target, t2 = x @ x.T, x @ target, float(target @ target)
    own = gram.diagonal()
    with_sum = gram.sum(1)
    sum2, sum_t = float(gram.sum()), float(at_target.sum())
    distances = [max(0.0, sum2 / n**2 - 2 * sum_t / n + t2)]
    for step in range(1, n):
        m = n - step
        trial = (sum2 - 2 * with_sum + own) / m**2 - 2 * (sum_t - at_target) / m + t2
        best = int(np.argmin(np.where(alive, trial, np.inf)))
        now = distances[-1]
        if now - trial[best] <= patience * now / (m + 1) or trial[best] >= now:
            break
        distances.append(max(0.0, float(trial[best])))
        sum2 += float(own[best] - 2 * with_sum[best])
        sum_t -= float(at_target[best])
        with_sum = with_sum - gram[best]
        alive[best], dropped[best] = False, step
    return dropped, distances


def filtered(public: DataFrame, key: str, features: Column, target: np.ndarray, patience: float = 0.0, block: int = BLOCK, seed: int = 0) -> DataFrame:
    """key, block, kept, step, before, after: one row for each row of `public`.

    Rows are dealt to blocks by a hash of key and embedding; `before` and `after` are the
    block's square distances to `target`, `step` says when a row was dropped (null if it
    is kept). Rows whose embedding is null or holds a null are not kept and belong to no
    block. Keys may repeat or be null; rows equal in both share a block, so a block is
    bounded as long as equal rows are. A task holds one block: rows x embedding and rows x
    rows numbers. An empty table gives an empty result.
    """
    rows = public.select(F.col(key).alias("key"), features.alias("f")).withColumn("fit", F.expr("f is not null and not exists(f, x -> x is null)"))
    n = rows.where("fit").count()
    number = F.pmod(F.xxhash64("key", "f", F.lit(seed)), F.lit(max(1, math.ceil(n / block))))
    kind = rows.schema["key"].dataType.simpleString()
    schema = f"key {kind}, block long, kept boolean, step long, before double, after double"

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.assign(_order=[np.asarray(f).tobytes() for f in frame["f"]]).sort_values(["key", "_order"], na_position="first")
        step, distances = greedy(np.stack([np.asarray(f, float) for f in frame["f"]]), target, patience)
        return pd.DataFrame({"key": frame["key"].to_numpy(), "block": frame["block"].to_numpy(), "kept": step == 0, "step": pd.array(np.where(step > 0, step, -1), "Int64").astype("Int64"), "before": distances[0], "after": distances[-1]}).assign(step=lambda d: d["step"].where(d["step"] > 0))

    fit = rows.where("fit").select("key", "f", number.alias("block")).groupBy("block").applyInPandas(run, schema)
    rest = rows.where("not fit").select("key", F.lit(None).cast("long").alias("block"), F.lit(False).alias("kept"), F.lit(None).cast("long").alias("step"), F.lit(None).cast("double").alias("before"), F.lit(None).cast("double").alias("after"))
    return fit.unionByName(rest).withColumnRenamed("key", key)


def evolved(public: DataFrame, key: str, features: Column, target: np.ndarray, block: int = BLOCK, generations: int = 200, population: int = 16, seed: int = 0) -> DataFrame:
    """key, block, kept, before, after: like `filtered`, by an evolutionary search over the blocks' subsets.

    A population of subsets, the whole block among them, is varied by flipping rows and by
    crossing two parents; the fittest are carried on, so a block's distance never rises. All
    draws come from the block's number and the seed, so a retried task finds the same subset.
    """
    rows = public.select(F.col(key).alias("key"), features.alias("f")).where("f is not null and not exists(f, x -> x is null)")
    n = rows.count()
    number = F.pmod(F.xxhash64("key", "f", F.lit(seed)), F.lit(max(1, math.ceil(n / block))))
    kind = rows.schema["key"].dataType.simpleString()

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.assign(_order=[np.asarray(f).tobytes() for f in frame["f"]]).sort_values(["key", "_order"], na_position="first")
        x = np.stack([np.asarray(f, float) for f in frame["f"]])
        rng = np.random.default_rng([seed, int(frame["block"].iloc[0])])
        kept, before, after = evolve(x, target, generations, population, rng)
        return pd.DataFrame({"key": frame["key"].to_numpy(), "block": frame["block"].to_numpy(), "kept": kept, "before": before, "after": after})

    out = rows.select("key", "f", number.alias("block")).groupBy("block").applyInPandas(run, f"key {kind}, block long, kept boolean, before double, after double")
    return out.withColumnRenamed("key", key)


def evolve(x: np.ndarray, target: np.ndarray, generations: int, population: int, rng: np.random.Generator) -> tuple[np.ndarray, float, float]:
    """(the fittest subset found, the square distance of all rows, that of the subset)."""
    n = len(x)

    def distance(sets: np.ndarray) -> np.ndarray:
        size = sets.sum(1)
        off = sets @ x / np.maximum(size, 1)[:, None] - target
        return np.where(size > 0, (off * off).sum(1), np.inf)

    sets = np.concatenate([np.ones((1, n), bool), rng.random((population - 1, n)) < 0.8])
    fit = distance(sets)
    before = float(fit[0])
    for _ in range(generations):
        a, b = sets[rng.integers(len(sets), size=population)], sets[rng.integers(len(sets), size=population)]
        children = np.where(rng.random((population, n)) < 0.5, a, b) ^ (rng.random((population, n)) < 1.5 / n)
        every, every_fit = np.concatenate([sets, children]), np.concatenate([fit, distance(children)])
        best = np.argsort(every_fit, kind="stable")[:population]
        sets, fit = every[best], every_fit[best]
    return sets[0], before, float(fit[0])
