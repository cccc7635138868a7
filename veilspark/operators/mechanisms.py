"""Private selection over tables of scores: one candidate of each group, without collecting candidates."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.noise import keyed_gumbel, keyed_uniform

#: Different sensitivities of a table of candidates; each candidate meets one row for each.
MOST_LEVELS = 10_000


def _best(scores: DataFrame, score: str, by: Sequence[str]) -> DataFrame:
    """The rows with _top, the greatest score of their group; null scores are no candidates."""
    rows = scores.where(F.col(score).isNotNull())
    if not by:
        return rows.join(F.broadcast(rows.agg(F.max(score).alias("_top"))))  # one row
    tops = rows.groupBy(*[F.col(b).alias(f"_b{i}") for i, b in enumerate(by)]).agg(F.max(score).alias("_top"))
    return rows.join(tops, [F.col(b).eqNullSafe(F.col(f"_b{i}")) for i, b in enumerate(by)]).drop(*[f"_b{i}" for i in range(len(by))])


def _won(rows: DataFrame, columns: Sequence[str], by: Sequence[str], order: Column) -> DataFrame:
    """The first row of each group in an order."""
    first = F.min_by(F.struct(*columns), order).alias("w")
    return (rows.groupBy(*by).agg(first) if by else rows.agg(first).where("w is not null")).select("w.*")


def permute_and_flip(scores: DataFrame, key: str, score: str, epsilon: float, seed: str, sensitivity: float = 1.0, by: Sequence[str] = ()) -> DataFrame:
    """One candidate (columns of `scores`) of each group, by permute-and-flip.

    Candidates of a group come in a keyed random order, and each has a coin that falls with
    probability exp(epsilon (score - best) / (2 sensitivity)); the first whose coin falls
    wins. The best's coin always falls. Order and coins are hashes of the seed, the group
    and the key, so there is no sort: the winner is a minimum, combined on the map side.
    Keys must be distinct in a group; an empty group has no winner.
    """
    rows = _best(scores, score, by)
    chance = F.exp(epsilon * (F.col(score) - F.col("_top")) / (2 * sensitivity))
    falls = rows.where((F.col(score) == F.col("_top")) | (keyed_uniform(seed + "coin", *by, key) <= chance))
    return _won(falls, scores.columns, by, F.struct(keyed_uniform(seed + "order", *by, key), F.col(key)))


def exponential(scores: DataFrame, key: str, score: str, epsilon: float, seed: str, sensitivity: float = 1.0, by: Sequence[str] = ()) -> DataFrame:
    """One candidate of each group with probability proportional to exp(epsilon score / (2 sensitivity)): the greatest score with keyed Gumbel noise."""
    rows = scores.where(F.col(score).isNotNull())
    noisy = F.col(score) * (epsilon / (2 * sensitivity)) + keyed_gumbel(seed, 1.0, *by, key)
    return _won(rows, scores.columns, by, F.struct(-noisy, F.col(key)))


def comparable(scores: DataFrame, score: str, sensitivity: str, t: float, name: str = "scaled") -> DataFrame:
    """Adds scores of sensitivity 1 for candidates whose sensitivities differ.

    A candidate's new score is its least margin over all candidates j, with t sensitivities
    taken off either's score: min of (score - score_j - t (d - d_j)) / (d + d_j). For each
    sensitivity the best score alone decides, so candidates meet one row for each distinct
    sensitivity and never each other.
    """
    best = scores.where(F.col(score).isNotNull() & F.col(sensitivity).isNotNull()).groupBy(F.col(sensitivity).alias("d")).agg(F.max(score).alias("q"))
    if (n := best.count()) > MOST_LEVELS:
        raise ValueError(f"{n} different sensitivities, {MOST_LEVELS} at most")
    levels = best.agg(F.collect_list(F.struct("d", "q")).alias("_levels"))  # as many as checked above
    least = F.array_min(F.transform("_levels", lambda x: (F.col(score) - x["q"] - t * (F.col(sensitivity) - x["d"])) / (F.col(sensitivity) + x["d"])))
    return scores.join(F.broadcast(levels)).withColumn(name, least).drop("_levels")


def generalised_exponential(scores: DataFrame, key: str, score: str, sensitivity: str, epsilon: float, seed: str, beta: float = 0.5) -> DataFrame:
    """One candidate of a table whose candidates have sensitivities of their own: the exponential mechanism over `comparable` scores.

    `beta` bounds the chance of a candidate much worse than the best: t = 2 log(n / beta) / epsilon.
    """
    n = scores.where(F.col(score).isNotNull()).count()
    if not n:
        return scores.limit(0)
    scaled = comparable(scores, score, sensitivity, 2 * math.log(n / beta) / epsilon, "_scaled")
    return exponential(scaled, key, "_scaled", epsilon, seed).select(*scores.columns)
