"""Private selection and integer allocation."""

from __future__ import annotations

import math
import random
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.noise import keyed_gumbel
from ..functions.ranks import running
from ..plans.domain import Clique, Domain


def top_noisy(scores: DataFrame, key: str, score: str, q: int, scale: float, seed: str, answered: DataFrame | None = None) -> DataFrame:
    """The q candidates of greatest score plus Gumbel noise; those answered before take no part."""
    if answered is not None:
        scores = scores.join(answered.select(key), key, "left_anti")
    return scores.withColumn("noisy", F.col(score) + keyed_gumbel(seed, scale, key)).orderBy(F.desc("noisy"), key).limit(q)


def exponential_mechanism(scores: Mapping, epsilon: float, sensitivity: float = 1.0, base: Mapping | None = None, rng: random.Random | None = None):
    """One key with probability proportional to base * exp(epsilon * score / (2 * sensitivity)).

    Candidates are few (cliques), so this runs on the driver; randomness is the system's unless given.
    """
    rng = rng or random.SystemRandom()
    logs = {k: epsilon * s / (2 * sensitivity) + (math.log(base[k]) if base else 0.0) for k, s in scores.items()}
    return max(logs, key=lambda k: logs[k] - math.log(-math.log(1 - rng.random() * (1 - 2**-53) - 2**-54)))


def proportional(df: DataFrame, n: int, weight: str, *order: str) -> DataFrame:
    """Adds `take`: integers that follow the weights and add up to n, by rounding running shares."""
    out, total = running(df, order, [weight])
    edge = lambda upto: F.bround(upto / F.lit(total[weight]) * n).cast("long")
    before = F.col(f"_before_{weight}")
    return out.withColumn("take", edge(before + F.col(weight)) - edge(before)).select(*df.columns, "take")


def largest_remainder(df: DataFrame, n: int, weight: str, key: str) -> DataFrame:
    """Adds `take`: floors of the exact shares of n, the rest to the largest fractions (ties: smaller key)."""
    exact = F.col(weight) * n / F.lit(df.agg(F.sum(weight)).first()[0])
    out = df.withColumn("_exact", exact).withColumn("_floor", F.floor("_exact").cast("long"))
    out, total = running(out, [F.desc(F.round(F.col("_exact") - F.col("_floor"), 9)), key], ["_floor"])
    return out.withColumn("take", F.col("_floor") + (F.col("_rank") < n - total["_floor"]).cast("long")).select(*df.columns, "take")


def pareto(points: Mapping[object, tuple[float, float]]) -> list:
    """Keys that no other beats in both coordinates (cost down, gain up)."""
    best, out = -math.inf, []
    for key, (cost, gain) in sorted(points.items(), key=lambda x: (x[1][0], -x[1][1])):
        if gain > best:
            best = gain
            out.append(key)
    return out


def choose_pairs(indif: Mapping[Clique, float], domain: Domain, total: float, rho: float) -> list[Clique]:
    """Greedy choice of two-way marginals: each step takes the pair that most lowers noise error of the chosen plus dependence error of the rest, until none does."""
    noise = lambda chosen: math.sqrt(1 / (math.pi * rho)) * sum(domain.size(c) ** (2 / 3) for c in chosen) ** 1.5 if chosen else 0.0
    chosen: list[Clique] = []
    error = sum(indif.values())
    while True:
        options = [(noise([*chosen, c]) + sum(v for k, v in indif.items() if k not in chosen and k != c), c) for c in indif if c not in chosen]
        if not options or min(options)[0] >= error:
            return chosen
        error, best = min(options)
        chosen.append(best)


def spanning_tree(weights: Mapping[Clique, float], attrs: Sequence[str], rho: float | None = None, rng: random.Random | None = None) -> list[Clique]:
    """Maximum spanning tree over attribute pairs; with rho each edge is chosen by the exponential mechanism (zCDP)."""
    part = {a: a for a in attrs}

    def root(a: str) -> str:
        while part[a] != a:
            a = part[a]
        return a

    tree: list[Clique] = []
    epsilon = math.sqrt(8 * rho / max(1, len(attrs) - 1)) if rho else None
    while options := {e: w for e, w in weights.items() if root(e[0]) != root(e[1])}:
        edge = exponential_mechanism(options, epsilon, rng=rng) if epsilon else max(options, key=lambda e: (options[e], e))
        part[root(edge[0])] = root(edge[1])
        tree.append(edge)
    return tree


def top_above(scores: DataFrame, key: str, score: str, q: int, least: float) -> DataFrame:
    """At most q candidates of greatest score, of those at or above `least`; ties to the smaller key."""
    return scores.where(F.col(score) >= least).orderBy(F.desc(score), key).limit(q)


def combined(cliques: Sequence[Clique], domain: Domain, cells: int = 5000) -> list[Clique]:
    """Cliques merged, smallest union first, while a union that shares attributes stays within `cells` cells; none lies inside another."""
    out = [tuple(a for a in domain if a in c) for c in dict.fromkeys(map(frozenset, cliques))]
    while True:
        unions = [(domain.size(u), i, j, u) for i, x in enumerate(out) for j, y in enumerate(out[:i]) if set(x) & set(y) for u in [tuple(a for a in domain if a in x or a in y)]]
        size, i, j, union = min(unions, default=(math.inf, 0, 0, ()))
        if size > cells and not any(set(u) in (set(out[a]), set(out[b])) for _, a, b, u in unions):
            return out
        if size > cells:
            _, i, j, union = next(x for x in unions if set(x[3]) in (set(out[x[1]]), set(out[x[2]])))
        out = [c for k, c in enumerate(out) if k not in (i, j)] + [union]


def isolated(domain: Domain, cliques: Sequence[Clique]) -> list[str]:
    """Attributes that no clique holds; they are measured alone."""
    return [a for a in domain if not any(a in c for c in cliques)]
