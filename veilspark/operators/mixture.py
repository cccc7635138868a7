"""Mode-specific normalisation: a one-dimensional mixture of normal distributions, fitted by variational EM over distinct values.

The table is added up by value once. An iteration is one pass over the distinct values that
adds up each component's responsibilities; only these sums, three numbers a component,
come to the driver.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.noise import keyed_uniform
from ..sources.shared import Rounds

#: Components to start from; weight below which a component is no mode; deviations that make 1 of a normalised value; prior of a component's weight.
COMPONENTS, LEAST_WEIGHT, DEVIATIONS, CONCENTRATION = 10, 0.005, 4.0, 1e-3


def digamma(x: float) -> float:
    """Derivative of the logarithm of the gamma function: upwards by recurrence, then its asymptotic series."""
    out = 0.0
    while x < 10:
        out -= 1 / x
        x += 1
    y = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))


@dataclass(frozen=True)
class Component:
    """Posterior of a component: Dirichlet weight alpha, normal-gamma of mean and precision (mean, beta, shape, rate)."""

    alpha: float
    mean: float
    beta: float
    shape: float
    rate: float

    @property
    def deviation(self) -> float:
        return math.sqrt(self.rate / self.shape)

    def divergence(self, prior: Component) -> float:
        """Of the normal-gamma part from the prior's."""
        normal = prior.beta / self.beta * (1 + self.beta * self.shape / self.rate * (self.mean - prior.mean) ** 2) - 1 + math.log(self.beta / prior.beta)
        gamma = (self.shape - prior.shape) * digamma(self.shape) - math.lgamma(self.shape) + math.lgamma(prior.shape) + prior.shape * math.log(self.rate / prior.rate) + self.shape * (prior.rate - self.rate) / self.rate
        return normal / 2 + gamma


def _log_terms(components: list[Component]) -> list[tuple[float, float, float]]:
    """(constant, mean, half the expected precision) of each component's expected log density."""
    total = digamma(sum(c.alpha for c in components))
    return [(digamma(c.alpha) - total + 0.5 * (digamma(c.shape) - math.log(c.rate) - math.log(2 * math.pi) - 1 / c.beta), c.mean, 0.5 * c.shape / c.rate) for c in components]


def _densities(x: Column, components: list[Component]) -> Column:
    """Array of each component's expected log density at x."""
    terms = F.from_json(F.lit(json.dumps([{"c": c, "m": m, "h": h} for c, m, h in _log_terms(components)])), "array<struct<c: double, m: double, h: double>>")
    return F.transform(terms, lambda t: t["c"] - t["h"] * (x - t["m"]) * (x - t["m"]))


def _total(logs: Column) -> Column:
    top = F.array_max(logs)
    return top + F.log(F.aggregate(logs, F.lit(0.0), lambda s, v: s + F.exp(v - top)))


def _bound(components: list[Component], prior: Component, fit: float) -> float:
    """The variational lower bound of the log likelihood."""
    alphas, k = [c.alpha for c in components], len(components)
    weights = math.lgamma(sum(alphas)) - sum(map(math.lgamma, alphas)) - math.lgamma(k * prior.alpha) + k * math.lgamma(prior.alpha)
    weights += sum((a - prior.alpha) * (digamma(a) - digamma(sum(alphas))) for a in alphas)
    return fit - weights - sum(c.divergence(prior) for c in components)


@dataclass
class Modes:
    """Modes of a column: mean, deviation and component of each, with the bound after each iteration."""

    components: list[Component]
    modes: list[int]
    bounds: list[float]

    def transform(self, df: DataFrame, column: str, key: str, seed: str = "mode", mode: str = "mode", value: str = "value") -> DataFrame:
        """Adds a mode (from 0), drawn by its responsibility for the value from a hash of the row's key, and the value in DEVIATIONS of it; null stays null."""
        x = F.col(column).cast("double")
        if not self.modes:
            return df.withColumns({mode: F.lit(None).cast("long"), value: F.lit(None).cast("double")})
        logs = _densities(x, [self.components[i] for i in self.modes])
        upto = F.aggregate(
            F.transform("_logs", lambda v: F.exp(v - F.array_max("_logs"))), F.array().cast("array<double>"),
            lambda s, v: F.concat(s, F.array(F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(0.0)) + v)),
        )
        rows = df.withColumn("_logs", F.when(x.isNotNull(), logs)).withColumn("_upto", upto)
        u = keyed_uniform(seed, key) * F.element_at("_upto", -1)
        rows = rows.withColumn(mode, F.least(F.size(F.filter("_upto", lambda p: p <= u)), F.lit(len(self.modes) - 1)).cast("long"))
        rows = rows.withColumn(mode, F.when(x.isNotNull(), F.col(mode)))
        mean, deviation = self._of(F.col(mode))
        return rows.withColumn(value, (x - mean) / (DEVIATIONS * deviation)).drop("_logs", "_upto")

    def _of(self, mode: Column) -> tuple[Column, Column]:
        means, deviations = ([getattr(self.components[i], n) for i in self.modes] for n in ("mean", "deviation"))
        return tuple(F.get(F.from_json(F.lit(json.dumps(v)), "array<double>"), mode.cast("int")) for v in (means, deviations))

    def inverse(self, df: DataFrame, column: str, mode: str = "mode", value: str = "value") -> DataFrame:
        """The column's values from modes and normalised values; null for a mode that does not exist."""
        mean, deviation = self._of(F.col(mode))
        return df.withColumn(column, F.col(value) * DEVIATIONS * deviation + mean)


def fit_modes(df: DataFrame, column: str, components: int = COMPONENTS, rounds: int = 100, tolerance: float = 1e-3) -> Modes:
    """Modes of a numeric column.

    A sparse Dirichlet prior empties components that the values do not need; the priors of
    means and precisions are the column's mean and variance. Components start at quantiles.
    Iterations end when the bound, which never falls, rises by less than `tolerance` a row
    in a thousand. Nulls and values that are not finite take no part; a column without
    values has no modes, and a constant one a single mode of a tiny deviation.
    """
    x = F.col("x")
    tables = Rounds(df.sparkSession, "values")
    finite = df.select(F.col(column).cast("double").alias("x")).where(x.isNotNull() & ~F.isnan("x") & (F.abs("x") < float("inf")))
    values = tables(finite.groupBy("x").agg(F.count("*").alias("n")))
    whole = values.agg(F.sum("n").alias("n"), (F.sum(x * F.col("n")) / F.sum("n")).alias("mean")).first()
    if not whole["n"]:
        return Modes([], [], [])
    n, mean = whole["n"], whole["mean"]
    variance = max(values.agg(F.sum(F.col("n") * (x - mean) * (x - mean))).first()[0] / n, 1e-12 * max(1.0, mean * mean))
    starts = finite.agg(F.percentile_approx("x", [(i + 0.5) / components for i in range(components)], 10_000)).first()[0]
    prior = Component(CONCENTRATION, mean, 0.01, 0.5, variance / 2)
    each = n / components
    now = [Component(each, s, each, max(each / 2, 0.5), max(each / 2, 0.5) * variance / components**2) for s in starts]
    found: list[float] = []
    for _ in range(rounds):
        rows = values.withColumn("l", _densities(x, now)).withColumn("t", _total(F.col("l")))
        rows = rows.withColumn("r", F.transform("l", lambda v: F.exp(v - F.col("t")) * F.col("n")))
        shares = [F.element_at("r", i + 1) for i in range(components)]
        off = [x - c.mean for c in now]  # sums about the last means keep their digits
        sums = rows.agg(F.sum(F.col("n") * F.col("t")), *[F.sum(s * p) for s, o in zip(shares, off, strict=True) for p in (F.lit(1.0), o, o * o)]).first()
        found.append(_bound(now, prior, sums[0]))
        if len(found) > 1 and found[-1] - found[-2] < tolerance * n / 1000:
            break
        after = []
        for i, c in enumerate(now):
            weight, first, second = sums[1 + 3 * i : 4 + 3 * i]
            centre = c.mean + (first / weight if weight > 0 else 0.0)
            scatter = max(0.0, second - first * first / weight) if weight > 0 else 0.0
            beta = prior.beta + weight
            rate = prior.rate + 0.5 * (scatter + prior.beta * weight / beta * (centre - prior.mean) ** 2)
            after.append(Component(prior.alpha + weight, (prior.beta * prior.mean + weight * centre) / beta, beta, prior.shape + weight / 2, rate))
        now = after
    tables.only()
    total = sum(c.alpha for c in now)
    return Modes(now, [i for i, c in enumerate(now) if c.alpha / total > LEAST_WEIGHT], found)
