"""Synthetic tables: measure marginals with Spark, fit a graphical model, sample rows with Spark."""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.budget import Ledger
from ..functions.noise import gaussian_sigma
from ..functions.tables import at_most, looked_up
from ..plans.domain import Clique, Domain, all_cliques, score_workload
from .graphical import MODEL_MB, Measurement, TreeModel, elimination, fit, model_mb
from .marginal import clique_name, marginals
from .selection import exponential_mechanism, spanning_tree


def datavectors(df: DataFrame, domain: Domain, cliques: Sequence[Clique]) -> dict[Clique, np.ndarray]:
    """Exact counts of all cliques from one pass, as dense arrays over the public domain; a code outside it does not count for its cliques."""
    out = {c: np.zeros(domain.project(c).shape) for c in cliques}
    by_name = {clique_name(c): c for c in cliques}
    inside = [F.when(F.col(a).between(0, domain[a] - 1), F.col(a)).alias(a) for a in dict.fromkeys(a for c in cliques for a in c)]
    for r in marginals(df.select(*inside), list(cliques)).toLocalIterator():
        c = by_name[r["clique"]]
        out[c][tuple(r[f"k{i + 1}"] for i in range(len(c)))] = r["n"]
    return out


class Measurer:
    """Exact answers computed once; every noisy release draws fresh noise once and is charged."""

    def __init__(self, answers: Mapping[Clique, np.ndarray], ledger: Ledger, rng: np.random.Generator | None = None):
        self.answers, self.ledger, self.rng = answers, ledger, rng or np.random.default_rng()

    def __call__(self, clique: Clique, rho: float) -> Measurement:
        self.ledger.charge(clique_name(clique), rho)
        sigma = gaussian_sigma(rho)
        exact = self.answers[clique]
        return Measurement(clique, exact + self.rng.normal(0, sigma, exact.shape), sigma)


def aim(df: DataFrame, domain: Domain, workload: Mapping[Clique, float], rho: float, most_mb: float = MODEL_MB, rounds: int | None = None, fit_rounds: int = 60, rng: np.random.Generator | None = None) -> tuple[TreeModel, Ledger]:
    """Adaptive and iterative measurement of the workload's closure under rho-zCDP.

    One-way marginals first; then each round picks, by the exponential mechanism, the clique
    whose model answer is worst beyond what noise explains, among those that keep the model
    small; measures it; refits; and doubles the round's budget when a measurement moved
    the model less than its noise. The last round spends what is left.
    """
    scores = score_workload(workload)
    answers = datavectors(df, domain, list(scores))
    ledger = Ledger(rho)
    measure = Measurer(answers, ledger, rng)
    chance = _Random(measure.rng)
    rounds = rounds or 16 * len(domain)
    share = rho / (rounds + len(domain))
    found = [measure((a,), 0.9 * share) for a in domain if (a,) in scores]
    model = fit(domain, found, fit_rounds)
    while ledger.left > 1e-9 * rho:
        if ledger.left < 2 * share:
            share = ledger.left
        measuring, choosing = 0.9 * share, 0.1 * share
        sigma = gaussian_sigma(measuring)
        used = [m.clique for m in found]
        allowed = [c for c in scores if model.holder(c) or model_mb(domain, [*used, c]) <= most_mb * max(0.05, 1 - ledger.left / rho)]
        bias = math.sqrt(2 / math.pi) * sigma
        worth = {c: scores[c] * (np.abs(answers[c] - model.project(c)).sum() - bias * domain.size(c)) for c in allowed}
        ledger.charge("selection", choosing)
        best = exponential_mechanism(worth, math.sqrt(8 * choosing), max(scores[c] for c in allowed), rng=chance)
        before = model.project(best)
        found.append(measure(best, min(measuring, ledger.left)))
        model = fit(domain, found, fit_rounds, model)
        if np.abs(model.project(best) - before).sum() <= bias * domain.size(best):
            share *= 4
    return fit(domain, found, 4 * fit_rounds, model), ledger


def adaptive(df: DataFrame, domain: Domain, rho: float, most_mb: float = MODEL_MB, rounds: int | None = None, fit_rounds: int = 60, enhance: float | None = None, rng: np.random.Generator | None = None) -> tuple[TreeModel, Ledger, dict[Clique, int]]:
    """(model, ledger, how often each two-way marginal was measured) by adaptive selection with doubling, under rho-zCDP.

    One-way marginals first. Each round scores every two-way marginal by twice its L1 error
    in the model, less sqrt(1 / (pi rho)) a cell, what noise of the round's budget explains;
    draws one by the exponential mechanism; measures it, again if it was measured before;
    and fits with the newest measurement's weight times `enhance` (the number of attributes),
    which then falls back. Where a marginal measured for the first time moves the model by
    less than its noise, the budgets of both steps double, so later measurements weigh
    more. The last round spends exactly what is left. Answers are counted by Spark once.
    """
    pairs = all_cliques(domain, 2)
    answers = datavectors(df, domain, [*((a,) for a in domain), *pairs])
    ledger = Ledger(rho)
    measure = Measurer(answers, ledger, rng)
    chance = _Random(measure.rng)
    rounds = rounds or 16 * len(domain)
    share = rho / (rounds + len(domain))
    enhance = enhance or float(len(domain))
    found = [measure((a,), 0.9 * share) for a in domain]
    times: dict[Clique, int] = {}
    model = fit(domain, found, fit_rounds)
    while ledger.left > 1e-9 * rho:
        if ledger.left < 2 * share:
            share = ledger.left
        measuring, choosing = 0.9 * share, 0.1 * share
        bias = math.sqrt(1 / (math.pi * measuring))
        used = [m.clique for m in found]
        allowed = [c for c in pairs if model.holder(c) or model_mb(domain, [*used, c]) <= most_mb]
        worth = {c: 2 * (np.abs(answers[c] - model.project(c)).sum() - bias * domain.size(c)) for c in allowed}
        ledger.charge("selection", choosing)
        best = exponential_mechanism(worth, math.sqrt(8 * choosing), 2.0, rng=chance)
        times[best] = times.get(best, 0) + 1
        before, newest = model.project(best), measure(best, min(measuring, ledger.left))
        model = fit(domain, [*found, Measurement(newest.clique, newest.counts, newest.sigma / math.sqrt(enhance))], fit_rounds, model)
        found.append(newest)
        if times[best] == 1 and np.abs(model.project(best) - before).sum() < bias * domain.size(best):
            share *= 2
    return fit(domain, found, 4 * fit_rounds, model), ledger, times


class _Random:
    """random() of a numpy generator, for the selection functions."""

    def __init__(self, rng: np.random.Generator):
        self.random = lambda: float(rng.random())


def mst(df: DataFrame, domain: Domain, rho: float, rng: np.random.Generator | None = None) -> tuple[TreeModel, Ledger]:
    """One-way marginals, a private maximum spanning tree of two-way dependence, its two-way marginals; a third of rho each."""
    pairs = all_cliques(domain, 2)
    answers = datavectors(df, domain, [*((a,) for a in domain), *pairs])
    ledger = Ledger(rho)
    measure = Measurer(answers, ledger, rng)
    found = [measure((a,), rho / 3 / len(domain)) for a in domain]
    model = fit(domain, found, 100)
    weights = {c: float(np.abs(answers[c] - model.project(c)).sum()) for c in pairs}
    ledger.charge("tree", rho / 3)
    for edge in spanning_tree(weights, domain.attrs, rho / 3, _Random(measure.rng)):
        found.append(measure(edge, min(ledger.left, rho / 3 / max(1, len(domain) - 1))))
    return fit(domain, found, 300), ledger


def sample(spark: SparkSession, model: TreeModel, rows: int, seed: str = "rows") -> DataFrame:
    """`rows` synthetic rows: each attribute in turn from its conditional distribution given its clique.

    The conditionals are cumulative arrays, one for each combination of parents, looked up
    by the parents' mixed-radix code: literals, so that rows never move; a model beyond
    that size is broadcast or, beyond a checked bound, joined (see functions/tables.py). A
    row's draw is a hash of its id, the attribute and the seed, so a retried task draws alike.
    """
    domain = model.domain
    order, _ = elimination(domain, model.nodes)
    out, done = spark.range(rows).withColumnRenamed("id", "row_id"), []
    for a in reversed(order):
        home = max((c for c in model.nodes if a in c), key=lambda c: (len(set(c) & set(done)), -domain.size(c)))
        parents = tuple(x for x in home if x in done)
        table = model.project((*parents, a))
        mass = table.sum(-1, keepdims=True)
        share = np.where(mass > 0, table / np.where(mass > 0, mass, 1), 1 / table.shape[-1])
        upto = np.minimum(np.cumsum(share, -1), 1.0)[..., :-1].reshape(mass.size, -1)  # the last code takes the rest
        u = (F.pmod(F.xxhash64("row_id", F.lit(a), F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
        cell = F.lit(0).cast("long")
        for p in parents:
            cell = cell * domain[p] + F.col(p)
        out = looked_up(out, cell, upto, "_cdf").withColumn(a, at_most(F.col("_cdf"), upto.shape[-1], u).cast("long")).drop("_cdf")
        done.append(a)
    return out.select("row_id", *domain.attrs)


def workload_error(answers: Mapping[Clique, np.ndarray], model: TreeModel) -> dict[Clique, float]:
    """L1 error of each clique's counts as a share of the total."""
    return {c: float(np.abs(x - model.project(c)).sum() / max(1.0, x.sum())) for c, x in answers.items()}


def two_way_workload(domain: Domain, most_cells: int = 250_000) -> dict[Clique, float]:
    return dict.fromkeys(all_cliques(domain, 2, most_cells), 1.0)


def names(cliques: Iterable[Clique]) -> list[str]:
    return [clique_name(c) for c in cliques]
