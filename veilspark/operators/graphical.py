"""Graphical models over measured marginals: junction tree, belief propagation, mirror descent.

Only aggregated tables come here, a few megabytes at most; rows are counted and sampled by Spark.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np

from ..plans.domain import Clique, Domain, maximal

#: Megabyte limit on the cliques of a model, as 8-byte cells.
MODEL_MB = 80.0


def logsumexp(x: np.ndarray, axes: tuple[int, ...]) -> np.ndarray:
    if not axes:
        return x
    top = x.max(axis=axes, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - top).sum(axis=axes)) + np.squeeze(top, axes)


@dataclass
class Factor:
    """Log values over named axes."""

    attrs: Clique
    values: np.ndarray

    def onto(self, attrs: Clique) -> np.ndarray:
        """Values laid out for broadcasting over `attrs`, which hold all of the factor's."""
        order = sorted(range(len(self.attrs)), key=lambda i: attrs.index(self.attrs[i]))
        shape = [self.values.shape[self.attrs.index(a)] if a in self.attrs else 1 for a in attrs]
        return np.transpose(self.values, order).reshape(shape)

    def __mul__(self, other: Factor) -> Factor:
        attrs = self.attrs + tuple(a for a in other.attrs if a not in self.attrs)
        return Factor(attrs, self.onto(attrs) + other.onto(attrs))

    def project(self, attrs: Iterable[str]) -> Factor:
        """Sums the other axes out."""
        attrs = tuple(attrs)
        axes = tuple(i for i, a in enumerate(self.attrs) if a not in attrs)
        kept = tuple(a for a in self.attrs if a in attrs)
        return Factor(attrs, np.transpose(logsumexp(self.values, axes), [kept.index(a) for a in attrs]))


def elimination(domain: Domain, cliques: Iterable[Clique]) -> tuple[list[str], list[Clique]]:
    """(attributes in the order in which they go, cliques of the triangulated graph); each step takes the attribute of the smallest clique."""
    near: dict[str, set[str]] = {a: set() for a in domain}
    for c in cliques:
        for a, b in combinations(c, 2):
            near[a].add(b)
            near[b].add(a)
    order, found = [], []
    while near:
        a = min(near, key=lambda x: (domain.size([x, *near[x]]), x))
        around = near.pop(a)
        order.append(a)
        found.append(domain.canonical([a, *around]))
        for x, y in combinations(around, 2):
            near[x].add(y)
            near[y].add(x)
        for x in around:
            near[x].discard(a)
    return order, maximal(found)


def junction_tree(domain: Domain, cliques: Iterable[Clique]) -> tuple[list[Clique], list[tuple[Clique, Clique]]]:
    """Maximal cliques and tree edges of greatest total separator size (Prim); unconnected parts join over empty separators."""
    _, nodes = elimination(domain, cliques)
    inside, edges = [nodes[0]], []
    while len(inside) < len(nodes):
        a, b = max(((x, y) for x in inside for y in nodes if y not in inside), key=lambda e: (len(set(e[0]) & set(e[1])), -domain.size(e[1])))
        edges.append((a, b))
        inside.append(b)
    return nodes, edges


def model_mb(domain: Domain, cliques: Iterable[Clique]) -> float:
    return sum(domain.size(c) for c in junction_tree(domain, cliques)[0]) * 8 / 2**20


@dataclass
class Measurement:
    """Noisy counts of a clique, with their noise's deviation."""

    clique: Clique
    counts: np.ndarray
    sigma: float


class TreeModel:
    """A distribution that factors over a junction tree."""

    def __init__(self, domain: Domain, cliques: Iterable[Clique], total: float):
        self.domain, self.total = domain, max(1.0, total)
        self.nodes, self.edges = junction_tree(domain, cliques)
        self.potentials = {c: np.zeros(domain.project(c).shape) for c in self.nodes}
        self.marginals = self.propagate(self.potentials)

    def propagate(self, potentials: Mapping[Clique, np.ndarray]) -> dict[Clique, np.ndarray]:
        """Counts of every node by two sweeps of messages in log space."""
        belief = {c: Factor(c, p) for c, p in potentials.items()}
        messages: dict[tuple[Clique, Clique], Factor] = {}
        inward = [(b, a) for a, b in reversed(self.edges)]
        for a, b in inward + self.edges:
            shared = tuple(x for x in a if x in b)
            out = belief[a]
            if (b, a) in messages:
                out = Factor(a, out.values - messages[b, a].onto(a))
            messages[a, b] = out.project(shared)
            belief[b] = Factor(b, belief[b].values + messages[a, b].onto(b))
        out = {}
        for c, f in belief.items():
            with np.errstate(invalid="ignore"):
                out[c] = np.exp(f.values - logsumexp(f.values, tuple(range(f.values.ndim)))) * self.total
        return out

    def holder(self, attrs: Iterable[str]) -> Clique | None:
        wanted = set(attrs)
        return min((c for c in self.nodes if wanted <= set(c)), key=self.domain.size, default=None)

    def project(self, attrs: Sequence[str]) -> np.ndarray:
        """Counts of any attribute set; outside the tree's cliques by eliminating the rest."""
        attrs = tuple(attrs)
        with np.errstate(divide="ignore"):
            if home := self.holder(attrs):
                return np.exp(Factor(home, np.log(self.marginals[home])).project(attrs).values)
            factors = [Factor(c, p) for c, p in self.potentials.items()]
        order, _ = elimination(self.domain, [*self.nodes, attrs])
        for a in (x for x in order if x not in attrs):
            mine = [f for f in factors if a in f.attrs]
            joint = mine[0]
            for f in mine[1:]:
                joint = joint * f
            factors = [f for f in factors if a not in f.attrs] + [joint.project(x for x in joint.attrs if x != a)]
        joint = factors[0]
        for f in factors[1:]:
            joint = joint * f
        values = joint.project(attrs).values
        return np.exp(values - logsumexp(values, tuple(range(values.ndim)))) * self.total


def total_of(measurements: Iterable[Measurement]) -> float:
    """The measurements' sums weighted by inverse variance, 1 at least."""
    parts = [(m.counts.sum(), 1 / (m.sigma**2 * m.counts.size)) for m in measurements]
    return max(1.0, sum(t * w for t, w in parts) / sum(w for _, w in parts)) if parts else 1.0


def merged_by_clique(measurements: Iterable[Measurement]) -> tuple[list[Measurement], float]:
    """(one measurement for each clique, its measurements weighted by inverse variance; what they differ from it, half the squares in units of their noise).

    The squared error of a clique's measurements is that of their mean and this constant, so
    a fit does not work the more the more often a marginal was measured.
    """
    same: dict[Clique, list[Measurement]] = {}
    for m in measurements:
        same.setdefault(m.clique, []).append(m)
    out, spread = [], 0.0
    for clique, ms in same.items():
        weight = sum(m.sigma**-2 for m in ms)
        mean = sum(m.counts * m.sigma**-2 for m in ms) / weight if len(ms) > 1 else ms[0].counts
        spread += sum(0.5 * float((((m.counts - mean) / m.sigma) ** 2).sum()) for m in ms)
        out.append(Measurement(clique, mean, weight**-0.5 if len(ms) > 1 else ms[0].sigma))
    return out, spread


def fit(domain: Domain, measurements: Sequence[Measurement], rounds: int = 300, model: TreeModel | None = None) -> TreeModel:
    """Mirror descent on the squared error of all measurements in units of their noise, with Armijo steps."""
    out = TreeModel(domain, [m.clique for m in measurements], total_of(measurements))
    if model and set(model.nodes) == set(out.nodes):
        out.potentials = model.potentials
        out.marginals = out.propagate(out.potentials)
    merged, spread = merged_by_clique(measurements)
    homes = [out.holder(m.clique) for m in merged]

    def loss(marginals: Mapping[Clique, np.ndarray]) -> tuple[float, dict[Clique, np.ndarray]]:
        value, slope = spread, {c: np.zeros_like(p) for c, p in marginals.items()}
        for m, home in zip(merged, homes, strict=True):
            axes = tuple(i for i, a in enumerate(home) if a not in m.clique)
            kept = tuple(a for a in home if a in m.clique)
            view = np.transpose(marginals[home].sum(axes), [kept.index(a) for a in m.clique])
            off = (view - m.counts) / m.sigma
            value += 0.5 * float((off**2).sum())
            slope[home] += Factor(m.clique, off / m.sigma).onto(home)
        return value, slope

    value, slope = loss(out.marginals)
    step = 1.0 / out.total
    for _ in range(rounds):
        step *= 2
        for _ in range(30):
            trial = {c: p - step * slope[c] for c, p in out.potentials.items()}
            marginals = out.propagate(trial)
            new, new_slope = loss(marginals)
            gain = sum(float((slope[c] * (out.marginals[c] - marginals[c])).sum()) for c in marginals)
            if value - new >= 0.5 * gain:
                break
            step /= 2
        else:
            break
        done = value - new < 1e-7 * max(1.0, value)
        out.potentials, out.marginals, value, slope = trial, marginals, new, new_slope
        if done:
            break
    return out
