"""Implicit matrices of linear queries over a histogram: products, Gram matrices, sensitivities.

They describe workloads and strategies on the driver; the histograms that they act on are counted by Spark.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np


class Workload:
    """A matrix of queries x cells. Small parts are explicit; Kronecker products never are."""

    shape: tuple[int, int]

    def matrix(self) -> np.ndarray:
        raise NotImplementedError

    def answer(self, counts: np.ndarray) -> np.ndarray:
        return self.matrix() @ counts

    def gram(self) -> np.ndarray:
        m = self.matrix()
        return m.T @ m

    def l1(self) -> float:
        """Greatest change of all answers together by one row."""
        return float(np.abs(self.matrix()).sum(0).max())

    def l2(self) -> float:
        return float(np.sqrt(np.diag(self.gram()).max()))


@dataclass
class Explicit(Workload):
    values: np.ndarray

    @property
    def shape(self):
        return self.values.shape

    def matrix(self):
        return self.values


class Identity(Explicit):
    def __init__(self, n: int):
        super().__init__(np.eye(n))


class Total(Explicit):
    def __init__(self, n: int):
        super().__init__(np.ones((1, n)))


class IdentityTotal(Explicit):
    def __init__(self, n: int, weight: float = 1.0):
        super().__init__(np.vstack([np.eye(n), weight * np.ones((1, n))]))


class Prefix(Explicit):
    def __init__(self, n: int):
        super().__init__(np.tril(np.ones((n, n))))

    def answer(self, counts):
        return np.cumsum(counts)


class Suffix(Explicit):
    def __init__(self, n: int):
        super().__init__(np.triu(np.ones((n, n))))

    def answer(self, counts):
        return np.cumsum(counts[::-1])[::-1]


class AllRange(Workload):
    """Every [i, j]; answered from prefix sums, Gram in closed form."""

    def __init__(self, n: int):
        self.n, self.shape = n, (n * (n + 1) // 2, n)

    def matrix(self):
        i, j = np.triu_indices(self.n)
        k = np.arange(self.n)
        return ((k >= i[:, None]) & (k <= j[:, None])).astype(float)

    def answer(self, counts):
        upto = np.concatenate([[0.0], np.cumsum(counts)])
        i, j = np.triu_indices(self.n)
        return upto[j + 1] - upto[i]

    def gram(self):
        k = np.arange(self.n)
        return (np.minimum.outer(k, k) + 1.0) * (self.n - np.maximum.outer(k, k))


class WidthRange(Explicit):
    def __init__(self, n: int, width: int):
        k = np.arange(n)
        super().__init__(((k >= np.arange(n - width + 1)[:, None]) & (k < np.arange(n - width + 1)[:, None] + width)).astype(float))


class Haar(Explicit):
    """Total and differences of halves of dyadic blocks; n a power of two."""

    def __init__(self, n: int):
        rows, width = [np.ones(n)], n
        while width > 1:
            for a in range(0, n, width):
                r = np.zeros(n)
                r[a : a + width // 2], r[a + width // 2 : a + width] = 1, -1
                rows.append(r)
            width //= 2
        super().__init__(np.array(rows))


class Permuted(Explicit):
    def __init__(self, base: Workload, order: Sequence[int]):
        super().__init__(base.matrix()[:, list(order)])


class Kronecker(Workload):
    """Products of one workload for each attribute, applied axis by axis."""

    def __init__(self, *parts: Workload):
        self.parts = parts
        self.shape = (int(np.prod([p.shape[0] for p in parts])), int(np.prod([p.shape[1] for p in parts])))

    def matrix(self):
        return reduce(np.kron, [p.matrix() for p in self.parts])

    def answer(self, counts):
        x = np.asarray(counts, float).reshape([p.shape[1] for p in self.parts])
        for i, p in enumerate(self.parts):
            x = np.moveaxis(np.tensordot(p.matrix(), x, (1, i)), 0, i)
        return x.ravel()

    def gram(self):
        return reduce(np.kron, [p.gram() for p in self.parts])

    def l1(self):
        return float(np.prod([p.l1() for p in self.parts]))

    def l2(self):
        return float(np.prod([p.l2() for p in self.parts]))


class Stacked(Workload):
    """Weighted workloads over the same cells, one below the other."""

    def __init__(self, parts: Sequence[Workload], weights: Sequence[float] | None = None):
        self.parts, self.weights = list(parts), list(weights or [1.0] * len(parts))
        self.shape = (sum(p.shape[0] for p in parts), parts[0].shape[1])

    def matrix(self):
        return np.vstack([w * p.matrix() for p, w in zip(self.parts, self.weights, strict=True)])

    def answer(self, counts):
        return np.concatenate([w * p.answer(counts) for p, w in zip(self.parts, self.weights, strict=True)])

    def gram(self):
        return sum(w * w * p.gram() for p, w in zip(self.parts, self.weights, strict=True))


def marginal_workload(shape: Sequence[int], axes: Sequence[int]) -> Kronecker:
    """The marginal of some axes of a table."""
    return Kronecker(*[Identity(n) if i in axes else Total(n) for i, n in enumerate(shape)])


def expected_error(workload: Workload, strategy: Workload, epsilon: float, ridge: float = 1e-9) -> float:
    """Total variance of the workload's answers when the strategy is measured by Laplace noise and solved by least squares."""
    a = strategy.gram()
    return 2 * (strategy.l1() / epsilon) ** 2 * float(np.trace(np.linalg.solve(a + ridge * np.eye(len(a)), workload.gram())))


def p_identity(workload: Workload, p: int, rounds: int = 200, seed: int = 0) -> Explicit:
    """A strategy [I; B] scaled to sensitivity 1 that lowers expected_error, by random moves from the best scale of p equal blocks."""
    rng = np.random.default_rng(seed)
    n = workload.shape[1]
    build = lambda b: Explicit((m := np.vstack([np.eye(n), b])) / np.abs(m).sum(0))
    score = lambda b: expected_error(workload, build(b), 1.0)
    blocks = (np.arange(n) * p // n == np.arange(p)[:, None]).astype(float)
    best, b = min(((score(s * blocks), s * blocks) for s in (0.0, 0.2, 0.4, 0.8, 1.6)), key=lambda x: x[0])
    step = 0.3
    for _ in range(rounds):
        trial = np.maximum(0.0, b * np.exp(rng.normal(0, step, (p, 1))) + (rng.random(b.shape) < 2 / n) * rng.normal(0, step, b.shape))
        error = score(trial)
        b, best, step = (trial, error, step * 1.1) if error < best else (b, best, max(0.01, step * 0.97))
    return build(b)
