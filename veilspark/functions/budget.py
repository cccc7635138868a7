"""Privacy budgets: conversions between zCDP and approximate DP, a ledger, Renyi accounting."""

from __future__ import annotations

import math
from dataclasses import dataclass, field


def _zero(f, low: float, high: float) -> float:
    """Where a rising function of the logarithm of its argument passes zero between low and high."""
    low, high = math.log(low), math.log(high)
    while low < (mid := (low + high) / 2) < high:
        if f(math.exp(mid)) < 0:
            low = mid
        else:
            high = mid
    return math.exp(high)


# rho-zCDP gives, for every u > 0 (the Renyi order less one), the trade
#     log delta + eps * u = rho * u * (1 + u) + u * log(u) - (1 + u) * log(1 + u).
# Each conversion below is the best u for one unknown, from where the derivative by u is zero.


def _traded(rho: float, u: float) -> float:
    return rho * u * (1 + u) + u * math.log(u) - (1 + u) * math.log1p(u)


def zcdp_delta(rho: float, eps: float) -> float:
    """Least delta with which rho-zCDP gives (eps, delta)-DP.

    The derivative rho * (1 + 2u) - eps - log(1 + 1/u) rises and is concave, so Newton
    steps from its negative side approach the zero without passing it.
    """
    if rho == 0:
        return 0.0
    u = max(math.exp(-3 * rho), 1e-300)
    for _ in range(1000):
        step = (eps + math.log1p(1 / u) - rho * (1 + 2 * u)) / (2 * rho + 1 / (u * (1 + u)))
        u += max(step, 0.0)
        if step <= 1e-15 * u:
            break
    return min(1.0, math.exp(_traded(rho, u) - eps * u))


def zcdp_eps(rho: float, delta: float) -> float:
    """Least eps with which rho-zCDP gives (eps, delta)-DP: the best u has rho * u^2 + log(1 + u) = log(1 / delta)."""
    if rho == 0 or delta >= 1:
        return 0.0
    log = -math.log(delta)
    u = _zero(lambda u: rho * u * u + math.log1p(u) - log, 1e-300, math.sqrt(log / rho))
    return max(0.0, (_traded(rho, u) + log) / u)


def zcdp_rho(eps: float, delta: float) -> float:
    """Largest rho with which rho-zCDP gives (eps, delta)-DP: both conditions above at once leave one equation in u, which rises up to u = 1 / delta - 1."""
    if not 0 < delta < 1:
        return 0.0
    log = -math.log(delta)
    rho = lambda u: max(0.0, log - math.log1p(u)) / (u * u)
    u = _zero(lambda u: eps + math.log1p(1 / u) - rho(u) * (1 + 2 * u), 1e-100, math.expm1(log))
    return rho(u)


def zcdp_rho_closed(eps: float, delta: float) -> float:
    """A rho that suffices by the standard conversion; never above zcdp_rho."""
    log = math.log(1 / delta)
    return eps + 2 * log - 2 * math.sqrt(eps * log + log * log)


def advanced_composition_sigma(eps: float, delta: float, queries: int, sensitivity: float = 1.0) -> float:
    """Gaussian deviation for each of `queries` answers under one (eps, delta) by zCDP."""
    return sensitivity * math.sqrt(queries / (2 * zcdp_rho(eps, delta)))


def weighted_shares(cells: dict, rho: float) -> dict:
    """rho for each marginal in proportion to cells ** (2/3), the split of least expected absolute error."""
    total = sum(n ** (2 / 3) for n in cells.values())
    return {c: rho * n ** (2 / 3) / total for c, n in cells.items()}


@dataclass
class Ledger:
    """Spends a zCDP budget and refuses to go beyond it."""

    rho: float
    spent: list[tuple[str, float]] = field(default_factory=list)

    @property
    def left(self) -> float:
        return self.rho - sum(r for _, r in self.spent)

    def charge(self, what: str, rho: float) -> float:
        if rho < 0 or rho > self.left * (1 + 1e-12) + 1e-15:
            raise ValueError(f"{what} needs {rho:g} of the {self.left:g} left")
        self.spent.append((what, rho))
        return rho


def rdp_sampled_gaussian(q: float, sigma: float, order: int) -> float:
    """Renyi divergence of integer order of the Poisson-sampled Gaussian mechanism."""
    if q == 0:
        return 0.0
    if q == 1:
        return order / (2 * sigma**2)
    terms = [math.lgamma(order + 1) - math.lgamma(k + 1) - math.lgamma(order - k + 1) + k * math.log(q) + (order - k) * math.log1p(-q) + (k * k - k) / (2 * sigma**2) for k in range(order + 1)]
    top = max(terms)
    return (top + math.log(sum(math.exp(t - top) for t in terms))) / (order - 1)


def rdp_eps(q: float, sigma: float, steps: int, delta: float, orders: range = range(2, 256)) -> float:
    """eps of `steps` sampled Gaussian releases at `delta`, best over the orders."""
    return min(steps * rdp_sampled_gaussian(q, sigma, a) + math.log1p(-1 / a) - (math.log(delta) + math.log(a)) / (a - 1) for a in orders)


def noise_multiplier(eps: float, delta: float, q: float, steps: int) -> float:
    """Least noise with which rdp_eps stays within eps."""
    high = 1.0
    while rdp_eps(q, high, steps, delta) > eps:
        high *= 2
    return _zero(lambda s: eps - rdp_eps(q, s, steps, delta), 0.05, high)
