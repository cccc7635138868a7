import math

import pytest

from veilspark.functions import budget
from veilspark.functions.noise import gaussian_sigma, quieter


@pytest.mark.parametrize("eps", [0.1, 1.0, 4.0])
@pytest.mark.parametrize("delta", [1e-9, 1e-6, 0.01])
def test_conversions_invert_each_other(eps, delta):
    rho = budget.zcdp_rho(eps, delta)
    assert math.isclose(budget.zcdp_eps(rho, delta), eps, rel_tol=1e-6)
    assert math.isclose(budget.zcdp_delta(rho, eps), delta, rel_tol=1e-6)
    assert rho >= budget.zcdp_rho_closed(eps, delta) > 0


@pytest.mark.parametrize("rho, eps", [(0.001, 0.1), (0.1, 1.0), (1.0, 3.0), (5.0, 20.0)])
def test_delta_is_the_least_over_orders_and_covers_the_gaussian(rho, eps):
    grid = [1 + 10 ** (i / 400) for i in range(-1600, 1600)]
    bound = lambda a: (a - 1) * (a * rho - eps) + a * math.log1p(-1 / a) - math.log(a - 1)
    least = math.exp(min(map(bound, grid)))
    delta = budget.zcdp_delta(rho, eps)
    assert least * (1 - 1e-3) <= delta <= least * (1 + 1e-9)
    # the Gaussian mechanism of that rho, by integration of (p - e^eps q)+
    sigma, step = gaussian_sigma(rho), 1e-3
    x = [i * step * sigma for i in range(-12000, 12000)]
    density = lambda v, m: math.exp(-((v - m) ** 2) / (2 * sigma**2)) / (sigma * math.sqrt(2 * math.pi))
    exact = sum(max(0.0, density(v, 1) - math.exp(eps) * density(v, 0)) for v in x) * step * sigma
    assert exact <= delta


def test_ledger_refuses_overdraft():
    ledger = budget.Ledger(1.0)
    ledger.charge("a", 0.7)
    with pytest.raises(ValueError):
        ledger.charge("b", 0.4)
    ledger.charge("b", ledger.left)
    assert math.isclose(sum(r for _, r in ledger.spent), 1.0)


def test_weighted_shares_add_up():
    shares = budget.weighted_shares({"a": 8, "b": 1000}, 0.5)
    assert math.isclose(sum(shares.values()), 0.5) and shares["b"] > shares["a"]


def test_renyi_accounting():
    assert budget.rdp_sampled_gaussian(1.0, 2.0, 8) == 8 / 8
    assert budget.rdp_sampled_gaussian(0.01, 2.0, 8) < 0.01
    sigma = budget.noise_multiplier(1.0, 1e-5, 0.01, 1000)
    assert budget.rdp_eps(0.01, sigma, 1000, 1e-5) <= 1.0 + 1e-6


def test_noise_choice():
    assert math.isclose(gaussian_sigma(0.5), 1.0)
    assert quieter(10.0, 0.5, 1.0, 1.0)[0] == "laplace"
