import math
import statistics

import numpy as np
import pytest

from veilspark.operators import mixture
from veilspark.queries import QUERIES


def test_digamma():
    for x in (0.001, 0.5, 1.0, 3.7, 25.0, 1e6):
        h = 1e-5 * max(1, x)
        assert abs(mixture.digamma(x) - (math.lgamma(x + h / 100) - math.lgamma(x - h / 100)) / (h / 50)) < 1e-3 * max(1, abs(mixture.digamma(x)))
    assert abs(mixture.digamma(1.0) + 0.5772156649015329) < 1e-12


def brute_step(xs, components, prior):
    """One variational iteration over the rows themselves, and the bound before it."""
    terms = mixture._log_terms(components)
    fit, r = 0.0, np.zeros((len(xs), len(components)))
    for i, x in enumerate(xs):
        logs = np.array([c - h * (x - m) ** 2 for c, m, h in terms])
        top = logs.max()
        total = top + math.log(np.exp(logs - top).sum())
        fit += total
        r[i] = np.exp(logs - total)
    n, out = r.sum(0), []
    for k in range(len(components)):
        mean = (r[:, k] * xs).sum() / n[k]
        beta = prior.beta + n[k]
        rate = prior.rate + 0.5 * ((r[:, k] * (xs - mean) ** 2).sum() + prior.beta * n[k] / beta * (mean - prior.mean) ** 2)
        out.append(mixture.Component(prior.alpha + n[k], (prior.beta * prior.mean + n[k] * mean) / beta, beta, prior.shape + n[k] / 2, rate))
    return out, mixture._bound(components, prior, fit)


def test_modes_are_found_and_the_bound_never_falls(spark):
    rng = np.random.default_rng(1)
    xs = np.round(np.concatenate([rng.normal(0, 1, 500), rng.normal(20, 2, 300), rng.normal(-30, 0.5, 200)]), 1)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(xs)] + [(1000, None), (1001, float("nan"))], "id long, x double")
    fitted = mixture.fit_modes(df, "x", components=5, rounds=30)
    assert all(b >= a - 1e-6 for a, b in zip(fitted.bounds, fitted.bounds[1:], strict=False))
    near = sorted((fitted.components[i].mean, fitted.components[i].deviation) for i in fitted.modes)
    for mean, deviation in ((-30, 0.5), (0, 1), (20, 2)):
        assert any(abs(m - mean) < 1 and d < deviation + 1.5 for m, d in near)
    out = fitted.transform(df, "x", "id")
    rows = {r["id"]: r for r in fitted.inverse(out, "back").collect()}
    assert rows[1000]["mode"] is None and rows[1000]["back"] is None
    assert all(abs(rows[i]["back"] - x) < 1e-9 and abs(rows[i]["value"]) < 3 for i, x in enumerate(xs))
    again = {r["id"]: r["mode"] for r in fitted.transform(df, "x", "id").collect()}
    assert all(rows[i]["mode"] == again[i] for i in range(1000))
    small = statistics.mean(abs(rows[i]["value"]) for i in range(1000))
    assert small < 0.5


def test_an_iteration_equals_brute_force(spark):
    xs = np.array([0.0, 0.0, 1.0, 5.0, 5.5, 5.5, 9.0])
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    one, two = (mixture.fit_modes(df, "x", components=2, rounds=k, tolerance=-1e9) for k in (1, 2))
    prior = mixture.Component(mixture.CONCENTRATION, xs.mean(), 0.01, 0.5, xs.var() / 2)
    want, bound = brute_step(xs, one.components, prior)
    assert two.bounds[1] == pytest.approx(bound) and all(np.allclose([*vars(a).values()], [*vars(b).values()]) for a, b in zip(two.components, want, strict=True))


def test_odd_columns(spark):
    empty = spark.createDataFrame([(1, None)], "id long, x double")
    none = mixture.fit_modes(empty, "x")
    assert not none.modes and none.transform(empty, "x", "id").first()["mode"] is None
    same = spark.createDataFrame([(i, 7.0) for i in range(50)], "id long, x double")
    one = mixture.fit_modes(same, "x", components=3)
    back = one.inverse(one.transform(same, "x", "id"), "back").collect()
    assert len(one.modes) >= 1 and all(abs(r["back"] - 7) < 1e-9 for r in back)


def test_mode_query(spark):
    out = QUERIES["mode_values"](spark, "/root/testdata/sf0.001").toPandas()
    assert np.allclose(out["back"], out["value"], equal_nan=True) and out["mode"].nunique() >= 1
