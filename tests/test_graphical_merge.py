import numpy as np

from veilspark.operators import graphical
from veilspark.operators.graphical import Measurement, fit, merged_by_clique
from veilspark.plans.domain import Domain


def test_repeated_measurements_work_once(monkeypatch):
    rng = np.random.default_rng(6)
    domain = Domain({"a": 3, "b": 4})
    truth = rng.uniform(10, 50, (3, 4))
    many = [Measurement(("a", "b"), truth + rng.normal(0, s, truth.shape), s) for s in (1.0, 2.0, 4.0)] + [Measurement(("a",), truth.sum(1), 3.0)]
    merged, spread = merged_by_clique(many)
    assert [m.clique for m in merged] == [("a", "b"), ("a",)]
    at = rng.uniform(10, 50, (3, 4))
    error = lambda ms: sum(0.5 * ((((at if len(m.clique) == 2 else at.sum(1)) - m.counts) / m.sigma) ** 2).sum() for m in ms)
    assert np.isclose(error(many), error(merged) + spread, rtol=1e-12)
    asked = []
    former = graphical.TreeModel.holder
    monkeypatch.setattr(graphical.TreeModel, "holder", lambda self, c: (asked.append(tuple(c)), former(self, c))[1])
    fit(domain, many, 5)
    assert asked.count(("a", "b")) == 1
