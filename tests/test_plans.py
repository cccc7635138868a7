import random

import numpy as np
import pytest

from veilspark.operators import consistency, marginal, selection
from veilspark.plans.domain import Domain, all_cliques, downward_closure, maximal, score_workload


def test_domain_algebra():
    d = Domain({"a": 2, "b": 3, "c": 4})
    assert d.size() == 24 and d.project(["c", "a"]).shape == (4, 2) and d.without(["b"]).attrs == ("a", "c")
    assert d.canonical(["c", "a"]) == ("a", "c") and d.axes(["c", "a"]) == (2, 0) and d.strides(("a", "b", "c")) == {"a": 12, "b": 4, "c": 1}
    assert d.merge(Domain({"d": 5})).attrs == ("a", "b", "c", "d") and d.by_size(True).attrs == ("c", "b", "a")
    with pytest.raises(ValueError):
        d.merge(Domain({"a": 9}))


def test_cliques():
    assert len(downward_closure([("a", "b", "c")])) == 7
    assert score_workload({("a", "b"): 1.0})[("a", "b")] == 2
    assert maximal([("a",), ("a", "b"), ("c",)]) == [("a", "b"), ("c",)]
    assert all_cliques(Domain({"a": 2, "b": 3, "c": 400}), 2, 100) == [("a", "b")]


def test_marginals_on_edge_cases(spark):
    df = spark.createDataFrame([(0, None, 1), (0, 1, 1), (1, 1, None)], "a long, b long, c long")
    got = {(r["clique"], r["k1"], r["k2"]): r["n"] for r in marginal.marginals(df, [("a",), ("a", "b"), ("b", "c")]).collect()}
    assert got == {("a", 0, None): 2, ("a", 1, None): 1, ("a,b", 0, 1): 1, ("a,b", 1, 1): 1, ("b,c", 1, 1): 1}
    assert marginal.marginals(df.limit(0), [("a",)]).count() == 0
    filled = marginal.zero_filled(df, Domain({"a": 2, "b": 3}), ("a", "b"))
    assert filled.count() == 6 and filled.agg({"n": "sum"}).first()[0] == 2
    with pytest.raises(Exception, match="outside the domain"):
        marginal.zero_filled(df, Domain({"a": 1, "b": 3}), ("a", "b")).collect()


def shifted(x, total):
    """The nearest non-negative vector of a total."""
    lo, hi = min(x) - abs(total) - 1, max(x)
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if np.maximum(0, x - mid).sum() > total else (lo, mid)
    return np.maximum(0, x - hi)


def test_norm_sub_is_the_nearest(spark):
    rng = np.random.default_rng(3)
    groups = [rng.normal(rng.choice([-3, 0, 4]), 5, rng.integers(1, 12)).round(1) for _ in range(60)]
    rows = [(g, i, float(v)) for g, x in enumerate(groups) for i, v in enumerate(x)]
    got = consistency.norm_sub(spark.createDataFrame(rows, "g long, cell long, n double"), "cell", "n", "g").collect()
    by = {(r["g"], r["cell"]): r["n"] for r in got}
    for g, x in enumerate(groups):
        want = shifted(x, x.sum()) if x.sum() > 0 else np.zeros(len(x))
        assert np.allclose([by[g, i] for i in range(len(x))], want, atol=1e-6)


def brute_agreed(out, shared):
    """One round over the sets, one after another."""
    for s in shared:
        who = [c for c in out if set(s) <= set(c)]
        views = {c: out[c].sum(tuple(i for i, a in enumerate(c) if a not in s)) for c in who}
        behind = {c: out[c].size / views[c].size for c in who}
        mean = sum(views[c] / behind[c] for c in who) / sum(1 / behind[c] for c in who)
        for c in who:
            out[c] = out[c] + np.expand_dims((mean - views[c]) / behind[c], tuple(i for i, a in enumerate(c) if a not in s))
    return out


def test_consistent_marginals_agree(spark):
    rng = np.random.default_rng(1)
    domain = Domain({"a": 3, "b": 4, "c": 5})
    noisy = {("a", "b"): rng.normal(10, 5, (3, 4)), ("b", "c"): rng.normal(8, 5, (4, 5)), ("a", "c"): rng.normal(8, 5, (3, 5))}
    table = lambda x: spark.createDataFrame([(",".join(c), int(i), int(j), float(m[i, j])) for c, m in x.items() for i, j in np.ndindex(m.shape)], "clique string, k1 long, k2 long, n double")

    def arrays(df):
        out = {c: np.zeros(m.shape) for c, m in noisy.items()}
        for r in df.collect():
            out[tuple(r["clique"].split(","))][r["k1"], r["k2"]] = r["n"]
        return out

    want = brute_agreed({c: m.copy() + 50 for c, m in noisy.items()}, [(), ("a",), ("b",), ("c",)])  # nothing is cut
    got = arrays(consistency.consistent(table({c: m + 50 for c, m in noisy.items()}), domain, list(noisy), rounds=1))
    assert all(np.allclose(got[c], want[c]) for c in noisy)
    out = arrays(consistency.consistent(table(noisy), domain, list(noisy), rounds=6))
    assert np.allclose(out["a", "b"].sum(0), out["b", "c"].sum(1), atol=1.5) and np.allclose(out["a", "b"].sum(1), out["a", "c"].sum(1), atol=1.5)
    assert all(m.min() >= -1e-9 for m in out.values())



def test_selection():
    rng = random.Random(3)
    picks = [selection.exponential_mechanism({"x": 0.0, "y": 5.0}, 2.0, rng=rng) for _ in range(300)]
    assert picks.count("y") > 280
    assert selection.pareto({"a": (1, 1), "b": (2, 3), "c": (3, 2)}) == ["a", "b"]
    assert selection.spanning_tree({("a", "b"): 3, ("b", "c"): 2, ("a", "c"): 1}, "abc") == [("a", "b"), ("b", "c")]
    assert selection.choose_pairs({("a", "b"): 1000.0, ("a", "c"): 0.1}, Domain({"a": 2, "b": 2, "c": 2}), 1000, 1.0) == [("a", "b")]
