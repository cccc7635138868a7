import itertools
import math
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspark.functions import exact
from veilspark.operators import mechanisms
from veilspark.queries import QUERIES

SF = "/root/testdata/sf0.001"


def fits(counts, law, n, most):
    """Pearson's statistic of counts against a law (values of small expectation together) is below `most`."""
    big = {x: p for x, p in law.items() if n * p >= 8}
    rest = n - sum(counts[x] for x in big)
    expected = n * (1 - sum(big.values()))
    return sum((counts[x] - n * p) ** 2 / (n * p) for x, p in big.items()) + (rest - expected) ** 2 / max(expected, 1) < most


@pytest.mark.parametrize("variance", [Fraction(1, 5), Fraction(1), Fraction(49, 4)])
def test_gaussian_noise_follows_the_law(variance):
    n = 6000
    weight = {x: math.exp(-x * x / (2 * float(variance))) for x in range(-60, 61)}
    law = {x: w / sum(weight.values()) for x, w in weight.items()}
    assert fits(Counter(exact.Draws("s", str(i)).gaussian(variance) for i in range(n)), law, n, 75)


@pytest.mark.parametrize("scale", [1, 4])
def test_laplace_noise_follows_the_law(scale):
    n = 6000
    weight = {x: math.exp(-abs(x) / scale) for x in range(-90, 91)}
    law = {x: w / sum(weight.values()) for x, w in weight.items()}
    assert fits(Counter(exact.Draws("t", str(i)).laplace(scale) for i in range(n)), law, n, 75)


def test_draws_are_even_and_repeat():
    d = exact.Draws("a", "b")
    assert fits(Counter(d.below(7) for _ in range(7000)), dict.fromkeys(range(7), 1 / 7), 7000, 25)
    assert [exact.Draws("a", "b").below(10**30) for _ in range(2)][0] == exact.Draws("a", "b").below(10**30) != exact.Draws("a", "c").below(10**30)
    for x in (Fraction(0), Fraction(1, 3), Fraction(5, 2)):
        share = np.mean([exact.Draws("c", f"{x}{i}").decays(x) for i in range(4000)])
        assert abs(share - math.exp(-x)) < 0.04


def test_noise_columns(spark):
    df = spark.createDataFrame([(1, "x"), (2, None), (1, "x")], "a long, b string")
    rows = df.select("a", exact.exact_gaussian("s", Fraction(9), "a", "b").alias("g"), exact.exact_laplace("s", 3, F.col("a")).alias("l")).collect()
    assert rows == df.select("a", exact.exact_gaussian("s", 9, "a", "b").alias("g"), exact.exact_laplace("s", 3, F.col("a")).alias("l")).collect() and rows[0] == rows[2]
    for bad in (lambda: exact.exact_gaussian("s", 0, "a"), lambda: exact.exact_laplace("s", 0, "a")):
        with pytest.raises(ValueError, match="must be"):
            bad()
    out = QUERIES["integer_noise"](spark, SF).toPandas()
    assert len(out) == 63 and (out["noisy"] - out["n"]).between(-25, 25).all() and (out["noisy"] != out["n"]).any()


def flips(scores, epsilon):
    """Exact winning probabilities of permute-and-flip, over all orders of the candidates."""
    p = [math.exp(epsilon * (s - max(scores)) / 2) for s in scores]
    won = [0.0] * len(scores)
    for order in itertools.permutations(range(len(scores))):
        left = 1.0
        for i in order:
            won[i] += left * p[i] / math.factorial(len(scores))
            left *= 1 - p[i]
    return won


def test_permute_and_flip_has_its_probabilities(spark):
    scores, groups = [3.0, 1.0, 2.5, -1.0], 8000
    table = spark.range(groups).select(F.col("id").alias("g"), F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(s).alias("s")) for k, s in enumerate(scores)])).alias("c")).select("g", "c.*")
    won = mechanisms.permute_and_flip(table, "k", "s", 1.0, "seed", by=["g"])
    assert won.columns == ["g", "k", "s"]
    n = Counter(r["k"] for r in won.collect())
    assert sum(n.values()) == groups and fits(n, dict(enumerate(flips(scores, 1.0))), groups, 25)
    soft = Counter(r["k"] for r in mechanisms.exponential(table, "k", "s", 1.0, "seed", by=["g"]).collect())
    weight = [math.exp(s / 2) for s in scores]
    assert fits(soft, {k: w / sum(weight) for k, w in enumerate(weight)}, groups, 25)


def test_selection_of_odd_tables(spark):
    table = spark.createDataFrame([(1, None), (2, 5.0), (3, 5.0)], "k long, s double")
    assert {mechanisms.permute_and_flip(table, "k", "s", 1e9, f"s{i}").first()["k"] for i in range(12)} == {2, 3}
    assert mechanisms.permute_and_flip(table.limit(0), "k", "s", 1.0, "s").count() == mechanisms.exponential(table.where("s is null"), "k", "s", 1.0, "s").count() == 0
    assert mechanisms.exponential(table, "k", "s", 1.0, "s").first()["k"] in (2, 3)


def test_generalised_scores(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(rng.normal() * 10), float(rng.choice([1.0, 2.0, 5.0]))) for i in range(60)]
    df = spark.createDataFrame(rows, "k long, s double, d double")
    got = {r["k"]: r["scaled"] for r in mechanisms.comparable(df, "s", "d", 4.0).collect()}
    want = {k: min((s - q - 4.0 * (d - e)) / (d + e) for _, q, e in rows) for k, s, d in rows}
    assert all(abs(got[k] - w) < 1e-12 for k, w in want.items()) and max(got.values()) <= 0
    best = max(want, key=want.get)
    assert mechanisms.generalised_exponential(df, "k", "s", "d", 1e6, "s", beta=0.5).first()["k"] in {k for k in want if want[k] >= want[best] - 1} | {max(rows, key=lambda r: r[1])[0]}
    assert mechanisms.generalised_exponential(df.limit(0), "k", "s", "d", 1.0, "s").count() == 0
