import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspark.operators import public_filter, query_index, reweight
from veilspark.plans.domain import Domain, all_cliques
from veilspark.queries import FREQUENCIES, LINE_DOMAIN, QUERIES, TWO

SF = "/root/testdata/sf0.001"


# --- public rows


def brute_greedy(x, target, patience):
    kept, steps = list(range(len(x))), {}
    far = lambda rows: float(((x[rows].mean(0) - target) ** 2).sum())
    distances = [far(kept)]
    while len(kept) > 1:
        trials = [far([j for j in kept if j != i]) for i in kept]
        at = int(np.argmin(trials))
        if distances[-1] - trials[at] <= patience * distances[-1] / len(kept) or trials[at] >= distances[-1]:
            break
        distances.append(trials[at])
        steps[kept[at]] = len(steps) + 1
        del kept[at]
    return np.array([steps.get(i, 0) for i in range(len(x))]), distances


@pytest.mark.parametrize("patience", [0.0, 0.5])
def test_greedy_equals_brute_force_and_falls_at_every_step(patience):
    for seed in range(20):
        rng = np.random.default_rng(seed)
        x, target = rng.normal(0.3, 1, (25, 6)), rng.normal(0, 0.2, 6)
        steps, distances = public_filter.greedy(x, target, patience)
        want, want_distances = brute_greedy(x, target, patience)
        assert steps.tolist() == want.tolist() and np.allclose(distances, want_distances, atol=1e-9)
        assert all(b < a for a, b in itertools.pairwise(distances)) and np.isclose(distances[-1], ((x[steps == 0].mean(0) - target) ** 2).sum())


def vectors(spark, rng, n):
    rows = [(int(i), [float(v) for v in rng.normal(0.4 * (i % 3), 1, 5)], int(i % 2)) for i in range(n)]
    return spark.createDataFrame(rows + [(n, None, 0), (None, [0.1] * 5, 1), (n + 1, [None] + [0.0] * 4, 1), (3, [0.2] * 5, 0)], "key long, v array<double>, y int")


W = [[0.5, -1.0, 0.25, 2.0, 1.0], [1.0, 0.5, -0.5, 0.0, 1.5]]


def test_blocks_of_a_table(spark):
    df = vectors(spark, np.random.default_rng(5), 150)
    embedding = public_filter.embedded(F.col("v"), W, F.col("y"), [0, 1])
    private = vectors(spark, np.random.default_rng(6), 60).where("y = 0")
    target = public_filter.mean_embedding(private, embedding)
    exact = [[np.sqrt(0.5) * f(np.dot(r["v"], w)) for f in (np.cos, np.sin) for w in W] for r in private.collect() if r["v"] and None not in r["v"]]
    assert np.allclose(target, [*np.mean(exact, 0), 0, 0, 0, 0])
    out = public_filter.filtered(df, "key", embedding, target, block=40).toPandas()
    assert len(out) == df.count() and out["block"].nunique() == 4
    assert out.loc[out["key"].isin([150, 151]), "kept"].tolist() == [False, False] and out.loc[out["key"].isin([150, 151]), "block"].isna().all()
    x = {(r["key"], tuple(r["v"])): np.array(r["f"]) for r in df.withColumn("f", embedding).collect() if r["v"] and None not in r["v"]}
    for _, b in out.dropna(subset="block").groupby("block"):
        assert (b["after"] < b["before"]).all() and b["kept"].sum() < len(b) and set(b["step"].dropna()) == set(range(1, 1 + (~b["kept"]).sum()))
        if b["key"].notna().all() and not (b["key"] == 3).any():
            rows = np.stack([next(v for (k, _), v in x.items() if k == i) for i in b["key"]])
            assert np.isclose(((rows[b["kept"].to_numpy()].mean(0) - target) ** 2).sum(), b["after"].iloc[0])
    assert public_filter.filtered(df.limit(0), "key", embedding, target).count() == 0
    noisy = public_filter.mean_embedding(private, embedding, 0.5)
    assert 0.1 < np.abs(noisy - target).mean() < 2


def test_evolved_subsets_never_rise(spark):
    df = vectors(spark, np.random.default_rng(7), 80)
    embedding = public_filter.embedded(F.col("v"), W)
    target = public_filter.mean_embedding(df.where("key < 20"), embedding)
    first, second = (public_filter.evolved(df, "key", embedding, target, block=40, generations=40).orderBy("key", "block", "kept").toPandas() for _ in range(2))
    assert first.equals(second) and (first["after"] < first["before"]).all() and first["kept"].any()


def test_filter_query(spark):
    out = QUERIES["public_filter"](spark, SF).toPandas()
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    assert sorted(out["vec_id"]) == sorted(r["vec_id"] for r in e.where("vec_id % 2 = 1").collect()) and (out["after"] <= out["before"]).all() and 0 < out["kept"].mean() < 1
    assert len(FREQUENCIES[0]) == len(e.first()["embedding"])


# --- weights over a support


def brute_weights(cells, answers, cliques, rounds):
    w = np.full(len(cells), 1 / len(cells))
    total, errors = np.zeros(len(cells)), []
    for _ in range(rounds):
        off = {}
        for c in cliques:
            for q in {tuple(r[a] for a in c) for r in cells} | {k for d, k in answers if d == c}:
                inside = np.array([tuple(r[a] for a in c) == q for r in cells])
                off[c, q] = answers.get((c, q), 0.0) - w[inside].sum()
        (c, q), e = max(off.items(), key=lambda x: abs(x[1]))
        errors.append(abs(e))
        w = w * np.exp(np.where([tuple(r[a] for a in c) == q for r in cells], e, 0))
        w /= w.sum()
        total += w / rounds
    return w, total, errors


@pytest.mark.parametrize("settle", [1, 3, 50])
def test_weights_equal_brute_force(spark, settle):
    rng = np.random.default_rng(8)
    cells = [{"a": a, "b": b, "c": c} for a in range(2) for b in range(3) for c in range(4) if rng.random() < 0.8]
    cliques = [("a", "b"), ("b", "c"), ("c",)]
    target = rng.random(len(cells)) ** 2
    target /= target.sum()
    answers = {}
    for c in cliques:
        for r, t in zip(cells, target, strict=True):
            q = tuple(r[a] for a in c)
            answers[c, q] = answers.get((c, q), 0.0) + t
    table = spark.createDataFrame([(",".join(c), q[0], q[1] if len(q) > 1 else None, float(v)) for (c, q), v in answers.items()], "clique string, k1 long, k2 long, share double")
    support = spark.createDataFrame([(r["a"], r["b"], r["c"]) for r in cells], "a long, b long, c long")
    out, errors = reweight.multiplicative_weights(support, table, cliques, 7, settle=settle)
    got = {(r["a"], r["b"], r["c"]): (r["last"], r["mean"]) for r in out.collect()}
    last, mean, want = brute_weights(cells, answers, cliques, 7)
    assert np.allclose(errors, want) and np.allclose([got[r["a"], r["b"], r["c"]] for r in cells], np.stack([last, mean], 1))
    assert errors[-1] < errors[0]


def test_weights_of_odd_supports(spark):
    answers = spark.createDataFrame([("a", 0, 0.7), ("a", 1, 0.3)], "clique string, k1 long, share double")
    support = spark.createDataFrame([(0, 2.0), (1, None), (2, 0.0), (1, 1.0)], "a long, n double")
    out, errors = reweight.multiplicative_weights(support, answers, [("a",)], 2, "n")
    got = sorted((r["a"], r["n"], round(r["last"], 6)) for r in out.where("n is not null").collect())
    assert len(errors) == 2 and got[2] == (2, 0.0, 0.0) and np.isclose(sum(r["last"] for r in out.collect()), 1) and out.where("n is null").first()["last"] == 0
    assert reweight.multiplicative_weights(support.limit(0), answers, [("a",)], 2)[0].count() == 0


# --- query numbers


def test_numbers_and_codes_are_inverse(spark):
    domain = Domain({"a": 2, "b": 3, "c": 4})
    cliques = [("a", "c"), ("b",), ("a", "b", "c")]
    cells = [(c, k) for c in cliques for k in itertools.product(*(range(domain[a]) for a in c))]
    first = {"a": 0, "b": 2, "c": 5}
    got = query_index.codes(query_index.positions(query_index.all_queries(spark, domain, cliques), domain, cliques), domain).orderBy("query").collect()
    assert [(r["clique"], r["positions"]) for r in got] == [(",".join(c), [first[a] + k for a, k in zip(c, q, strict=True)]) for c, q in cells]
    assert [[r[a] for a in domain] for r in got] == [[dict(zip(c, q, strict=True)).get(a, -1) for a in domain] for c, q in cells]
    rows = [(",".join(c), *q, *[None] * (3 - len(q))) for c, q in cells] + [("a,c", 2, 0, None), ("zz", 0, 0, 0), ("b", None, None, None)]
    numbered = query_index.numbers(spark.createDataFrame(rows, "clique string, k1 long, k2 long, k3 long"), domain, cliques).collect()
    assert sorted(r["query"] for r in numbered if r["query"] is not None) == list(range(len(cells))) and sum(r["query"] is None for r in numbered) == 3
    assert {(r["clique"], r["k1"], r["k2"], r["k3"]): r["query"] for r in numbered if r["query"] is not None} == {r: i for i, r in enumerate(rows[: len(cells)])}
    odd = spark.createDataFrame([(10**9,), (-1,), (None,)], "query long")
    assert all(r["clique"] is None and r["positions"] is None for r in query_index.positions(odd, domain, cliques).collect())
    data = spark.createDataFrame([(0, 1, 2), (1, 1, 3)], "a long, b long, c long")
    assert data.where(query_index.matches(domain, [-1, 1, 3])).count() == 1 and data.where(query_index.matches(domain, [-1, -1, -1])).count() == 2


def test_query_index_covers_the_workload(spark):
    out = QUERIES["query_index"](spark, SF)
    assert out.count() == sum(LINE_DOMAIN.size(c) for c in TWO) == out.select("query").distinct().count() and TWO == all_cliques(LINE_DOMAIN, 2)
