import random
import statistics
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspark.functions import ranks, tables
from veilspark.operators import append, encode, evaluate, postings, selection
from veilspark.plans.domain import Domain


def test_running_sums_and_ranks(spark):
    rng = random.Random(1)
    rows = [(i, rng.randrange(1000) if i % 7 else None, rng.randrange(5)) for i in range(3000)]
    df = spark.createDataFrame(rows, "i long, v long, n long")
    out, total = ranks.running(df, [F.desc("v"), "i"], ["n"])
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    got = out.orderBy("_rank").collect()
    assert [(r["i"], r["v"], r["n"]) for r in got] == want and [r["_rank"] for r in got] == list(range(3000))
    assert [r["_before_n"] for r in got] == [sum(x[2] for x in want[:k]) for k in range(3000)] and total == {"rows": 3000, "n": sum(r[2] for r in rows)}
    empty, total = ranks.running(df.limit(0), ["i"], ["n"])
    assert empty.count() == 0 and total == {"rows": 0, "n": 0}


def test_no_task_holds_all_values(spark):
    df = spark.createDataFrame([(float(i), i % 2) for i in range(100)], "x double, y int")
    for out in (encode.ordinal_map(df, "x"), encode.frequency_map(df, "x"), encode.empirical_cdf(df, "x"), selection.proportional(df, 50, "x", "x"), selection.largest_remainder(df, 50, "x", "x")):
        out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in plan.replace("Initial Plan", "")
    assert np.isclose(evaluate.roc_auc(df, "y", "x").first()["auc"], 0.51)


def test_normal_quantiles(spark):
    exact = statistics.NormalDist().inv_cdf
    shares = [1e-300, 1e-20, 1e-9, 1e-4, 0.02, 0.0749, 0.075, 0.0751, 0.3, 0.5, 0.777, 0.925, 0.99, 1 - 1e-12]
    got = spark.createDataFrame([(p,) for p in shares], "p double").select("p", encode.inverse_normal(F.col("p")).alias("z")).collect()
    assert all(abs(r["z"] - exact(r["p"])) <= 1e-12 * max(1, abs(exact(r["p"]))) for r in got)
    ends = spark.createDataFrame([(0.0,), (1.0,), (None,)], "p double").select(encode.inverse_normal(F.col("p")).alias("z")).collect()
    assert [r["z"] for r in ends] == [float("-inf"), float("inf"), None]


@pytest.mark.parametrize("parts", [1, 7])
def test_positions_within_groups(spark, parts):
    rng = random.Random(2)
    rows = [(i, rng.choice([0, 0, 0, 1, None]), rng.random()) for i in range(2000)]
    df = spark.createDataFrame(rows, "i long, g long, u double")
    got = ranks.numbered_within(df, ["g"], F.floor(F.col("u") * parts), ["u", "i"]).collect()
    for g in (0, 1, None):
        mine = sorted((r["u"], r["i"]) for r in got if r["g"] == g)
        assert [(r["u"], r["i"]) for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["_position"])] == mine
        assert [r["_position"] for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["_position"])] == list(range(len(mine))) and {r["_size"] for r in got if r["g"] == g} == {len(mine)}


D = Domain({"a": 2, "b": 3, "c": 4})


@pytest.mark.parametrize("literal", [True, False])
def test_appended_counts_follow_the_target(spark, monkeypatch, literal):
    if not literal:
        monkeypatch.setattr(tables, "LITERAL", 0)
        monkeypatch.setattr(tables, "BROADCAST", 0)
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(zip(rng.integers(0, 2, 900) * (rng.random(900) < 0.2), rng.integers(0, 3, 900), strict=True))] + [(900, 5, 0), (901, None, 0)], "id long, a long, b long")
    target = rng.random((2, 4, 3)) * 50 - 5  # over (a, c, b)
    target[1, :, 2] = 0
    leaf = append.Leaf("c", ("a", "b"), ("a", "c", "b"))
    out = append.appended(rows, "id", D, leaf, target, stretch_rows=100)
    assert out.columns == ["id", "a", "b", "c"] and out.orderBy("id").collect() == append.appended(rows, "id", D, leaf, target, stretch_rows=100).orderBy("id").collect()
    got = Counter((r["a"], r["b"], r["c"]) for r in out.collect())
    assert got[5, 0, None] == got[None, 0, None] == 1
    for a in range(2):
        for b in range(3):
            n = sum(got[a, b, c] for c in range(4))
            mass = np.maximum(target[a, :, b], 0)
            share = mass / mass.sum() if mass.sum() else np.full(4, 0.25)
            assert n == rows.where((F.col("a") == a) & (F.col("b") == b)).count() and all(abs(got[a, b, c] - share[c] * n) <= 1 for c in range(4))


def test_leaves_are_clipped_in_layers(spark):
    left, layers = append.clipped([("a", "b"), ("b", "c"), ("c", "d"), ("c", "e"), ("x", "y")])
    assert all(len({leaf.clique for leaf in layer}) == len(layer) for layer in layers)
    clipped = [leaf.attr for layer in layers for leaf in layer]
    assert len(set(clipped)) == len(clipped) and set(clipped) | {a for c in left for a in c} == set("abcdexy")
    have = {a for c in left for a in c}  # what a layer needs is there when it is appended
    for layer in reversed(layers):
        assert all(set(leaf.separator) <= have for leaf in layer)
        have |= {leaf.attr for leaf in layer}
    assert append.clipped([("a", "b"), ("b", "c"), ("a", "c")]) == ([("a", "b"), ("b", "c"), ("a", "c")], [])
    rows = spark.range(60).select(F.col("id"), (F.col("id") % 2).alias("a"))
    targets = {("a", "b"): np.eye(2, 3) * 5, ("b", "c"): np.eye(3, 4)}
    got = append.appended_layers(rows, "id", D, [[append.Leaf("c", ("b",), ("b", "c"))], [append.Leaf("b", ("a",), ("a", "b"))]], targets)
    assert all(r["a"] == r["b"] == r["c"] for r in got.collect())


def test_posting_lists_and_samples(spark):
    rng = random.Random(4)
    rows = [(i, 0 if rng.random() < 0.5 else rng.randrange(1, 4), rng.choice([0, 1, None])) for i in range(1500)]
    df = spark.createDataFrame(rows, "key long, p long, q long")
    lists = postings.postings(df, "key", ["p", "q"], entry=16, stretch_rows=200)
    found = lists.collect()
    assert max(len(r["keys"]) for r in found) == 16
    whole = {}
    for r in sorted(found, key=lambda r: r["stretch"]):
        assert r["stretch"] * 16 == len(whole.setdefault((r["column"], r["category"]), []))
        whole[r["column"], r["category"]] += r["keys"]
    assert {k: sorted(v) for k, v in whole.items()} == {(c, x): sorted(r[0] for r in rows if r[j] == x) for c, j in (("p", 1), ("q", 2)) for x in {r[j] for r in rows} - {None}}
    wanted = spark.createDataFrame([("p", 0, k) for k in (0, 15, 16, 700, 10**6)] + [("q", 7, 0)], "column string, category long, k long")
    got = {(r["column"], r["category"], r["k"]): r["key"] for r in postings.looked_up_rows(wanted, lists, 16).collect()}
    assert got == {("p", 0, k): whole["p", 0][k] for k in (0, 15, 16, 700)} | {("p", 0, 10**6): None, ("q", 7, 0): None}
    requests = spark.range(4000).toDF("r")
    sample = postings.conditional_sample(requests, "r", df, "key", {"p": 4, "q": 2}, entry=16).collect()
    assert len(sample) == 4000 and all(rows[r["key"]][1 if r["column"] == "p" else 2] == r["category"] for r in sample)
    n = Counter((r["column"], r["category"]) for r in sample)
    weights = {c: np.log1p(sum(r[1] == c for r in rows)) for c in range(4)}
    assert all(abs(n["p", c] / 2000 - w / sum(weights.values())) < 0.05 for c, w in weights.items())
    assert postings.conditional_sample(requests, "r", df.limit(0), "key", {"p": 4}).count() == 0
