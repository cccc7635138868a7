import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspark.functions import tables
from veilspark.functions.budget import Ledger
from veilspark.operators import evaluate, graphical, partition, synthesize
from veilspark.plans.domain import Domain, all_cliques
from veilspark.queries import LINE_DOMAIN, QUERIES, coded_lines

SF = "/root/testdata/sf0.001"
D = Domain({"a": 2, "b": 3, "c": 4, "d": 3})


def joint(rng):
    x = rng.random(D.shape) ** 3
    return 5000 * x / x.sum()


def chain_joint(rng):
    """A joint table in which d depends on c alone and c on b alone."""
    ab, bc, cd = rng.random((2, 3)), rng.random((3, 4)), rng.random((4, 3))
    x = np.einsum("ab,bc,cd->abcd", ab, bc, cd)
    return 5000 * x / x.sum()


def view(x, clique):
    return x.sum(tuple(i for i, a in enumerate(D) if a not in clique))


def test_junction_tree_keeps_running_intersection():
    nodes, edges = graphical.junction_tree(D, [("a", "b"), ("b", "c"), ("c", "d"), ("a", "d")])
    assert len(edges) == len(nodes) - 1 and all(any(set(c) <= set(n) for n in nodes) for c in [("a", "b"), ("b", "c"), ("c", "d"), ("a", "d")])
    for a in D:
        mine = [n for n in nodes if a in n]
        assert sum(a in x and a in y for x, y in edges) == len(mine) - 1


def test_model_recovers_exact_marginals():
    x = chain_joint(np.random.default_rng(1))
    cliques = [("a", "b"), ("b", "c"), ("c", "d")]
    model = graphical.fit(D, [graphical.Measurement(c, view(x, c), 1.0) for c in cliques], 2000)
    for c in cliques:
        assert np.abs(model.project(c) - view(x, c)).sum() / 5000 < 0.01
    assert np.abs(model.project(("a", "d")) - view(x, ("a", "d"))).sum() / 5000 < 0.01  # outside the tree, by elimination
    assert np.isclose(model.project(("d", "a")).sum(), 5000, rtol=0.01) and np.allclose(model.project(("d", "a")), model.project(("a", "d")).T)


def test_unconnected_attributes_are_independent():
    x = joint(np.random.default_rng(2))
    model = graphical.fit(D, [graphical.Measurement((a,), view(x, (a,)), 1.0) for a in D], 500)
    assert np.allclose(model.project(("a", "b")), np.outer(view(x, ("a",)), view(x, ("b",))) / 5000, rtol=0.02, atol=2)


def test_sampled_rows_follow_the_model(spark):
    x = chain_joint(np.random.default_rng(3))
    model = graphical.fit(D, [graphical.Measurement(c, view(x, c), 1.0) for c in [("a", "b"), ("b", "c"), ("c", "d")]], 1000)
    rows = synthesize.sample(spark, model, 20000)
    got = synthesize.datavectors(rows, D, all_cliques(D, 2))
    assert rows.count() == 20000 and all(np.abs(got[c] / 4 - model.project(c)).sum() / 5000 < 0.05 for c in got)
    assert rows.orderBy("row_id").collect() == synthesize.sample(spark, model, 20000).orderBy("row_id").collect()


def test_sampled_rows_do_not_move(spark, monkeypatch):
    x = chain_joint(np.random.default_rng(3))
    model = graphical.fit(D, [graphical.Measurement(c, view(x, c), 1.0) for c in [("a", "b"), ("b", "c"), ("c", "d")]], 200)
    rows = synthesize.sample(spark, model, 3000)
    assert not any(x in rows._jdf.queryExecution().executedPlan().toString() for x in ("Exchange", "Join"))
    for bound in ("LITERAL", "BROADCAST"):  # the same rows from a broadcast and from a joined table
        monkeypatch.setattr(tables, bound, 0)
        assert synthesize.sample(spark, model, 3000).orderBy("row_id").collect() == rows.orderBy("row_id").collect()


@pytest.mark.parametrize("how", ["aim", "mst", "adaptive"])
def test_loops_spend_their_budget_and_beat_independence(spark, how):
    x = np.zeros(D.shape)
    for a, b, c, d in np.ndindex(D.shape):
        x[a, b, c, d] = 200 if b % 2 == a and c == d else 2
    rows = [tuple(map(int, i)) for i in np.ndindex(D.shape) for _ in range(int(x[i]))]
    df = spark.createDataFrame(rows, list(D))
    rng = np.random.default_rng(4)
    ways = {
        "aim": lambda: synthesize.aim(df, D, synthesize.two_way_workload(D), 2.0, rounds=6, rng=rng), "mst": lambda: synthesize.mst(df, D, 2.0, rng=rng),
        "adaptive": lambda: synthesize.adaptive(df, D, 2.0, rounds=8, rng=rng)[:2],
    }
    model, ledger = ways[how]()
    assert ledger.left < 1e-6 * 2.0 + 1e-9
    answers = {c: view(x, c) for c in all_cliques(D, 2)}
    alone = graphical.fit(D, [graphical.Measurement((a,), view(x, (a,)), 1.0) for a in D], 300)
    error = lambda m: np.mean(list(synthesize.workload_error(answers, m).values()))
    assert error(model) < 0.5 * error(alone)


def test_adaptive_selection_measures_again_and_doubles(spark):
    x = chain_joint(np.random.default_rng(9))
    rows = [tuple(map(int, i)) for i in np.ndindex(D.shape) for _ in range(int(x[i]))]
    df = spark.createDataFrame(rows, list(D))
    model, ledger, times = synthesize.adaptive(df, D, 0.05, rounds=20, rng=np.random.default_rng(2))
    assert abs(ledger.left) < 1e-9 and sum(times.values()) <= 20 and set(times) <= set(all_cliques(D, 2))
    spent = [s for what, s in ledger.spent if what != "selection"]
    assert max(spent) > 1.9 * min(spent)  # a marginal that taught nothing doubled the budget
    assert all(m.sum() > 0 for m in model.marginals.values())


def test_ledger_stops_measurements():
    measure = synthesize.Measurer({("a",): np.zeros(3)}, Ledger(0.1), np.random.default_rng(0))
    with pytest.raises(ValueError):
        measure(("a",), 0.2)


def test_private_partitions():
    counts = np.zeros(64)
    counts[10:14] = 5000
    rng = np.random.default_rng(5)
    edges = partition.privtree(counts, 1.0, rng=rng)
    assert edges[0] == 0 and len(edges) < 40 and sum(10 <= e < 14 for e in edges) >= 3
    starts = partition.dawa(counts, 1.0, rng=rng)
    assert starts[0] == 0 and len(starts) < 64


def test_tvd_properties(spark):
    df = spark.createDataFrame([(0, 1), (1, 1), (1, 0)], "a long, b long")
    assert {r["tvd"] for r in evaluate.marginal_tvd(df, df, [("a",), ("a", "b")]).collect()} == {0.0}
    other = spark.createDataFrame([(5, 5)], "a long, b long")
    assert {round(r["tvd"], 12) for r in evaluate.marginal_tvd(df, other, [("a",), ("a", "b")]).collect()} == {1.0}


@pytest.mark.parametrize("name", ["aim_synth", "consistency_loop", "privtree_bins", "dawa_bins", "mst_tvd"])
def test_stochastic_queries_run(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_record_updates_move_rows_to_the_targets(spark):
    from veilspark.operators import records

    x = chain_joint(np.random.default_rng(6))
    rows = records.start(spark, D, {a: view(x, (a,)) for a in D}, 4000)
    targets = {c: view(x, c) for c in [("a", "b"), ("b", "c"), ("c", "d")]}
    error = lambda df: sum(np.abs(v / v.sum() - targets[c] / targets[c].sum()).sum() for c, v in synthesize.datavectors(df, D, list(targets)).items())
    after = records.updated(rows, D, targets, rounds=3)
    assert after.count() == 4000 and error(after) < 0.5 * error(rows)
    assert len(records.separated([("a", "b"), ("c", "d"), ("b", "x")])) == 2


@pytest.mark.parametrize(("mode", "schedule"), [("complete", "constant"), ("halves, partial", "root")])
def test_complete_updates_copy_rows_of_the_cell(spark, mode, schedule):
    from veilspark.operators import records

    x = chain_joint(np.random.default_rng(6))
    rows = records.start(spark, D, {a: view(x, (a,)) for a in D}, 4000).withColumn("tag", F.concat_ws("-", *D))
    targets = {c: view(x, c) for c in [("a", "b"), ("b", "c")]}
    counts = synthesize.datavectors(rows, D, list(targets))
    clique = ("a", "b")
    once = records.moved(rows, D, clique, targets[clique], counts[clique], 1.0, "s", 1.0)
    assert once.count() == 4000 and once.columns == rows.columns and once.where(F.col("tag") != F.concat_ws("-", *D)).count() == 0  # whole rows are copied
    assert once.orderBy("row_id").collect() == records.moved(rows, D, clique, targets[clique], counts[clique], 1.0, "s", 1.0).orderBy("row_id").collect()
    after = records.updated(rows, D, targets, rounds=2, schedule=schedule, mode=mode)
    error = lambda df: records.total_error(synthesize.datavectors(df, D, list(targets)), targets)
    assert after.count() == 4000 and error(after) < 0.6 * error(rows)
    assert set(records.SCHEDULES) >= {"constant", "root"} and all(0 < f(k) <= 1 for f in records.SCHEDULES.values() for k in (0, 7, 120))


@pytest.mark.parametrize("whole", [0.0, 0.6])
def test_counts_move_as_rows_do(spark, whole):
    from veilspark.operators import records

    x = joint(np.random.default_rng(7))
    one_way, targets = {a: view(x, (a,)) for a in D}, {c: view(x, c) for c in [("a", "b"), ("d", "b")]}
    targets["d", "b"] = targets["d", "b"].T  # a clique's attributes may stand in another order than the domain's
    targets["a", "b"][0, 1] = -50.0  # a noisy target below zero
    joint_of = lambda df: synthesize.datavectors(df, D, [tuple(D)])[tuple(D)]
    near = lambda got, draws: np.abs(got - draws.mean(0)) <= 5 * np.maximum(draws.std(0), 1.0)
    rows = records.start(spark, D, one_way, 20000)
    began = joint_of(rows)
    assert near(began, np.stack([records.start_counts(D, one_way, 20000, str(i)) for i in range(300)])).all()
    for clique, target in targets.items():
        counts = synthesize.datavectors(rows, D, [clique])[clique]
        got = joint_of(records.moved(rows, D, clique, target, counts, 0.7, "s", whole))
        draws = np.stack([records.moved_counts(began.astype(np.int64), D, clique, target, 0.7, np.random.default_rng(i), whole) for i in range(300)])
        assert (draws.sum((1, 2, 3, 4)) == 20000).all() and (draws >= 0).all() and near(got, draws).all()
        assert np.abs(got - began).sum() > 1000  # a step that moves many rows


def test_updated_counts_reach_the_targets_whatever_the_rows():
    from veilspark.operators import records

    x = chain_joint(np.random.default_rng(6))
    targets = {c: view(x, c) for c in all_cliques(D, 2)}
    error = lambda n: records.total_error({c: view(n, c) for c in targets}, targets)
    for mode, most in (("partial", 0.06), ("halves, complete", 0.03)):
        shares = []
        for rows in (200_000, 216_000_000):  # the larger number takes as long as the smaller one
            began = records.start_counts(D, {a: view(x, (a,)) for a in D}, rows)
            after = records.updated_counts(began, D, targets, mode=mode)
            assert began.sum() == after.sum() == rows and after.min() >= 0
            shares.append(error(after) / error(began))
        assert max(shares) < most and abs(shares[0] - shares[1]) < 0.01


@pytest.mark.parametrize("rows", [1, 2, 3, 5, 1000, 30011])
def test_shuffled_numbers_are_a_permutation(rows):
    from veilspark.operators import records

    got = records.shuffled(np.arange(rows), rows, "x")
    assert sorted(got.tolist()) == list(range(rows))
    assert (got[rows // 2 :] == records.shuffled(np.arange(rows // 2, rows), rows, "x")).all()  # whatever else is in the batch
    if rows > 100:
        assert abs(np.corrcoef(got[1:], got[:-1])[0, 1]) < 0.15 and abs(np.corrcoef(got, np.arange(rows))[0, 1]) < 0.15


def test_listed_rows_are_the_counts(spark):
    from veilspark.operators import records

    counts = np.random.default_rng(8).integers(0, 200, D.shape) * np.random.default_rng(9).integers(0, 2, D.shape)
    rows = records.listed(spark, D, counts)
    assert rows.columns == ["row_id", *D.attrs] and sorted(r["row_id"] for r in rows.collect()) == list(range(counts.sum()))
    assert (synthesize.datavectors(rows, D, [tuple(D)])[tuple(D)] == counts).all()
    some = records.listed(spark, D, counts).where(F.col("row_id") < int(counts.sum()) // 2)
    assert (np.abs(synthesize.datavectors(some, D, [("a",)])["a",] - view(counts, ("a",)) / 2) < 5 * np.sqrt(counts.sum()) / 2).all()  # no part of the ids holds one cell
    assert records.listed(spark, D, np.zeros(D.shape, np.int64)).count() == 0


def test_record_updates_of_a_small_domain_pass_over_no_rows(spark, monkeypatch):
    from veilspark.operators import records

    written = []
    monkeypatch.setattr(records, "moved", lambda *args: written.append(args))
    monkeypatch.setattr(records.Rounds, "__call__", lambda self, df: written.append(df))
    context = spark.sparkContext
    context.setJobGroup("gum", "jobs of the query itself")
    rows = QUERIES["gum_synth"](spark, SF)
    jobs = len(context.statusTracker().getJobIdsForGroup("gum"))
    context.setLocalProperty("spark.jobGroup.id", None)
    assert not written and jobs <= 6, jobs  # the noisy marginals; before, more than one job for each step
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Range" in plan and "Exchange" not in plan and "FileScan" not in plan


def test_larger_domains_move_rows(spark, monkeypatch):
    from veilspark.operators import records

    x = chain_joint(np.random.default_rng(6))
    one_way, targets = {a: view(x, (a,)) for a in D}, {c: view(x, c) for c in [("a", "b"), ("b", "c")]}
    error = lambda df: records.total_error(synthesize.datavectors(df, D, list(targets)), targets)
    few = error(records.synthesized(spark, D, one_way, 4000, targets, rounds=3))
    monkeypatch.setattr(records, "CELLS", D.size() - 1)
    monkeypatch.setattr(records, "listed", None)
    many = records.synthesized(spark, D, one_way, 4000, targets, rounds=3)
    assert many.count() == 4000 and max(few, error(many)) < 0.1 * error(records.start(spark, D, one_way, 4000))


@pytest.mark.parametrize(("name", "attrs", "most"), [("gum_synth", ["flag", "status", "line", "tax"], 0.014), ("aim_synth", list(LINE_DOMAIN), 0.113)])
def test_synthetic_marginals_reach_their_targets(spark, name, attrs, most):
    from veilspark.operators import records

    domain = LINE_DOMAIN.project(attrs)
    targets, counts = (synthesize.datavectors(df, domain, all_cliques(domain, 2)) for df in (coded_lines(spark, SF), QUERIES[name](spark, SF)))
    assert records.total_error(counts, targets) <= most * sum(x.sum() for x in counts.values())


def test_datavectors_leave_out_codes_outside_the_domain(spark):
    df = spark.createDataFrame([(0, 1), (1, 0), (-1, 1), (3, 0), (None, 1)], "a long, b long")
    got = synthesize.datavectors(df, Domain({"a": 3, "b": 2}), [("a",), ("b",), ("a", "b")])
    assert got["a",].tolist() == [1, 1, 0] and got["b",].tolist() == [2, 3] and got["a", "b"].tolist() == [[0, 1], [1, 0], [0, 0]]
