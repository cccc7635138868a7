import numpy as np
import pytest

from veilspark.operators import subsets
from veilspark.operators import workload as w


@pytest.mark.parametrize("x", [w.Identity(6), w.Total(6), w.IdentityTotal(6, 0.5), w.Prefix(6), w.Suffix(6), w.AllRange(6), w.WidthRange(6, 3), w.Haar(8), w.Permuted(w.Prefix(4), [3, 1, 0, 2]), w.Kronecker(w.Prefix(3), w.AllRange(2), w.Total(2)), w.Stacked([w.Prefix(5), w.Identity(5)], [2.0, 1.0]), w.marginal_workload((2, 3, 4), (0, 2))])
def test_shortcuts_equal_the_explicit_matrix(x):
    counts = np.random.default_rng(0).integers(0, 9, x.shape[1]).astype(float)
    m = x.matrix()
    assert m.shape == x.shape and np.allclose(x.answer(counts), m @ counts) and np.allclose(x.gram(), m.T @ m)
    assert np.isclose(x.l1(), np.abs(m).sum(0).max()) and np.isclose(x.l2(), np.sqrt((m * m).sum(0).max()))


def test_strategies_lower_the_error():
    ranges = w.AllRange(64)
    found = w.p_identity(ranges, 8)
    assert np.isclose(found.l1(), 1.0) and w.expected_error(ranges, found, 1.0) < 0.9 * w.expected_error(ranges, w.Identity(64), 1.0)


def test_subsets(spark):
    df = spark.range(3000).selectExpr("id", "id % 5 as code", "if(id % 10 = 0, null, id % 3) as gap")
    parts = {r["split"]: r["count"] for r in subsets.split(df, "id", {"train": 0.8, "test": 0.2}).groupBy("split").count().collect()}
    assert sum(parts.values()) == 3000 and abs(parts["train"] - 2400) < 120
    strata = {r["code"]: r["count"] for r in subsets.stratified(df, "id", "code", 0.1).groupBy("code").count().collect()}
    assert strata == dict.fromkeys(range(5), 60)
    assert subsets.biased(df, "id", "code", {0: 0.0}, 1.0).count() == 2400
    wrong = subsets.corrupted(df, "id", {"code": 5}, 0.5).alias("w").join(df.alias("d"), "id").where("w.code <> d.code").count()
    assert abs(wrong - 1500) < 150
    filled = subsets.imputed(df, "id", "gap", [1.0, 1.0, 2.0])
    assert filled.where("gap is null").count() == 0 and filled.where("id % 10 = 0 and gap = 2").count() > 100
    relaxed = spark.createDataFrame([(1, [0.5, 0.25, 0.25]), (2, [0.0, 1.0, 0.0])], "id long, p array<double>")
    counts = {(r["id"], r["code"]): r["count"] for r in subsets.upsampled(relaxed, "id", "p", 8).groupBy("id", "code").count().collect()}
    assert counts == {(1, 0): 4, (1, 1): 2, (1, 2): 2, (2, 1): 8}
