import numpy as np
import pytest

from veilspark.operators import features


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(120, 3)), np.tile(rng.normal(size=(1, 3)), (60, 1))]).round(2)  # a third are copies
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(500, None), (501, [1.0, None, 2.0])]
    return x, spark.createDataFrame(rows, "k long, v array<double>").cache()


def brute(x, y):
    return ((x[:, None, :] - y[None, :, :]) ** 2).sum(-1)


@pytest.mark.parametrize("block", [7, 512])
def test_kernel_means(table, monkeypatch, block):
    x, df = table
    monkeypatch.setattr(features.blocks, "__defaults__", (block, None))
    a, b = df.where("k < 70 or k >= 500"), df.where("k >= 70")
    got = features.kernel_mean(a, b, "v", 2.0).first()["mean"]
    assert np.isclose(got, np.exp(-brute(x[:70], x[70:]) / 4).mean(), rtol=1e-12)
    assert features.kernel_mean(a.limit(0), b, "v", 2.0).first()["mean"] is None


@pytest.mark.parametrize(("bins", "gathered"), [(4096, 100_000), (16, 10), (2, 1)])
def test_median_of_all_pairs(table, monkeypatch, bins, gathered):
    x, df = table
    monkeypatch.setattr(features.blocks, "__defaults__", (40, None))
    d = np.sqrt(brute(x, x))[np.triu_indices(len(x), 1)]
    assert np.isclose(features.median_distance(df, "v", bins, gathered), np.median(d), rtol=1e-12)
    some = df.where("k < 5")
    assert np.isclose(features.median_distance(some, "v", bins, gathered), np.median(np.sqrt(brute(x[:5], x[:5]))[np.triu_indices(5, 1)]), rtol=1e-12)
    assert features.median_distance(df.where("k >= 120"), "v", bins, gathered) == 0 and features.median_distance(df.where("k < 1"), "v", bins, gathered) is None


@pytest.mark.parametrize("measure", ["l2", "l1", "cosine"])
def test_nearest_votes(table, monkeypatch, measure):
    x, df = table
    monkeypatch.setattr(features.blocks, "__defaults__", (30, None))
    q, t = x[40:], x[:40]
    far = {"l2": brute(q, t), "l1": np.abs(q[:, None, :] - t[None, :, :]).sum(-1), "cosine": -(q @ t.T) / np.sqrt(np.outer((q * q).sum(1), (t * t).sum(1)))}[measure]
    want = {int(k): int(n) for k, n in zip(*np.unique(far.argmin(1), return_counts=True), strict=True)}
    got = features.nearest_votes(df.where("k >= 40"), df.where("k < 40"), "k", "v", measure).collect()
    assert {r["k"]: r["votes"] for r in got} == want


def test_vectors_are_copied_for_strips_not_for_blocks(table):
    _, df = table
    packed = features.blocks(df.where("k < 120"), "v", 2)

    def run(pairs):
        met = sorted((min(p, q), max(p, q)) for p, q, _, _ in pairs)
        return features.pd.DataFrame({"met": [len(met)], "different": [len(set(met))]})

    got = features.over_pairs(packed, packed, run, "met long, different long", once=True).collect()
    held = packed[0].count()
    assert packed[1] > 50 and len(got) == features.STRIPS * (features.STRIPS + 1) // 2
    assert sum(r["met"] for r in got) == sum(r["different"] for r in got) == held * (held + 1) // 2


def test_discrepancy_and_close_pairs(table):
    x, df = table
    a, b = df.where("k < 70"), df.where("k >= 70")
    mean = lambda p, q: np.exp(-brute(p, q) / 4).mean()
    want = mean(x[:70], x[:70]) + mean(x[70:], x[70:]) - 2 * mean(x[:70], x[70:])
    assert np.isclose(features.discrepancy(a, b, "v", 2.0).first()["mmd"], want, rtol=1e-10)
    rng = np.random.default_rng(2)
    far = np.concatenate([rng.normal(size=(40, 5)), rng.normal(size=(3, 5)) * 1e-9 + 7])
    assert np.allclose(features.squared_distances(far, far), brute(far, far), rtol=1e-11, atol=0)
    odd = np.array([[1e200, 0.0], [np.inf, 1.0], [2.0, 3.0]])
    with np.errstate(all="ignore"):
        assert np.array_equal(features.squared_distances(odd, odd), features._distances(odd, odd), equal_nan=True)
