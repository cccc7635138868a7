import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspark.operators import discretize
from veilspark.sources import encoded

EDGE = [(1, 0.0), (2, None), (3, 100.0), (4, 50.0)]


def frame(spark, n=400):
    rng = np.random.default_rng(1)
    return spark.createDataFrame([(10 + i, float(v)) for i, v in enumerate(np.round(rng.gamma(1.0, 12.0, n).clip(0, 100), 3))] + EDGE, "id long, x double")


@pytest.mark.parametrize("method", discretize.METHODS)
def test_methods_and_their_inverses(spark, method):
    df = frame(spark)
    fitted = discretize.Discretizer(method=method, epsilon=5.0, rng=np.random.default_rng(2)).fit(df, ["x"])
    codes = fitted.transform(df)
    rows = {r["id"]: r["x"] for r in codes.collect()}
    size = discretize.domain_of(fitted)["x"]
    assert rows[2] is None and all(0 <= c < size for i, c in rows.items() if i != 2) and rows[1] == 0 and rows[3] == size - 1
    values = {r["id"]: r["x"] for r in df.collect()}
    order = sorted((v, rows[i]) for i, v in values.items() if v is not None)
    assert all(a[1] <= b[1] for a, b in zip(order, order[1:], strict=False))
    middle, drawn, again = ({r["id"]: r["x"] for r in out.collect()} for out in (fitted.inverse(codes), fitted.inverse(codes, "id"), fitted.inverse(codes, "id")))
    assert drawn == again and middle[2] is None and drawn[2] is None
    back = {r["id"]: r["x"] for r in fitted.transform(fitted.inverse(codes, "id")).collect()}
    assert back == rows if method == "none" else np.mean([back[i] == c for i, c in rows.items()]) > 0.98  # a point of a bin has the bin's code, but for rounding at edges
    if method == "none":
        assert drawn == values
    else:
        assert drawn != middle and all(-0.02 <= drawn[i] <= 100.02 for i in values if i != 2)


def test_private_encoders_are_stored(spark, tmp_path):
    df = frame(spark).withColumn("split", F.when(F.col("id") % 2 == 0, "train").otherwise("test"))
    folder = f"file://{tmp_path}/encoder"
    first = encoded.encoded(df, ["x"], folder, encoder=discretize.Discretizer(method="dawa", epsilon=5.0, rng=np.random.default_rng(3)))
    loaded = encoded.load_encoder(spark, folder)
    assert loaded.method == "dawa" and loaded.edges["x"] and first.orderBy("id").collect() == loaded.transform(df).orderBy("id").collect()
    encoded.write_decoded(first, f"file://{tmp_path}/decoded", folder, "id")
    assert discretize.domain_of(loaded)["x"] == len(loaded.edges["x"])
    with pytest.raises(ValueError, match="none of"):
        discretize.Discretizer(method="other").fit(df, ["x"])


def test_constant_and_empty_columns(spark):
    one = spark.createDataFrame([(1, 5.0)] * 3, "id long, x double")
    for method in discretize.METHODS:
        assert {r["x"] for r in discretize.Discretizer(method=method, distinct=1).fit(one, ["x"]).transform(one).collect()} == {0}
    assert discretize.Discretizer().fit(one.limit(0), ["x"]).transform(one.limit(0)).count() == 0


def test_budget_shares(spark):
    df = spark.createDataFrame([(float(i), i % 3, f"c{i}", "k") for i in range(150)], "a double, b int, c string, d string")
    assert discretize.budget_shares(df, ["a", "b"], ["c", "d"], "privtree") == (0.5, 0.5) and discretize.budget_shares(df, ["a", "b"], ["c", "d"], "uniform") == (0.0, 1.0)
    assert discretize.budget_shares(df, ["b"], ["d"], "dawa") == (0.0, 0.0) and discretize.budget_shares(df, ["a"], [], "dawa") == (1.0, 0.0)


def test_significant_values_and_even_decoding(spark):
    rows = [(i, v) for i, v in enumerate(["big"] * 300 + ["large"] * 200 + [f"r{j}" for j in range(7) for _ in range(3)] + [None])]
    df = spark.createDataFrame(rows, "id long, v string")
    fitted = discretize.SignificantValues.fit(df, "v", 10.0, "s")
    codes = {r["value"]: r["code"] for r in fitted.codes.collect()}
    assert fitted.kept == 2 and codes["big"] == 0 and codes["large"] == 1 and {codes[f"r{j}"] for j in range(7)} == {2}
    coded = fitted.encode(df, "v")
    back = fitted.decode(coded, "v", "id")
    assert back.columns == df.columns and back.count() == len(rows) and back.where("v is null").count() == 1
    n = {r["v"]: r["n"] for r in back.groupBy("v").agg(F.count("*").alias("n")).collect()}
    assert n["big"] == 300 and n["large"] == 200 and all(abs(n[f"r{j}"] - 3) <= 1 for j in range(7))
    assert back.orderBy("id").collect() == fitted.decode(coded, "v", "id").orderBy("id").collect()
    all_kept = discretize.SignificantValues.fit(df.where("v = 'big'"), "v", 1.0, "s")
    assert all_kept.others.count() == 0 and all_kept.decode(all_kept.encode(df.where("v = 'big'"), "v"), "v", "id").count() == 300
