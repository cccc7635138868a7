import numpy as np
from pyspark.sql import functions as F

from veilspark.functions.tables import at_most, literal
from veilspark.operators.discretize import Discretizer
from veilspark.operators.encode import interval_code


def test_at_most_counts_like_a_filter(spark):
    rng = np.random.default_rng(3)
    x = [None, -1.0, 0.0, 1.0, float("nan"), *rng.uniform(-0.2, 1.2, 200).round(2).tolist()]
    df = spark.createDataFrame([(v,) for v in x], "x double")
    for n in (0, 1, 2, 7, 8, 100):
        upto = np.sort(rng.uniform(size=n).round(2))
        got = df.select("x", at_most(literal(upto), n, F.col("x")).alias("n"), F.size(F.filter(literal(upto), lambda e: e <= F.col("x"))).alias("m")).collect()
        assert [r["n"] for r in got] == [r["m"] for r in got]


def test_interval_code_evaluates_its_value_once(spark):
    got = spark.range(50).select(interval_code(F.rand(1), [0.0, *[0.5] * 1000, 1.0]).alias("n")).collect()
    assert {r["n"] for r in got} == {0, 1000}  # one draw a row; a draw for each edge gives about 500


def test_private_bins_evaluate_their_value_once(spark):
    d = Discretizer(ranges={"x": (0.0, 1.0)}, edges={"x": [0.0, *[0.5] * 1000]})
    got = spark.range(50).select(F.rand(1).alias("x")).select(d._bin("x").alias("n")).collect()
    assert {r["n"] for r in got} == {0, 1000}
