import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspark.operators import evaluate, learn, synthesize
from veilspark.operators.graphical import TreeModel
from veilspark.plans.domain import Domain


def test_counted_rows_score_like_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(int(y), int(p)) for y, p in rng.integers(0, 3, (300, 2))] + [(None, 1)]
    df = spark.createDataFrame(rows, "y int, p int")
    counts = df.groupBy("y", "p").agg(F.count("*").alias("n"))
    for score in (evaluate.classification, evaluate.regression):
        assert tuple(score(df, "y", "p").first()) == pytest.approx(tuple(score(counts, "y", "p", "n").first()), rel=1e-12)


def test_a_tree_is_fitted_on_distinct_rows(spark, monkeypatch):
    domain = Domain({"a": 3, "b": 4, "y": 2})
    model = TreeModel(domain, [("a", "b"), ("b", "y")], 4000.0)
    rows = synthesize.sample(spark, model, 4000).withColumn("y", ((F.col("a") + F.col("b")) % 2).cast("long"))
    seen = []
    former = learn.Pipeline.fit
    monkeypatch.setattr(learn.Pipeline, "fit", lambda self, df: (seen.append(df.count()), former(self, df))[1])
    got = learn.utility({"real": rows}, rows, ["a", "b"], "y", models=("tree", "logistic")).collect()
    assert seen == [12, 4000]
    assert {r["model"]: r["accuracy"] for r in got}["tree"] == 1
