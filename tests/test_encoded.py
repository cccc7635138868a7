import math

from pyspark.sql import functions as F

from veilspark.operators import discretize, selection
from veilspark.plans.domain import Domain
from veilspark.sources import datasets, encoded


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, split string, kind string, x double")


def test_encoder_is_fitted_on_train_stored_and_inverted(spark, tmp_path):
    rows = [(i, "train", "abc"[i % 3], float(i)) for i in range(300)] + [(1000, "test", "z", 999.0), (1001, "test", "a", -5.0), (1002, "test", None, None)]
    at = f"file://{tmp_path}"
    for _ in range(2):  # fitted, then read back
        got = {r["id"]: r for r in encoded.encoded(frame(spark, rows), ["kind", "x"], f"{at}/encoder").collect()}
    assert [got[i]["kind"] for i in range(3)] == [0, 1, 2]
    assert (got[0]["x"], got[299]["x"]) == (0, 99)
    assert (got[1000]["kind"], got[1000]["x"], got[1001]["kind"], got[1001]["x"]) == (None, 99, 0, 0)
    assert got[1002]["kind"] is None and got[1002]["x"] is None
    assert discretize.domain_of(encoded.load_encoder(spark, f"{at}/encoder")) == {"kind": 3, "x": 100}
    encoded.write_decoded(encoded.encoded(frame(spark, rows), ["kind", "x"], f"{at}/encoder"), f"{at}/decoded", f"{at}/encoder")
    back = {r["id"]: r for r in datasets.read_splits(spark, f"{at}/decoded").collect()}
    assert all(back[i]["kind"] == "abc"[i % 3] and abs(back[i]["x"] - i) <= 299 / 200 + 1e-9 for i in range(300))


def test_empty_and_constant_columns(spark):
    fitted = discretize.Discretizer().fit(frame(spark, []), ["kind", "x"])
    assert fitted.ranges == {} and fitted.transform(frame(spark, [(1, "train", "a", 1.0)])).first()["kind"] is None
    one = discretize.Discretizer().fit(frame(spark, [(1, "train", "a", 2.0)] * 3), ["kind", "x"])
    assert [(r["kind"], r["x"]) for r in one.inverse(one.transform(frame(spark, [(1, "train", "a", 2.0)]))).collect()] == [("a", 2.0)]


def test_slots_drop_codes_outside_the_domain(spark):
    rows = spark.createDataFrame([(1, 0, 2), (2, 5, 1), (3, None, 0)], "id long, a long, b long")
    slots = discretize.hot_slots(rows, "id", {"a": 2, "b": 3})
    back = {r["id"]: (r["a"], r["b"]) for r in discretize.from_slots(slots, "id", {"a": 2, "b": 3}).collect()}
    assert back == {1: (0, 2), 2: (None, 1), 3: (None, 0)}


def test_running_total_is_the_least_variance_mean(spark):
    got = discretize.running_total(spark.createDataFrame([(10.0, 1.0), (16.0, 2.0)], "total double, variance double")).first()
    assert math.isclose(got["total"], 12.0) and math.isclose(got["variance"], 2 / 3)


def test_combined_cliques_and_isolated_attributes():
    domain = Domain({"a": 10, "b": 10, "c": 10, "d": 100, "e": 3})
    out = selection.combined([("a", "b"), ("b", "c"), ("c", "d"), ("b",)], domain, cells=2000)
    assert sorted(out) == [("a", "b", "c"), ("c", "d")]
    assert selection.isolated(domain, out) == ["e"]


def test_top_above(spark):
    scores = spark.createDataFrame([(1, 5.0), (2, 9.0), (3, 5.0), (4, 1.0)], "k long, s double")
    assert [r["k"] for r in selection.top_above(scores, "k", "s", 2, 4.0).collect()] == [2, 1]
    assert selection.top_above(scores, "k", "s", 9, 4.0).agg(F.count("*")).first()[0] == 3
