from pyspark.sql import functions as F

from veilspark.sources import datasets
from veilspark.streaming.marginals import windowed_marginal


def test_splits_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5, "train"), (2, None, "val"), (3, 1.5, "train")], "a int, b double, split string")
    datasets.write_splits(df, f"file://{tmp_path}/d")
    back = datasets.read_splits(spark, f"file://{tmp_path}/d")
    assert sorted(map(tuple, back.select("a", "b", "split").collect())) == sorted(map(tuple, df.collect()))


def test_delimited_and_fixed_width(spark, tmp_path):
    df = spark.createDataFrame([("x", 1.0), ("y", 2.5)], "k string, v double")
    datasets.write_delimited(df, f"file://{tmp_path}/t", "\t")
    assert sorted(map(tuple, datasets.read_delimited(spark, f"file://{tmp_path}/t", "\t", {"categorical": ["k"], "continuous": ["v"]}).collect())) == [("x", 1.0), ("y", 2.5)]
    (tmp_path / "f.txt").write_text("ab  12\ncd    \n")
    assert [tuple(r) for r in datasets.read_fixed_width(spark, f"file://{tmp_path}/f.txt", {"k": (1, 2), "n": (5, 2)}).collect()] == [("ab", "12"), ("cd", None)]


def test_random_codes_and_reports(spark, tmp_path):
    codes = datasets.random_codes(spark, {"a": 3, "x": 1}, 500)
    row = codes.agg(F.min("a").alias("lo"), F.max("a").alias("hi"), F.min("x").alias("x0"), F.max("x").alias("x1")).first()
    assert (row["lo"], row["hi"]) == (0, 2) and 0 <= row["x0"] < row["x1"] < 1
    datasets.write_report(codes.limit(1), f"file://{tmp_path}/r")
    (tmp_path / "info.json").write_text('{"task_type": "binclass"}')
    assert datasets.read_info(spark, f"file://{tmp_path}/info.json") == {"task_type": "binclass"}
    assert datasets.common_columns([codes, codes.select("a")]).columns == ["a"]


def test_stream_counts_equal_table_counts(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:10:00", "a"), ("2024-01-01 00:50:00", "a"), ("2024-01-01 01:10:00", "b")], "t string, k string").select(F.to_timestamp("t").alias("t"), "k")
    rows.write.parquet(f"{tmp_path}/in")
    stream = windowed_marginal(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), "t", ["k"], "1 hour", "1 hour")
    query = stream.writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, windowed_marginal(rows, "t", ["k"], "1 hour", "1 hour").collect()))
