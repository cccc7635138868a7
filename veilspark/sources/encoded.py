"""Tables as codes with the encoder that made them, and back to values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.discretize import Discretizer
from .datasets import exists, write_splits


def save_encoder(fitted: Discretizer, spark: SparkSession, folder: str) -> None:
    """One table of codes for each mapped column and one of the bounds of binned ones."""
    for c, table in fitted.maps.items():
        table.write.mode("overwrite").parquet(f"{folder}/map_{c}")
    rows = [(c, "bins", lo, hi) for c, (lo, hi) in fitted.ranges.items()] + [(c, "map", None, None) for c in fitted.maps]
    rows = [(*r, fitted.edges.get(r[0])) for r in rows]
    columns = spark.createDataFrame(rows, "attr string, kind string, lo double, hi double, edges array<double>")
    columns.withColumns({"bins": F.lit(fitted.bins), "distinct": F.lit(fitted.distinct), "method": F.lit(fitted.method)}).coalesce(1).write.mode("overwrite").parquet(f"{folder}/columns")


def load_encoder(spark: SparkSession, folder: str) -> Discretizer:
    rows = spark.read.parquet(f"{folder}/columns").collect()  # a row for each column
    out = Discretizer(rows[0]["bins"], rows[0]["distinct"], method=rows[0]["method"]) if rows else Discretizer()
    out.edges = {r["attr"]: list(r["edges"]) for r in rows if r["edges"]}
    out.ranges = {r["attr"]: (r["lo"], r["hi"]) for r in rows if r["kind"] == "bins"}
    out.maps = {r["attr"]: spark.read.parquet(f"{folder}/map_{r['attr']}") for r in rows if r["kind"] == "map"}
    return out


def encoded(splits: DataFrame, columns: list[str], folder: str, fit_on: str = "train", encoder: Discretizer | None = None) -> DataFrame:
    """Codes of all splits by the encoder stored in `folder`; where none is stored, one (`encoder`, unfitted) is fitted on the split `fit_on` alone and stored."""
    spark = splits.sparkSession
    if not exists(spark, f"{folder}/columns"):
        save_encoder((encoder or Discretizer()).fit(splits.where(F.col("split") == fit_on), columns), spark, folder)
    return load_encoder(spark, folder).transform(splits)


def write_decoded(codes: DataFrame, folder: str, encoder: str, key: str | None = None) -> None:
    """Values of coded rows as dataset splits (rows without a split are `train`); with a key column, points drawn inside their bins instead of middles."""
    rows = load_encoder(codes.sparkSession, encoder).inverse(codes, key)
    write_splits(rows if "split" in rows.columns else rows.withColumn("split", F.lit("train")), folder)
