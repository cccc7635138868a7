"""Datasets as folders of splits, and other file forms."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Splits of a dataset folder, each a Parquet file or folder that may be missing (fixed values).
SPLITS = ("pretrain", "preval", "pretest", "train", "val", "test")


def _path(spark: SparkSession, at: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, at: str) -> bool:
    path, fs = _path(spark, at)
    return fs.exists(path)


def read_splits(spark: SparkSession, folder: str, splits: Sequence[str] = SPLITS) -> DataFrame:
    """All splits that exist, with a `split` column; columns that a split lacks are null."""
    found = [spark.read.parquet(f"{folder}/{s}.parquet").withColumn("split", F.lit(s)) for s in splits if exists(spark, f"{folder}/{s}.parquet")]
    if not found:
        raise FileNotFoundError(f"no split in {folder}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)


def write_splits(df: DataFrame, folder: str, splits: Sequence[str] = SPLITS) -> None:
    for s in splits:
        part = df.where(F.col("split") == s).drop("split")
        if not part.isEmpty():
            part.write.mode("overwrite").parquet(f"{folder}/{s}.parquet")


def read_delimited(spark: SparkSession, at: str, sep: str = ",", columns: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """A file with a header; `columns` {categorical, continuous} sets types instead of inferring them."""
    if columns is None:
        return spark.read.csv(at, header=True, sep=sep, inferSchema=True)
    raw = spark.read.csv(at, header=True, sep=sep)
    return raw.select(*[F.trim(c).alias(c) for c in columns.get("categorical", [])], *[F.trim(c).cast("double").alias(c) for c in columns.get("continuous", [])])


def write_delimited(df: DataFrame, at: str, sep: str = ",") -> None:
    df.write.mode("overwrite").csv(at, header=True, sep=sep)


def read_fixed_width(spark: SparkSession, at: str, fields: Mapping[str, tuple[int, int]]) -> DataFrame:
    """fields: name -> (first character from 1, length); blanks are null."""
    line = F.col("value")
    cut = lambda a, n: F.trim(F.substring(line, a, n))
    return spark.read.text(at).select(*[F.when(cut(a, n) != "", cut(a, n)).alias(name) for name, (a, n) in fields.items()])


def write_report(df: DataFrame, at: str) -> None:
    """Metrics as JSON lines."""
    df.write.mode("overwrite").json(at)


def read_info(spark: SparkSession, at: str) -> dict:
    """A small JSON description beside a dataset, read through Spark's file systems."""
    return json.loads("\n".join(r["value"] for r in spark.read.text(at, wholetext=True).collect()))


def random_codes(spark: SparkSession, domain: Mapping[str, int], rows: int, seed: str = "codes") -> DataFrame:
    """Uniform codes (size 1: a uniform number in [0, 1)); the same for the same seed."""
    u = lambda a: F.pmod(F.xxhash64("id", F.lit(a), F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)
    return spark.range(rows).select(*[(u(a) if n == 1 else F.floor(u(a) * n)).alias(a) for a, n in domain.items()])


def common_columns(tables: Sequence[DataFrame]) -> DataFrame:
    """Union of extracts over the columns that all have."""
    names = [c for c in tables[0].columns if all(c in t.columns for t in tables)]
    return reduce(DataFrame.unionByName, [t.select(*names) for t in tables])
