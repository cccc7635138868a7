"""Nearest observed values for synthetic numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def snapped(df: DataFrame, observed: DataFrame, column: str, buckets: int = 1024) -> DataFrame:
    """The column moved to the nearest observed value, ties to the smaller one.

    Both sides fall into equal-width buckets of the observed range; a bucket knows the
    nearest values outside it, so only rows of one bucket meet. Values repeat in neither
    side of the join: distinct observed values are kept, and a hot value of `df` is one of
    many rows that look up the same array.
    """
    row = observed.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi")).first()
    if row["lo"] is None:
        return df.withColumn(column, F.lit(None).cast("double"))
    lo, width = row["lo"], max((row["hi"] - row["lo"]) / buckets, 1e-300)
    bucket = F.least(F.lit(buckets - 1), F.greatest(F.lit(0), F.floor((F.col(column).cast("double") - lo) / width))).cast("int")
    values = observed.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("_v"), bucket.alias("_b")).distinct()
    held = values.groupBy("_b").agg(F.array_sort(F.collect_list("_v")).alias("_in"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    every = observed.sparkSession.range(buckets).select(F.col("id").cast("int").alias("_b")).join(held, "_b", "left")
    up = Window.orderBy("_b")
    every = every.withColumns({"_below": F.last("_max", True).over(up.rowsBetween(Window.unboundedPreceding, -1)), "_above": F.first("_min", True).over(up.rowsBetween(1, Window.unboundedFollowing))})
    near = F.filter(F.concat(F.array("_below", "_above"), F.coalesce("_in", F.array().cast("array<double>"))), lambda v: v.isNotNull())
    every = every.select("_b", near.alias("_near"))
    x = F.col(column).cast("double")
    best = F.array_min(F.transform("_near", lambda v: F.struct(F.abs(v - x).alias("d"), v.alias("v"))))
    return df.withColumn("_b", bucket).join(every, "_b", "left").withColumn(column, best.getField("v")).drop("_b", "_near")
