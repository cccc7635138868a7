"""Ranks, running sums and row numbers without a one-task sort."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import settled

#: Rows of a stretch, in expectation, that a task numbers at once.
STRETCH = 100_000


def _per_range(values: list[int | float]) -> Column:
    kind = "array<double>" if any(isinstance(v, float) for v in values) else "array<bigint>"
    return F.get(F.from_json(F.lit(json.dumps(values)), kind), F.col("_range"))


def running(df: DataFrame, order: Sequence[Column | str], sums: Sequence[str] = ()) -> tuple[DataFrame, dict[str, int | float]]:
    """(`df` with _rank, from 0, and _before_<s>, the sum of each column of `sums` over all rows before, in the given total order; {"rows": n, s: its sum}).

    Rows are dealt to ranges of the order, as many as the session has shuffle partitions,
    and written; a range's offsets are the sums of the ranges before it, one number for
    each range on the driver. So no task sorts more than a range, and a range of a column
    without repeats is balanced by sampling. Rows that are equal in the whole order are
    numbered in any order.
    """
    spark = df.sparkSession
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    held = settled(df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    rows = {r["_range"]: r for r in held.groupBy("_range").agg(F.count("*").alias("_rows"), *[F.sum(s).alias(s) for s in sums]).collect()}
    before: dict[str, list] = {name: [] for name in ("_rows", *sums)}
    upto: dict[str, int | float] = dict.fromkeys(before, 0)
    for i in range(max(rows, default=-1) + 1):
        for name in before:
            before[name].append(upto[name])
            upto[name] += (rows[i][name] or 0) if i in rows else 0
    at = Window.partitionBy("_range").orderBy(*order)
    so_far = at.rowsBetween(Window.unboundedPreceding, -1)
    columns = {"_rank": _per_range(before["_rows"]) + F.row_number().over(at) - 1}
    columns |= {f"_before_{s}": _per_range(before[s]) + F.coalesce(F.sum(s).over(so_far), F.lit(0)) for s in sums}
    return held.withColumns(columns).drop("_range"), {"rows": upto["_rows"]} | {s: upto[s] for s in sums}


def stretches(df: DataFrame, rows: int = STRETCH) -> int:
    """Number of stretches of about `rows` rows for a table."""
    return max(1, math.ceil(df.count() / rows))


def numbered_within(df: DataFrame, by: Sequence[str], stretch: Column, order: Sequence[Column | str], position: str = "_position", size: str = "_size") -> DataFrame:
    """`df` with each row's position (from 0) among the rows of its group and the group's size.

    The order inside a group is the stretch number first, then `order`, which must be a
    total order. A window holds one stretch of one group, so a group that has half of all
    rows is spread over tasks by its stretches; their counts, one row for each stretch and
    group, are added up by a window over a group's stretches. Null keys form a group.
    """
    cut = df.withColumn("_stretch", stretch.cast("long"))
    keys = [*by, "_stretch"]
    counts = cut.groupBy(*keys).agg(F.count("*").alias("_n"))
    group = Window.partitionBy(*by)
    upto = group.orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_offset"), F.sum("_n").over(group).alias(size))
    met = cut.join(offsets, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return met.withColumn(position, F.col("_offset") + place).drop("_offset", "_stretch", *[f"_k{i}" for i in range(len(keys))])
