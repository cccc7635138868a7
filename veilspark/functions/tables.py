"""Small lookup tables as columns: literals below a size, else a join."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Numbers that a literal may hold (8 bytes each); numbers that a broadcast table may hold.
LITERAL, BROADCAST = 1 << 17, 10 << 20


def literal(values: np.ndarray) -> Column:
    """A constant array of doubles, or of arrays of them; Catalyst folds it once, tasks share it."""
    kind = "array<double>" if values.ndim == 1 else "array<array<double>>"
    return F.from_json(F.lit(json.dumps(values.tolist())), kind)


def looked_up(df: DataFrame, at: Column, values: np.ndarray, name: str) -> DataFrame:
    """`df` with column `name`: entry `at` (from 0) of `values`, null where `at` is null or outside.

    Up to LITERAL numbers the table is a literal and rows stay where they are; up to
    BROADCAST numbers it is broadcast; a larger one is joined.
    """
    at = F.when(at.between(0, len(values) - 1), at).cast("long")
    if values.size <= LITERAL:
        return df.withColumn(name, F.get(literal(values), at.cast("int")))
    table = df.sparkSession.createDataFrame(list(enumerate(values.tolist())), f"_at long, `{name}` {'double' if values.ndim == 1 else 'array<double>'}")
    table = F.broadcast(table) if values.size <= BROADCAST else table
    return df.withColumn("_at", at).join(table, "_at", "left").drop("_at")


def at_most(values: Column, size: int, x: Column) -> Column:
    """How many of the first `size` entries of an ascending array are at or below x; 0 where x is null.

    By bisection, with `x` and `values` evaluated once a row: a filter over the array
    would evaluate both for each of its entries.
    """
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(size.bit_length()))]) if size else F.array().cast("array<int>")

    def search(r: Column) -> Column:
        return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(r["v"], at + step - 1) <= r["x"], at + step).otherwise(at))

    return F.get(F.transform(F.array(F.struct(x.alias("x"), values.alias("v"))), search), 0)
