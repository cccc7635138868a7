"""Splits and public subsets of tables; imputation; relaxed rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.noise import keyed_uniform


def split(df: DataFrame, key: str, shares: Mapping[str, float], seed: str = "split") -> DataFrame:
    """Adds `split`: a hash of the key deals rows by the shares, the same on every run and engine."""
    u, upto, out = keyed_uniform(seed, key), 0.0, None
    for name, share in shares.items():
        upto += share
        out = F.when(u <= upto, name) if out is None else out.when(u <= upto, name)
    return df.withColumn("split", out.otherwise(list(shares)[-1]))


def stratified(df: DataFrame, key: str, label: str, share: float, seed: str = "strata") -> DataFrame:
    """Rows whose draw is among the first `share` of their label (at least one). Only thresholds are ordered within labels, from histograms of draws."""
    u = keyed_uniform(seed, key)
    rows = df.withColumn("_u", u).withColumn("_b", F.floor(u * 4096).cast("long"))
    sums = rows.groupBy(F.col(label).alias("_l"), "_b").agg(F.count("*").alias("_n"))
    w = Window.partitionBy("_l")
    sums = sums.withColumns({"_upto": F.sum("_n").over(w.orderBy("_b")), "_goal": F.greatest(F.lit(1), F.round(F.sum("_n").over(w) * share)).cast("long")})
    edge = sums.where("_upto >= _goal").groupBy("_l").agg(F.min(F.struct("_b", (F.col("_goal") - F.col("_upto") + F.col("_n")).alias("left"))).alias("e")).select("_l", "e._b", "e.left").toDF("_l", "_edge", "_left")
    rows = rows.join(edge, F.col(label).eqNullSafe(F.col("_l")))
    last = rows.where("_b = _edge").withColumn("_r", F.row_number().over(Window.partitionBy("_l").orderBy("_u", key))).where("_r <= _left").drop("_r")
    return rows.where("_b < _edge").unionByName(last).drop("_u", "_b", "_l", "_edge", "_left")


def biased(df: DataFrame, key: str, column: str, shares: Mapping[object, float], otherwise: float = 1.0, seed: str = "bias") -> DataFrame:
    """A public subset that keeps each value of a column at its own rate."""
    rate: Column = F.lit(otherwise)
    for value, share in shares.items():
        rate = F.when(F.col(column) == value, share).otherwise(rate)
    return df.where(keyed_uniform(seed, key) <= rate)


def corrupted(df: DataFrame, key: str, sizes: Mapping[str, int], share: float, seed: str = "wrong") -> DataFrame:
    """Moves each code of a share of rows by a non-zero offset modulo its domain."""
    for a, n in sizes.items():
        shift = 1 + F.floor(keyed_uniform(seed + a, key) * (n - 1)).cast("long")
        df = df.withColumn(a, F.when((keyed_uniform(seed, key) <= share) & (n > 1), F.pmod(F.col(a) + shift, F.lit(n))).otherwise(F.col(a)))
    return df


def imputed(df: DataFrame, key: str, column: str, shares: Sequence[float], seed: str = "fill") -> DataFrame:
    """Fills null codes by draws from the shares of the codes (for example a noisy marginal)."""
    upto, run = [], 0.0
    for s in shares[:-1]:
        run += s / sum(shares)
        upto.append(run)
    u = keyed_uniform(seed, key)
    draw = F.size(F.filter(F.array(*map(F.lit, upto)).cast("array<double>"), lambda p: p <= u)).cast("long")
    return df.withColumn(column, F.coalesce(F.col(column), draw))


def upsampled(df: DataFrame, key: str, weights: str, copies: int) -> DataFrame:
    """Each relaxed row (an array of probabilities of codes) as `copies` rows with codes in proportion: running shares rounded, every row by itself."""
    total = F.aggregate(weights, F.lit(0.0), lambda s, x: s + x)
    upto = F.transform(F.sequence(F.lit(1), F.size(weights)), lambda i: F.aggregate(F.slice(weights, 1, i), F.lit(0.0), lambda s, x: s + x) / total)
    rows = df.withColumn("_upto", upto).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    return rows.select(key, F.col("copy").cast("long").alias("copy"), F.size(F.filter("_upto", lambda p: p <= (F.col("copy") + 0.5) / copies)).cast("long").alias("code"))
