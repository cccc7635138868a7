"""Encoders from raw columns to dense integer codes, and back."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import running
from ..functions.tables import at_most, literal

#: Columns with fewer distinct values are coded by order, others are binned or merged.
DISTINCT = 100
#: What the least value is lifted to before its logarithm is taken.
LOG_OFFSET = 0.01


def ordinal_map(df: DataFrame, column: str) -> DataFrame:
    """value, code: rank of each distinct value in order, from 0. One row for each value."""
    values = df.where(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct()
    return running(values, ["value"])[0].select("value", F.col("_rank").alias("code"))


def frequency_map(df: DataFrame, column: str) -> DataFrame:
    """value, code, n: most frequent value first, ties by value."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return running(counts, [F.desc("n"), "value"])[0].select("value", F.col("_rank").alias("code"), "n")


def encode(df: DataFrame, maps: dict[str, DataFrame], suffix: str = "") -> DataFrame:
    """Replaces (or, with a suffix, adds) columns by their codes; values that a map lacks become null."""
    for column, table in maps.items():
        name = f"{column}{suffix}"
        codes = table.select(F.col("value").alias("_v"), F.col("code").alias("_c"))
        df = df.join(codes, F.col(column) == F.col("_v"), "left").withColumn(name, F.col("_c")).drop("_v", "_c")
    return df


def ordinal_encode(df: DataFrame, columns: Sequence[str], suffix: str = "") -> DataFrame:
    return encode(df, {c: ordinal_map(df, c) for c in columns}, suffix)


def bounds(df: DataFrame, *columns: str) -> dict[str, tuple[float, float]]:
    """Least and greatest value of each column, in one pass."""
    row = df.agg(*[f(c).cast("double").alias(f"{n}_{i}") for i, c in enumerate(columns) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    return {c: (row[f"lo_{i}"], row[f"hi_{i}"]) for i, c in enumerate(columns)}


def uniform_bin(x: Column, lo: float, hi: float, bins: int = 100) -> Column:
    """Equal-width bin, the greatest value in the last one; a constant column is bin 0."""
    width = (hi - lo) / bins
    return (F.least(F.lit(bins - 1), F.floor((x - lo) / width)) if width > 0 else F.when(x.isNotNull(), F.lit(0))).cast("long")


def log_bin(x: Column, lo: float, hi: float, bins: int = 100, offset: float = LOG_OFFSET) -> Column:
    """Equal-width bin of log2(x - (lo - offset))."""
    from math import log2

    return uniform_bin(F.log2(x - (lo - offset)), log2(offset), log2(hi - (lo - offset)), bins)


def bin_middle(code: Column, lo: float, hi: float, bins: int = 100) -> Column:
    return lo + (hi - lo) / bins * (code + 0.5)


def bin_draw(code: Column, lo: float, hi: float, u: Column, bins: int = 100) -> Column:
    """A uniform point of the bin; `u` in (0, 1)."""
    return lo + (hi - lo) / bins * (code + u)


def interval_code(x: Column, edges: Sequence[float]) -> Column:
    """Number of the left-closed interval [edges[i], edges[i + 1]) that holds x; null outside."""
    inner = at_most(literal(np.array(edges, float)), len(edges), x) - 1
    return F.when((x >= edges[0]) & (x < edges[-1]), inner).cast("long")


def subnet(address: Column, bits: int) -> Column:
    """Leading bits of a 32-bit address."""
    return F.shiftright(address, 32 - bits)


def power_bin(x: Column, base: float) -> Column:
    return F.floor(F.log(x) / F.log(F.lit(float(base)))).cast("long")


def port_bin(port: Column, well_known: int = 1024, step: int = 100) -> Column:
    """Ports below `well_known` stay; others fall into steps."""
    return F.when(port < well_known, port).otherwise(well_known + F.floor((port - well_known) / step)).cast("long")


def rare_merged(df: DataFrame, column: str, threshold: float, other: str = "R") -> DataFrame:
    """The column with values of share `threshold` or less replaced by `other`."""
    counts = df.groupBy(F.col(column).alias("_v")).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_total"))
    rare = counts.join(total).where(F.col("_n") <= F.col("_total") * threshold).select("_v", F.lit(True).alias("_rare"))
    return df.join(rare, F.col(column) == F.col("_v"), "left").withColumn(column, F.when(F.col("_rare"), F.lit(other)).otherwise(F.col(column).cast("string"))).drop("_v", "_rare")


def minmax(x: Column, lo: float, hi: float, a: float = 0.0, b: float = 1.0) -> Column:
    return F.lit(a) + ((x - lo) / (hi - lo) * (b - a) if hi > lo else x * 0)


def rescaled_99(x: Column, lo: float, hi: float) -> Column:
    """0 to 99, halves to even; a constant column is 0."""
    return (F.bround(99 * (x - lo) / (hi - lo)) if hi > lo else x * 0).cast("long")


def quantile_rows(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """lo, hi: the observed values at or above the low and at or below the high quantile."""
    from math import ceil, floor

    rows = df.where(F.col(column).isNotNull())
    counts, total = running(rows.groupBy(column).agg(F.count("*").alias("n")), [column], ["n"])
    pick = lambda i: F.min(F.when(F.col("_before_n") + F.col("n") > i, F.col(column)))
    return counts.agg(pick(ceil(low * (total["n"] - 1))).alias("lo"), pick(floor(high * (total["n"] - 1))).alias("hi"))


def standardised(df: DataFrame, column: str, name: str) -> DataFrame:
    """(x - mean) / population deviation."""
    return df.join(df.agg(F.avg(column).alias("_m"), F.stddev_pop(column).alias("_s"))).withColumn(name, (F.col(column) - F.col("_m")) / F.col("_s")).drop("_m", "_s")


def leave_one_out(df: DataFrame, column: str, y: str, name: str) -> DataFrame:
    """Mean of y over the other rows of the same value, null where there are none.

    Sums are taken by an aggregation with map-side combine and joined back, so a hot value
    does not gather its rows in one task.
    """
    sums = df.groupBy(F.col(column).alias("_v")).agg(F.sum(y).alias("_s"), F.count(y).alias("_n"))
    own = F.coalesce(F.col(y), F.lit(0))
    others = F.col("_n") - F.col(y).isNotNull().cast("int")
    return df.join(sums, F.col(column).eqNullSafe(F.col("_v"))).withColumn(name, F.when(others > 0, (F.col("_s") - own) / others)).drop("_v", "_s", "_n")


def one_hot_counts(df: DataFrame, maps: dict[str, DataFrame]) -> DataFrame:
    """attr, code, n: column sums of the one-hot matrix, without building it."""
    from functools import reduce

    coded = encode(df, maps)
    from .marginal import marginals

    counts = marginals(coded, [(a,) for a in maps]).select(F.col("clique").alias("attr"), F.col("k1").alias("code"), "n")
    every = reduce(DataFrame.unionByName, [m.select(F.lit(a).alias("attr"), "code") for a, m in maps.items()])
    return every.join(counts, ["attr", "code"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def empirical_cdf(df: DataFrame, column: str, name: str = "cdf") -> DataFrame:
    """Average rank / n of each row's value."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v")).agg(F.count("*").alias("_n"))
    counts, total = running(counts, ["_v"], ["_n"])
    ranks = counts.select("_v", ((F.col("_before__n") + (F.col("_n") + 1) / 2) / F.lit(total["_n"])).alias(name))
    return df.join(ranks, F.col(column) == F.col("_v"), "left").drop("_v")


def rare_by_rows(df: DataFrame, column: str, share: float, other: str = "__rare__") -> DataFrame:
    """Values with fewer than round(rows * share) occurrences become `other`; null stays."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v")).agg(F.count("*").alias("_n"))
    total = df.agg(F.count("*").alias("_total"))
    rare = counts.join(total).where(F.col("_n") < F.bround(F.col("_total") * share)).select("_v", F.lit(True).alias("_rare"))
    return df.join(rare, F.col(column) == F.col("_v"), "left").withColumn(column, F.when(F.col("_rare"), F.lit(other)).otherwise(F.col(column).cast("string"))).drop("_v", "_rare")


# Wichura's rational approximations of the normal quantile (algorithm AS 241, the
# double-precision form), numerators and denominators by falling powers.
_CENTRE = (
    (2.5090809287301226727e3, 3.3430575583588128105e4, 6.7265770927008700853e4, 4.5921953931549871457e4, 1.3731693765509461125e4, 1.9715909503065514427e3, 1.3314166789178437745e2, 3.3871328727963666080),
    (5.2264952788528545610e3, 2.8729085735721942674e4, 3.9307895800092710610e4, 2.1213794301586595867e4, 5.3941960214247511077e3, 6.8718700749205790830e2, 4.2313330701600911252e1, 1.0),
)
_FLANK = (
    (7.74545014278341407640e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1, 1.27045825245236838258, 3.64784832476320460504, 5.76949722146069140550, 4.63033784615654529590, 1.42343711074968357734),
    (1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2, 1.48103976427480074590e-1, 6.89767334985100004550e-1, 1.67638483018380384940, 2.05319162663775882187, 1.0),
)
_TAIL = (
    (2.01033439929228813265e-7, 2.71155556874348757815e-5, 1.24266094738807843860e-3, 2.65321895265761230930e-2, 2.96560571828504891230e-1, 1.78482653991729133580, 5.46378491116411436990, 6.65790464350110377720),
    (2.04426310338993978564e-15, 1.42151175831644588870e-7, 1.84631831751005468180e-5, 7.86869131145613259100e-4, 1.48753612908506148525e-2, 1.36929880922735805310e-1, 5.99832206555887937690e-1, 1.0),
)


def _ratio(parts: tuple, x: Column) -> Column:
    def polynomial(coefficients: tuple) -> Column:
        out = F.lit(coefficients[0])
        for c in coefficients[1:]:
            out = out * x + c
        return out

    return polynomial(parts[0]) / polynomial(parts[1])


def inverse_normal(p: Column) -> Column:
    """Quantile of the standard normal distribution, to about 16 digits; infinite at 0 and 1."""
    q = p - 0.5
    r = F.sqrt(-F.log(F.least(p, 1 - p)))
    tail = F.signum(q) * F.when(r <= 5, _ratio(_FLANK, r - 1.6)).otherwise(_ratio(_TAIL, r - 5))
    end = F.when(p == 0, float("-inf")).when(p == 1, float("inf"))
    return F.when(F.abs(q) <= 0.425, q * _ratio(_CENTRE, 0.180625 - q * q)).otherwise(F.coalesce(end, tail))


def quantile_normal(df: DataFrame, column: str, name: str) -> DataFrame:
    """Normal scores: the inverse normal of each value's average rank share, (rank - 1/2) / n."""
    n = df.where(F.col(column).isNotNull()).agg(F.count("*").alias("_n"))
    out = empirical_cdf(df, column, "_cdf").join(n)
    return out.withColumn(name, inverse_normal(F.col("_cdf") - 0.5 / F.col("_n"))).drop("_cdf", "_n")
