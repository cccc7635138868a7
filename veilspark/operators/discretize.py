"""Whole tables to codes and back, and small recodings of raw columns."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.noise import keyed_gaussian, keyed_uniform
from ..functions.ranks import numbered_within, running, stretches
from ..functions.tables import at_most, literal
from .encode import DISTINCT, LOG_OFFSET, bin_draw, bounds, encode, log_bin, ordinal_map, uniform_bin
from .partition import dawa, fine_histogram, privtree


#: Ways to bin numbers: equal bins, equal bins of the logarithm, private splitting, private partition, none (numbers are coded by their values).
METHODS = ("uniform", "exp", "privtree", "dawa", "none")
#: Bins of the public histogram that the private ways work on.
FINE = 1024


@dataclass
class Discretizer:
    """Codes for the columns of a table, fitted once and applied to any table with these columns.

    Columns of fewer than `distinct` values and all columns that are not numbers are coded
    by the order of their values; other numbers are binned by `method`. The private ways
    spend `epsilon`, evenly over the binned columns, on `FINE` equal bins between the column's
    bounds, which they take as public. Values not seen in fitting become null, numbers beyond
    the bounds fall into the outer bins. Maps are written by the caller if they are to
    outlive the fitted table.
    """

    bins: int = 100
    distinct: int = DISTINCT
    maps: dict[str, DataFrame] = field(default_factory=dict)
    ranges: dict[str, tuple[float, float]] = field(default_factory=dict)
    method: str = "uniform"
    epsilon: float = 1.0
    rng: np.random.Generator | None = None
    #: Lower edges of the bins of each column that is binned in a private way.
    edges: dict[str, list[float]] = field(default_factory=dict)

    def fit(self, df: DataFrame, columns: Sequence[str]) -> Discretizer:
        """One pass of estimates says which numbers have far more values than `distinct`; the others are counted exactly, up to `distinct` values."""
        if self.method not in METHODS:
            raise ValueError(f"{self.method} is none of {METHODS}")
        many = [] if self.method == "none" else wide_columns(df, [c for c in columns if isinstance(df.schema[c].dataType, T.NumericType)], self.distinct)
        self.ranges = bounds(df, *many) if many else {}
        self.maps = {c: ordinal_map(df, c) for c in columns if c not in many}
        self.edges = {}
        for c, (lo, hi) in self.ranges.items() if self.method in ("privtree", "dawa") else ():
            split = privtree if self.method == "privtree" else dawa
            starts = split(fine_histogram(df, c, lo, hi, FINE), self.epsilon / len(self.ranges), rng=self.rng) if hi > lo else [0]
            self.edges[c] = [lo + (hi - lo) / FINE * i for i in starts]
        return self

    def _bin(self, c: str) -> Column:
        lo, hi = self.ranges[c]
        x = F.least(F.greatest(F.col(c).cast("double"), F.lit(lo)), F.lit(hi))
        if c in self.edges:
            return at_most(literal(np.array(self.edges[c])), len(self.edges[c]), x).cast("long") - 1
        return log_bin(x, lo, hi, self.bins) if self.method == "exp" and hi > lo else uniform_bin(x, lo, hi, self.bins)

    def _point(self, c: str, u: Column) -> Column:
        """The point at share u of a code's bin."""
        (lo, hi), code = self.ranges[c], F.col(c)
        if c in self.edges:
            ends = literal(np.array([*self.edges[c], hi]))
            left = F.get(ends, code.cast("int"))
            return left + (F.get(ends, code.cast("int") + 1) - left) * u
        if self.method == "exp" and hi > lo:
            first = math.log2(LOG_OFFSET)
            return F.pow(F.lit(2.0), first + (math.log2(hi - (lo - LOG_OFFSET)) - first) / self.bins * (code + u)) + (lo - LOG_OFFSET)
        return bin_draw(code, lo, hi, u, self.bins)

    def transform(self, df: DataFrame) -> DataFrame:
        binned = {c: F.when(F.col(c).isNotNull(), self._bin(c)) for c in self.ranges}
        return encode(df, self.maps).withColumns(binned) if binned else encode(df, self.maps)

    def inverse(self, df: DataFrame, key: str | None = None, seed: str = "inverse") -> DataFrame:
        """Values of codes; of a bin its middle or, with a key column, a point drawn evenly by a hash of the row's key."""
        for c, table in self.maps.items():
            df = df.join(table.select(F.col("code").alias("_c"), F.col("value").alias("_v")), F.col(c) == F.col("_c"), "left").withColumn(c, F.col("_v")).drop("_c", "_v")
        points = {c: self._point(c, F.lit(0.5) if key is None else keyed_uniform(seed + c, key)) for c in self.ranges}
        return df.withColumns(points) if points else df


def wide_columns(df: DataFrame, columns: Sequence[str], distinct: int = DISTINCT) -> list[str]:
    """The columns that have `distinct` values or more: by an estimate, and by counting up to `distinct` where that is near."""
    estimate = df.agg(*[F.approx_count_distinct(c).alias(c) for c in columns]).first() if columns else {}
    return [c for c in columns if estimate[c] >= 2 * distinct or df.select(c).where(F.col(c).isNotNull()).distinct().limit(distinct).count() >= distinct]


def budget_shares(df: DataFrame, numbers: Sequence[str], categories: Sequence[str], method: str, distinct: int = DISTINCT) -> tuple[float, float]:
    """Shares of the preparation's budget for binning numbers and for merging rare categories.

    By the numbers of columns that need it: those with `distinct` values or more. Numbers
    need a budget only in the private ways; without any such column both shares are 0.
    """
    n = len(wide_columns(df, numbers, distinct)) if method in ("privtree", "dawa") else 0
    m = len(wide_columns(df, categories, distinct))
    return (n / (n + m), m / (n + m)) if n + m else (0.0, 0.0)


@dataclass
class SignificantValues:
    """Codes 0.. for the values of a column whose noisy count is three deviations or more, in order, and one more for all others."""

    codes: DataFrame
    others: DataFrame
    kept: int

    @classmethod
    def fit(cls, df: DataFrame, column: str, sigma: float, seed: str) -> SignificantValues:
        """`codes`: value, code; `others`: value, place (from 0) of the values that share the last code. Null takes no part."""
        counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("_n"))
        kept = (F.col("_n") + keyed_gaussian(seed, sigma, "value") >= 3 * sigma).cast("int")
        ranked, total = running(counts.withColumn("_kept", kept), ["value"], ["_kept"])
        last = total["_kept"] or 0
        codes = ranked.select("value", F.when(F.col("_kept") == 1, F.col("_before__kept")).otherwise(F.lit(last)).cast("long").alias("code"))
        others = ranked.where("_kept = 0").select("value", (F.col("_rank") - F.col("_before__kept")).alias("place"))
        return cls(codes, others, last)

    def encode(self, df: DataFrame, column: str) -> DataFrame:
        return encode(df, {column: self.codes})

    def decode(self, df: DataFrame, column: str, key: str, seed: str = "decode") -> DataFrame:
        """Values of codes; the rows of the last code are dealt evenly to the merged values, in a keyed order, to within one row."""
        values, n = self.codes.where(F.col("code") < self.kept).select(F.col("code").alias("_c"), F.col("value").alias("_v")), self.others.count()
        u = keyed_uniform(seed, key)
        rare = numbered_within(df.where(F.col(column) == self.kept), [column], F.floor(u * stretches(df)), [u, key])
        rare = rare.withColumn("_place", F.floor(F.col("_position") * n / F.col("_size"))).join(self.others.withColumnRenamed("value", "_v"), F.col("_place") == F.col("place"), "left")
        rest = df.where(~F.coalesce(F.col(column) == self.kept, F.lit(False))).join(values, F.col(column) == F.col("_c"), "left")
        columns = [F.col("_v").alias(column) if c == column else F.col(c) for c in df.columns]
        return rest.select(*columns).unionByName(rare.select(*columns))


def domain_of(fitted: Discretizer) -> dict[str, int]:
    """Codes of each column."""
    return {c: m.count() for c, m in fitted.maps.items()} | {c: len(fitted.edges[c]) if c in fitted.edges else fitted.bins for c in fitted.ranges}


def rare_merged_noisy(df: DataFrame, column: str, sigma: float, share: float, seed: str, other: str = "R") -> DataFrame:
    """The column with `other` for values whose noisy count is below 3 sigma or at most `share` of the noisy total; null stays."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v")).agg(F.count("*").alias("_n"))
    noisy = counts.select("_v", (F.col("_n") + keyed_gaussian(seed, sigma, "_v")).alias("_y"))
    total = noisy.agg(F.sum(F.greatest(F.lit(0.0), "_y")).alias("_total"))
    rare = noisy.join(total).where((F.col("_y") < 3 * sigma) | (F.col("_y") <= F.col("_total") * share)).select("_v", F.lit(True).alias("_rare"))
    return df.join(rare, F.col(column) == F.col("_v"), "left").withColumn(column, F.when(F.col("_rare"), F.lit(other)).otherwise(F.col(column).cast("string"))).drop("_v", "_rare")


def time_bin(df: DataFrame, column: str, seconds: int, name: str) -> DataFrame:
    """Whole steps of `seconds` since the first time of the table."""
    first = df.agg(F.min(column).alias("_first"))
    since = F.unix_seconds(F.col(column).cast("timestamp")) - F.unix_seconds(F.col("_first").cast("timestamp"))
    return df.join(first).withColumn(name, F.floor(since / seconds).cast("long")).drop("_first")


def stepped(x: Column, edges: Sequence[float]) -> Column:
    """How many of the edges are at or below x: 0 below the first."""
    return F.when(x.isNotNull(), sum((F.when(x >= e, 1).otherwise(0) for e in edges), F.lit(0))).cast("long")


def hot_slots(df: DataFrame, key: str, domain: Mapping[str, int]) -> DataFrame:
    """key, slot: the ones of each row's one-hot vector over the attributes in order; codes outside a domain give none."""
    parts, start = [], 0
    for a, n in domain.items():
        parts.append(F.when(F.col(a).between(0, n - 1), F.col(a).cast("long") + start))
        start += n
    return df.select(key, F.explode(F.array_compact(F.array(*parts))).alias("slot"))


def from_slots(slots: DataFrame, key: str, domain: Mapping[str, int]) -> DataFrame:
    """key and the code of each attribute, from the ones of its one-hot vector."""
    out, start = [], 0
    for a, n in domain.items():
        out.append(F.min(F.when(F.col("slot").between(start, start + n - 1), F.col("slot") - start)).alias(a))
        start += n
    return slots.groupBy(key).agg(*out)


def running_total(totals: DataFrame, value: str = "total", variance: str = "variance") -> DataFrame:
    """total, variance: the combination of independent noisy totals that has the least variance."""
    weight = F.sum(1 / F.col(variance))
    return totals.agg((F.sum(F.col(value) / F.col(variance)) / weight).alias("total"), (1 / weight).alias("variance"))
