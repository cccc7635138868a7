"""Scores of synthetic against real tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import running
from ..plans.domain import Clique
from .marginal import marginals
from .predicates import shares

SIDE = "_side"


def marginal_tvd(real: DataFrame, synthetic: DataFrame, cliques: Sequence[Clique]) -> DataFrame:
    """clique, tvd: half the L1 distance of the cell shares.

    Both tables are counted in one pass over their union with the side as a further
    attribute; a cell that one side lacks counts 0, so no outer join is needed.
    """
    sides = []
    for df, side in ((real, 0), (synthetic, 1)):
        attrs = list(dict.fromkeys(a for c in cliques for a in c))
        sides.append(df.select(*attrs, F.lit(side).alias(SIDE)))
    cells = marginals(sides[0].unionByName(sides[1]), [(*c, SIDE) for c in cliques])
    width = max(map(len, cliques)) + 1
    at = F.size(F.split("clique", ","))
    side = F.coalesce(*[F.when(at == j, F.col(f"k{j}")) for j in range(2, width + 1)])
    keys = [F.when(at > j, F.col(f"k{j}")).alias(f"k{j}") for j in range(1, width)]
    cells = cells.select(F.regexp_replace("clique", f",{SIDE}$", "").alias("clique"), *keys, side.alias("side"), "n")
    totals = cells.groupBy("clique").agg(*[F.sum(F.when(F.col("side") == i, F.col("n")).otherwise(0)).alias(f"t{i}") for i in (0, 1)])
    counts = cells.groupBy("clique", *[f"k{j}" for j in range(1, width)]).agg(*[F.sum(F.when(F.col("side") == i, F.col("n")).otherwise(0)).alias(f"n{i}") for i in (0, 1)])
    return counts.join(totals, "clique").groupBy("clique").agg((F.sum(F.abs(F.col("n0") / F.col("t0") - F.col("n1") / F.col("t1"))) / 2).alias("tvd"))


def tvd_kinds(numeric: Sequence[str], categorical: Sequence[str], label: str | None) -> dict[Clique, str]:
    """Kind of every pair of attributes: num-num, num-cat, cat-cat, num-y, cat-y."""
    kind = {a: "num" for a in numeric} | {a: "cat" for a in categorical} | ({label: "y"} if label else {})
    return {(a, b): f"{kind[a]}-{kind[b]}" for a, b in combinations(kind, 2)}


def query_error(real: DataFrame, synthetic: DataFrame, queries: Sequence[Mapping[str, object]]) -> DataFrame:
    """query, real, synthetic, error: selectivities on both tables, counted in one pass with the side as a value, and their distance."""
    attrs = list(dict.fromkeys(a for q in queries for a in q))
    both = real.select(*attrs, F.lit(0).alias(SIDE)).unionByName(synthetic.select(*attrs, F.lit(1).alias(SIDE)))
    out = shares(both, queries, {"real": F.col(SIDE) == 0, "synthetic": F.col(SIDE) == 1})
    return out.select("query", "real", "synthetic", F.abs(F.col("real") - F.col("synthetic")).alias("error"))


def error_summary(errors: DataFrame, column: str, *by: str) -> DataFrame:
    """n, mean, max, min, total, median, mse, population deviation of an error column."""
    x = F.col(column)
    return errors.groupBy(*by).agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.max(x).alias("max"), F.min(x).alias("min"), F.sum(x).alias("total"),
        F.percentile(x, F.lit(0.5)).alias("median"), F.avg(x * x).alias("mse"), F.stddev_pop(x).alias("deviation"),
    )


def classification(df: DataFrame, actual: str, predicted: str, weight: str | None = None) -> DataFrame:
    """accuracy and macro-averaged F1 from one pass of confusion counts; a class that is never actual or predicted does not count. A row stands for `weight` rows."""
    n = F.sum(weight) if weight else F.count("*")
    pairs = df.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull()).groupBy(F.col(actual).alias("a"), F.col(predicted).alias("p")).agg(n.alias("n"))
    same = F.when(F.col("a") == F.col("p"), F.col("n")).otherwise(0)
    one = lambda c: pairs.select(F.col(c).alias("c"), same.alias("hit"), "n")
    sides = one("a").groupBy("c").agg(F.sum("hit").alias("tp"), F.sum("n").alias("na")).join(one("p").groupBy("c").agg(F.sum("n").alias("np")), "c", "full")
    f1 = 2 * F.coalesce("tp", F.lit(0)) / (F.coalesce("na", F.lit(0)) + F.coalesce("np", F.lit(0)))
    return sides.agg((F.sum("tp") / F.sum("na")).alias("accuracy"), F.avg(f1).alias("macro_f1"))


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """auc by the rank sum; tied scores share their average rank. Ranks come from counts of distinct scores."""
    counts = df.where(F.col(label).isin(0, 1) & F.col(score).isNotNull()).groupBy(score).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("pos"))
    counts, _ = running(counts, [score], ["n"])
    rank = F.col("_before_n") + (F.col("n") + 1) / 2.0
    sums = counts.withColumn("rank", rank).agg(F.sum(F.col("rank") * F.col("pos")).alias("r"), F.sum("pos").alias("p"), F.sum(F.col("n") - F.col("pos")).alias("q"))
    return sums.select(((F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("q"))).alias("auc"))


def regression(df: DataFrame, actual: str, predicted: str, weight: str | None = None) -> DataFrame:
    """rmse, r2. A row stands for `weight` rows."""
    y, p = F.col(actual), F.col(predicted)
    rows = df.where(y.isNotNull() & p.isNotNull())
    if weight:
        w = F.col(weight)
        rows = rows.join(rows.agg((F.sum(w * y) / F.sum(w)).alias("_mean")))
        off, spread = F.sum(w * (y - p) * (y - p)), F.sum(w * (y - F.col("_mean")) * (y - F.col("_mean")))
        return rows.agg(F.sqrt(off / F.sum(w)).alias("rmse"), (1 - off / spread).alias("r2"))
    return rows.agg(F.sqrt(F.avg((y - p) * (y - p))).alias("rmse"), (1 - F.sum((y - p) * (y - p)) / (F.count("*") * F.var_pop(y))).alias("r2"))


def runs_summary(df: DataFrame, value: Column, *by: str) -> DataFrame:
    """n, mean, deviation (population) of a metric over runs."""
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("deviation"))
