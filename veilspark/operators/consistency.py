"""Post-processing of noisy marginals: non-negativity and agreement on shared attributes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.domain import Clique, Domain, downward_closure
from ..sources.shared import Rounds
from .marginal import clique_name


def norm_cut(df: DataFrame, cell: str, n: str, *by: str) -> DataFrame:
    """Zeroes negative counts and then the smallest positive ones until as much is removed as was added; the last one is lowered.

    One task orders the cells of a marginal (`by`), whose number is bounded by its domain.
    """
    debt = F.sum(F.when(F.col(n) < 0, -F.col(n)).otherwise(0.0)).over(Window.partitionBy(*by))
    up = F.when(F.col(n) > 0, F.col(n)).otherwise(0.0)
    rows = df.withColumns({"_debt": debt, "_up": up})
    run = F.sum("_up").over(Window.partitionBy(*by).orderBy("_up", cell).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_run", run).withColumn(n, F.greatest(F.lit(0.0), F.least(F.col("_up"), F.col("_run") - F.col("_debt")))).drop("_debt", "_up", "_run")


def norm_sub(df: DataFrame, cell: str, n: str, *by: str) -> DataFrame:
    """Nearest non-negative counts with the same total, cut at 0: a shift of all cells, negatives cut.

    One task orders the cells of a marginal (`by`), whose number is bounded by its domain.
    """
    group = Window.partitionBy(*by)
    down = group.orderBy(F.desc(n), cell)
    rows = df.withColumn("_total", F.greatest(F.lit(0.0), F.sum(n).over(group)))
    run = F.sum(n).over(down.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_shift", (run - F.col("_total")) / F.row_number().over(down))
    shift = F.coalesce(F.max_by(F.when(F.col(n) > F.col("_shift"), F.col("_shift")), F.when(F.col(n) > F.col("_shift"), F.struct(-F.col(n), F.col(cell)))).over(group), F.lit(0.0))
    rows = rows.withColumn("_by", shift)
    return rows.withColumn(n, F.when(F.col("_total") > 0, F.greatest(F.lit(0.0), F.col(n) - F.col("_by"))).otherwise(0.0)).drop("_total", "_shift", "_by")


def consistent(cells: DataFrame, domain: Domain, cliques: Sequence[Clique], weights: Mapping[Clique, float] | None = None, rounds: int = 20) -> DataFrame:
    """`cells` (clique, k1.., n: every cell of every clique) with counts that agree wherever cliques share attributes, and are not negative.

    For each shared attribute set the projections' weighted mean becomes everyone's
    projection by an equal shift of the cells behind each value. Sets of one size are done
    together, small ones first: once the smaller ones agree, a shift for one set leaves
    the projections on the others of its size alone. Each size is a few aggregates and
    joins over the cells. Rounds end when no cell is negative; after `rounds` the last step
    is the cut, so counts are non-negative and nearly agree. Each step's table is written
    and its predecessor removed. Only whether a cell is negative comes to the driver.
    """
    weights = weights or dict.fromkeys(cliques, 1.0)
    shared = [()] + [s for s in downward_closure(cliques) if sum(set(s) <= set(c) for c in cliques) > 1]
    keys = [f"k{i + 1}" for i in range(max(map(len, cliques)))]
    tables = Rounds(cells.sparkSession, "consistent")
    rows = tables(cells.select("clique", *keys, F.col("n").cast("double").alias("n")))
    for _ in range(rounds):
        for size in sorted({len(s) for s in shared}):
            rows = tables(_agreed(rows, domain, cliques, [s for s in shared if len(s) == size], weights, keys))
            tables.only(rows)
        if rows.agg(F.min("n")).first()[0] >= -1e-9:
            break
        rows = tables(norm_sub(rows.withColumn("_cell", F.struct(*keys)), "_cell", "n", "clique").drop("_cell"))
        tables.only(rows)
    return rows


def _agreed(rows: DataFrame, domain: Domain, cliques: Sequence[Clique], shared: Sequence[Clique], weights: Mapping[Clique, float], keys: Sequence[str]) -> DataFrame:
    """The cells after one shift for each of the shared sets."""

    def views(c: Clique) -> Column:
        behind = lambda s: domain.size(c) / max(1, domain.size(s))
        mine = [s for s in shared if set(s) <= set(c)]
        value = lambda s: F.array(*[F.col(keys[c.index(a)]) for a in s]).cast("array<long>")
        parts = [F.struct(F.lit(clique_name(s)).alias("set"), value(s).alias("value"), F.lit(float(behind(s))).alias("behind"), F.lit(float(weights[c] / behind(s))).alias("share")) for s in mine]
        return F.array(*parts) if parts else F.lit(None)

    every = F.coalesce(*[F.when(F.col("clique") == clique_name(c), views(c)) for c in cliques])
    each = rows.select("clique", *keys, "n", F.explode_outer(every).alias("v")).select("clique", *keys, "n", "v.*")
    projected = each.where("set is not null").groupBy("clique", "set", "value", "behind", "share").agg(F.sum("n").alias("sum"))
    means = projected.groupBy("set", "value").agg((F.sum(F.col("share") * F.col("sum")) / F.sum("share")).alias("mean"))
    shifts = projected.join(means, ["set", "value"]).select("clique", "set", "value", ((F.col("mean") - F.col("sum")) / F.col("behind")).alias("shift"))
    return each.join(shifts, ["clique", "set", "value"], "left").groupBy("clique", *keys).agg((F.first("n") + F.coalesce(F.sum("shift"), F.lit(0.0))).alias("n"))
