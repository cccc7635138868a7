"""Multiplicative weights over a table of supported cells.

The distribution is a table: one row for each cell with the logarithm of its weight. A
round answers all queries from it in one pass, and the rows of the query that is answered
worst are moved towards the measured answer. Only that one query comes to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.domain import Clique
from ..sources.shared import Rounds
from .marginal import clique_name, marginals

#: Rounds whose moves are kept as expressions before the table is written anew.
SETTLE = 8


def measured_shares(df: DataFrame, cliques: Sequence[Clique], weight: str | None = None) -> DataFrame:
    """clique, k1.., share: the answers of all occupied cells of all cliques as shares of the table."""
    counts = marginals(df, cliques, weight)
    return counts.join(F.broadcast(counts.groupBy("clique").agg(F.sum("n").alias("of"))), "clique").withColumn("share", F.col("n") / F.col("of")).drop("n", "of")


def worst(answers: DataFrame, weighted: DataFrame, cliques: Sequence[Clique]) -> DataFrame:
    """The one query of the greatest absolute error, its error (measured minus weighted), ties to the first clique and codes."""
    keys = ["clique", *[f"k{i + 1}" for i in range(max(map(len, cliques)))]]
    both = answers.select(*keys, F.col("share").alias("y")).unionByName(weighted.select(*keys, (-F.col("share")).alias("y")))
    off = both.groupBy(*keys).agg(F.sum("y").alias("error"))
    order = F.struct((-F.abs("error")).alias("a"), *[F.coalesce(F.col(k), F.lit(-1).cast(off.schema[k].dataType)).alias(k) for k in keys])
    return off.agg(F.min_by(F.struct(*keys, "error"), order).alias("w")).select("w.*")


def multiplicative_weights(support: DataFrame, answers: DataFrame, cliques: Sequence[Clique], rounds: int, prior: str | None = None, settle: int = SETTLE) -> tuple[DataFrame, list[float]]:
    """(columns of `support` with last, mean: the last weights and the mean of all rounds' weights, each a share; the worst error before each round).

    `answers` has the measured share of cells (clique, k1.., share); cells of a clique that
    it does not hold count as measured 0. `prior`: a column of first weights, else all cells
    weigh alike; cells of null or non-positive weight stay at 0. A round multiplies the
    weights of the worst query's cells by exp(measured - weighted) and divides by the sum.
    The measured answers are written once, the weights every `settle` rounds, and what is
    replaced is removed; between, a round is one narrow expression on the row, whatever the
    number of queries. Rounds after a worst error of 0 change nothing. An empty support
    gives an empty result.
    """
    spark = support.sparkSession
    tables, kept = Rounds(spark, "weights"), Rounds(spark, "answers")
    held = kept(answers)
    attrs = list(dict.fromkeys(a for c in cliques for a in c))
    first = F.when(F.col(prior) > 0, F.log(F.col(prior).cast("double"))) if prior else F.lit(0.0)
    rows = tables(support.select("*", first.alias("_log"), F.lit(0.0).alias("_mean")))
    errors: list[float] = []
    state = F.col("_log"), F.col("_mean")
    by_name = {clique_name(c): c for c in cliques}
    scale = _scale(rows, state[0])
    for k in range(rounds):
        if scale is None:
            break
        weight = F.exp(state[0] - scale)
        weighted = measured_shares(rows.select(*attrs, F.coalesce(weight, F.lit(0.0)).alias("_w")), cliques, "_w")
        query = worst(held, weighted, cliques).first()
        errors.append(abs(query["error"]))
        inside = reduce(Column.__and__, [F.col(a) == query[f"k{i + 1}"] for i, a in enumerate(by_name[query["clique"]])])
        log = F.when(inside, state[0] + float(query["error"])).otherwise(state[0])
        scale = _scale(rows, log)
        state = log, state[1] + F.coalesce(F.exp(log - scale), F.lit(0.0)) / rounds
        if (k + 1) % settle == 0 and k + 1 < rounds:
            rows = tables(rows.withColumns({"_log": state[0] - scale, "_mean": state[1]}))
            tables.only(rows)
            state, scale = (F.col("_log"), F.col("_mean")), 0.0
    last = F.lit(0.0) if scale is None else F.coalesce(F.exp(state[0] - scale), F.lit(0.0))
    out = tables(rows.select(*support.columns, last.alias("last"), state[1].alias("mean")))
    tables.only(out)
    kept.only()
    return out, errors


def _scale(rows: DataFrame, log: Column) -> float | None:
    """Logarithm of the sum of all weights, safe from overflow; None if no row has a weight."""
    top = rows.agg(F.max(log)).first()[0]
    return None if top is None else top + rows.agg(F.log(F.sum(F.exp(log - top)))).first()[0]
