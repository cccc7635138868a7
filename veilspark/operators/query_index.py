"""Numbers of a workload's queries, their one-hot positions and their attribute codes, either way.

The queries of a workload are all cells of its cliques, numbered clique after clique with
the last attribute fastest. In the one-hot layout each attribute owns a range of positions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.domain import Clique, Domain
from .marginal import clique_name

#: Rows of the offset tables up to which they are broadcast.
BROADCAST = 1 << 18


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST else df


def layout(spark: SparkSession, domain: Domain) -> DataFrame:
    """attr, place, first, last: the positions of each attribute in the one-hot layout."""
    rows, at = [], 0
    for i, a in enumerate(domain):
        rows.append((a, i, at, at + domain[a] - 1))
        at += domain[a]
    return spark.createDataFrame(rows, "attr string, place int, first long, last long")


def offsets(spark: SparkSession, domain: Domain, cliques: Sequence[Clique]) -> DataFrame:
    """clique, from, to, part, attr, step, size: the query numbers of each clique (to: the last), a row for each of its attributes."""
    rows, at = [], 0
    for c in cliques:
        rows += [(clique_name(c), at, at + domain.size(c) - 1, i, a, step, domain[a]) for i, (a, step) in enumerate(domain.strides(c).items())]
        at += domain.size(c)
    return spark.createDataFrame(rows, "clique string, `from` long, `to` long, part int, attr string, step long, size long")


def all_queries(spark: SparkSession, domain: Domain, cliques: Sequence[Clique]) -> DataFrame:
    """query: every number of the workload."""
    return spark.range(sum(domain.size(c) for c in cliques)).toDF("query")


def positions(queries: DataFrame, domain: Domain, cliques: Sequence[Clique]) -> DataFrame:
    """The rows of `queries` (a column query) with clique and positions, the one-hot positions of its cell in the clique's order.

    A range join on the first numbers of the cliques; a number outside the workload or null
    has null clique and positions.
    """
    spark = queries.sparkSession
    of = offsets(spark, domain, cliques).join(F.broadcast(layout(spark, domain)).select("attr", "first"), "attr")
    of = of.groupBy("clique", "from", "to").agg(F.array_sort(F.collect_list(F.struct("part", "step", "size", "first"))).alias("_parts"))  # a clique's attributes
    met = queries.join(_small(of, len(cliques)), F.col("query").between(F.col("from"), F.col("to")), "left")
    cell = F.col("query") - F.col("from")
    at = F.transform("_parts", lambda p: p["first"] + F.pmod(F.floor(cell / p["step"]), p["size"]))
    return met.select(*queries.columns, "clique", at.alias("positions"))


def codes(queries: DataFrame, domain: Domain) -> DataFrame:
    """The rows of `queries` (a column positions: an array) with one column for each attribute: its code, -1 where the query does not name it.

    The ranges of the layout are a row for each attribute and meet a position as constants
    of the plan, so queries stay where they are. Of two positions of one attribute the
    last counts; positions outside the layout name nothing; null positions give -1 all over.
    """
    at, columns = 0, {}
    for a in domain:
        lo, hi = at, at + domain[a]
        inside = F.filter("positions", lambda p: (p >= lo) & (p < hi))  # noqa: B023
        columns[a] = F.coalesce(F.try_element_at(inside, F.lit(-1)) - lo, F.lit(-1)).cast("long")
        at = hi
    return queries.withColumns(columns)


def numbers(cells: DataFrame, domain: Domain, cliques: Sequence[Clique]) -> DataFrame:
    """The rows of `cells` (clique, k1.. codes as `marginals` gives them) with query, the cell's number; null for a clique outside the workload or codes outside the domain."""
    spark = cells.sparkSession
    of = offsets(spark, domain, cliques).groupBy("clique", "from").agg(F.array_sort(F.collect_list(F.struct("part", "step", "size"))).alias("_parts"))
    met = cells.join(_small(of, len(cliques)), "clique", "left")
    keys = F.array(*[F.col(f"k{i + 1}") for i in range(max(map(len, cliques)))])
    terms = F.transform("_parts", lambda p: F.when(F.get(keys, p["part"]).between(0, p["size"] - 1), F.get(keys, p["part"]) * p["step"]))
    return met.withColumn("query", F.col("from") + F.aggregate(terms, F.lit(0).cast("long"), lambda s, x: s + x)).select(*cells.columns, "query")


def answered(counts: DataFrame, domain: Domain, cliques: Sequence[Clique]) -> DataFrame:
    """query, clique, positions, a code for each attribute, n: every query of the workload, n 0 where no cell is in `counts` (clique, k1.., n)."""
    spark = counts.sparkSession
    every = codes(positions(all_queries(spark, domain, cliques), domain, cliques), domain)
    n = numbers(counts, domain, cliques).where("query is not null").select("query", "n")
    return every.join(n, "query", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def matches(domain: Domain, query: Sequence[int]) -> Column:
    """Whether a coded row satisfies a query that is given as codes, -1 for any."""
    terms = [F.col(a) == int(v) for a, v in zip(domain, query, strict=True) if v >= 0]
    out = F.lit(True)
    for t in terms:
        out = out & t
    return out
