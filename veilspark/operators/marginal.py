"""Marginals: counts of attribute combinations, many cliques in one pass."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.domain import Clique, Domain

#: Grouping sets that share a pass; each multiplies the rows of the expansion.
SETS_A_PASS = 32


def clique_name(clique: Clique) -> str:
    return ",".join(clique)


def marginals(df: DataFrame, cliques: Sequence[Clique], weight: str | None = None, collapse: bool = True) -> DataFrame:
    """clique, k1..kd (bigint codes), n for every occupied cell of every clique.

    Rows that are null in an attribute of a clique do not count for it. With `collapse`
    equal attribute tuples are first added up, so the expansion into grouping sets works
    on distinct tuples, not on rows; both steps combine on the map side.
    """
    width = max(map(len, cliques))
    parts = []
    for lo in range(0, len(cliques), SETS_A_PASS):
        batch = list(cliques[lo : lo + SETS_A_PASS])
        attrs = list(dict.fromkeys(a for c in batch for a in c))
        unit = F.col(weight).cast("double") if weight else F.lit(1).cast("long")
        rows = df.select(*[F.col(a).cast("long").alias(a) for a in attrs], unit.alias("_n"))
        if collapse:
            rows = rows.groupBy(*attrs).agg(F.sum("_n").alias("_n"))
        total = rows.groupingSets([[F.col(a) for a in c] for c in batch], *[F.col(a) for a in attrs]).agg(F.sum("_n").alias("n"), F.grouping_id().alias("_gid"))
        gid = {c: sum(1 << (len(attrs) - 1 - i) for i, a in enumerate(attrs) if a not in c) for c in batch}
        pick = lambda value: F.coalesce(*[F.when(F.col("_gid") == gid[c], value(c)) for c in batch])  # noqa: B023, E731
        keys = [pick(lambda c, j=j: F.col(c[j]) if j < len(c) else F.lit(None).cast("long")).alias(f"k{j + 1}") for j in range(width)]
        whole = reduce(Column.__and__, [(F.col("_gid") != gid[c]) | F.expr(" and ".join(f"`{a}` is not null" for a in c)) for c in batch])
        parts.append(total.where(whole).select(pick(lambda c: F.lit(clique_name(c))).alias("clique"), *keys, "n"))
    return reduce(DataFrame.unionByName, parts)


def cells(spark, domain: Domain, clique: Clique) -> DataFrame:
    """All cells of a clique: one column for each attribute."""
    out = spark.range(domain[clique[0]]).toDF(clique[0])
    for a in clique[1:]:
        out = out.withColumn(a, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(domain[a] - 1).cast("long"))))
    return out


def zero_filled(df: DataFrame, domain: Domain, clique: Clique) -> DataFrame:
    """Attributes and n of every cell of the public domain, occupied or not; codes outside it are an error."""
    counts = df.select(*[F.col(a).cast("long").alias(a) for a in clique]).na.drop().groupBy(*clique).agg(F.count("*").alias("n"))
    bad = reduce(Column.__or__, [(F.col(a) < 0) | (F.col(a) >= domain[a]) for a in clique])
    counts = counts.withColumn("n", F.when(bad, F.raise_error(F.lit(f"code outside the domain of {clique_name(clique)}"))).otherwise(F.col("n")))
    return cells(df.sparkSession, domain, clique).join(counts, list(clique), "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def cell_id(domain: Domain, clique: Clique) -> Column:
    """Mixed-radix number of a cell, last attribute fastest."""
    return reduce(Column.__add__, [F.col(a).cast("long") * step for a, step in domain.strides(clique).items()])


def cell_codes(domain: Domain, clique: Clique, cell: Column) -> list[Column]:
    """The codes of a cell number."""
    return [F.pmod(F.floor(cell / step), F.lit(domain[a])).cast("long").alias(a) for a, step in domain.strides(clique).items()]


def project(marginal: DataFrame, attrs: Sequence[str]) -> DataFrame:
    """A smaller marginal from a larger one."""
    return marginal.groupBy(*attrs).agg(F.sum("n").alias("n"))


def pivoted(marginal: DataFrame, rows: str, columns: str, codes: Sequence[int]) -> DataFrame:
    """Count matrix of a two-way marginal with the given codes as columns."""
    out = marginal.groupBy(rows).pivot(columns, list(codes)).agg(F.sum("n"))
    return out.select(rows, *[F.coalesce(F.col(str(c)), F.lit(0).cast("long")).alias(f"c{c}") for c in codes])


def conditional(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """feature, code, target, n, p: counts and shares of each feature's codes within each target code."""
    m = marginals(df, [(f, target) for f in features])
    totals = m.groupBy("clique", F.col("k2").alias("t")).agg(F.sum("n").alias("of"))
    out = m.join(totals.withColumnRenamed("clique", "c"), (F.col("clique") == F.col("c")) & (F.col("k2") == F.col("t")))
    return out.select(F.split("clique", ",")[0].alias("feature"), F.col("k1").alias("code"), F.col("k2").alias("target"), "n", (F.col("n") / F.col("of")).alias("p"))


def independent_product(df: DataFrame, a: str, b: str) -> DataFrame:
    """a, b, expected: the two-way table that the one-way marginals imply."""
    one = lambda x: df.where(F.col(x).isNotNull()).groupBy(F.col(x).cast("long").alias(x)).agg(F.count("*").alias(f"n_{x}"))
    total = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).agg(F.count("*").alias("total"))
    return one(a).join(one(b)).join(total).select(a, b, (F.col(f"n_{a}") * F.col(f"n_{b}") / F.col("total")).alias("expected"))


def merged_measurements(measurements: DataFrame) -> DataFrame:
    """clique, cell, y: repeated measurements of a cell by their weights."""
    return measurements.groupBy("clique", "cell").agg((F.sum(F.col("weight") * F.col("y")) / F.sum("weight")).alias("y"))


def support(df: DataFrame, attrs: Sequence[str]) -> DataFrame:
    """Distinct rows with their share of all rows."""
    counts = df.groupBy(*attrs).agg(F.count("*").alias("n"))
    return counts.join(counts.agg(F.sum("n").alias("total"))).select(*attrs, (F.col("n") / F.col("total")).alias("share"))


def missing_support(df: DataFrame, domain: Domain, clique: Clique) -> DataFrame:
    """Cells of the domain that no row occupies."""
    return cells(df.sparkSession, domain, clique).join(df.select(*[F.col(a).cast("long").alias(a) for a in clique]).distinct(), list(clique), "left_anti")


def dependence(df: DataFrame, attrs: Sequence[str]) -> DataFrame:
    """clique, indif: L1 distance of each pair's counts from those of independence, empty cells included.

    With p the occupied cells' expected mass, the empty cells add total - p, so no cell
    has to be listed that no row occupies.
    """
    from itertools import combinations

    pairs = list(combinations(attrs, 2))
    m = marginals(df.na.drop(subset=list(attrs)), [*pairs, *((a,) for a in attrs)])
    one = m.where(~F.col("clique").contains(",")).select(F.col("clique").alias("attr"), F.col("k1").alias("code"), F.col("n").alias("m"))
    two = m.where(F.col("clique").contains(",")).withColumn("a", F.split("clique", ",")[0]).withColumn("b", F.split("clique", ",")[1])
    left, right = (one.select(F.col("attr").alias(x), F.col("code").alias(k), F.col("m").alias(f"n_{x}")) for x, k in (("a", "k1"), ("b", "k2")))
    total = one.where(F.col("attr") == attrs[0]).agg(F.sum("m").alias("total"))
    joined = two.join(left, ["a", "k1"]).join(right, ["b", "k2"]).join(total)
    expected = F.col("n_a") * F.col("n_b") / F.col("total")
    return joined.groupBy("clique", "total").agg(F.sum(F.abs(F.col("n") - expected)).alias("occupied"), F.sum(expected).alias("covered")).select("clique", (F.col("occupied") + F.col("total") - F.col("covered")).alias("indif"))
