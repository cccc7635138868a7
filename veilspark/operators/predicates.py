"""Counting queries: conjunctive predicates, half-spaces, prefixes, ranges over histograms."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

def conjunction(terms: Mapping[str, object]) -> Column:
    """attribute -> (lo, hi) for a closed range, or a value for equality."""
    return reduce(Column.__and__, [F.col(a).between(*t) if isinstance(t, tuple) else F.col(a) == t for a, t in terms.items()])


def query_rows(spark: SparkSession, queries: Sequence[Mapping[str, object]], attrs: Sequence[str]) -> DataFrame:
    """query, <attr>_lo, <attr>_hi of the queries over exactly `attrs`, and a row of nulls that stands for all rows."""
    rows = [(i, *[x for a in attrs for x in (q[a] if isinstance(q[a], tuple) else (q[a], q[a]))]) for i, q in enumerate(queries) if set(q) == set(attrs)]
    rows = [tuple(float(x) if any(isinstance(r[j], float) for r in rows) else x for j, x in enumerate(row)) for row in rows]
    return spark.createDataFrame([*rows, (None,) * (1 + 2 * len(attrs))], ["query", *[f"{a}_{end}" for a in attrs for end in ("lo", "hi")]])


def counted(df: DataFrame, queries: Sequence[Mapping[str, object]], values: Mapping[str, Column]) -> DataFrame:
    """query (null: all rows) and the sum of each of `values` over the rows that satisfy each conjunction.

    Rows are added up once for each set of attributes that queries name; the queries are
    a small table that meets the distinct tuples, so neither scans nor generated code grow
    with the number of queries. A null attribute satisfies no query.
    """
    parts = []
    sums = [F.sum(c).alias(c) for c in values]
    for attrs in dict.fromkeys(tuple(sorted(q)) for q in queries):
        asked = query_rows(df.sparkSession, queries, attrs)
        cells = df.groupBy(*attrs).agg(*[F.sum(v.cast("long")).alias(name) for name, v in values.items()])
        inside = reduce(Column.__and__, [F.col(a).between(F.col(f"{a}_lo"), F.col(f"{a}_hi")) for a in attrs])
        met = cells.join(F.broadcast(asked), F.col("query").isNull() | inside).select("query", *values)
        parts.append(met.union(asked.select("query", *[F.lit(0).cast("long") for _ in values])).groupBy("query").agg(*sums))
    every = [part.where("query is not null") for part in parts[1:]]
    return reduce(DataFrame.unionByName, [parts[0], *every])


def shares(df: DataFrame, queries: Sequence[Mapping[str, object]], values: Mapping[str, Column]) -> DataFrame:
    """query (from 0) and, for each of `values`, n_<name> and <name>, the share of the sum over all rows (null if that is 0)."""
    total = lambda c: F.max(F.when(F.col("query").isNull(), F.col(c))).over(Window.partitionBy())  # noqa: E731  one row for each query
    out = counted(df, queries, values)
    return out.select("query", *[x for c in values for x in (F.col(c).alias(f"n_{c}"), F.try_divide(c, total(c)).alias(c))]).where("query is not null")


def selectivities(df: DataFrame, queries: Sequence[Mapping[str, object]]) -> DataFrame:
    """query (from 0), n, share of rows that satisfy each conjunction; see `counted`."""
    return shares(df, queries, {"share": F.lit(1)}).select("query", F.col("n_share").alias("n"), "share")


def dot(columns: Sequence[str], weights: Sequence[float]) -> Column:
    return reduce(Column.__add__, [F.col(c) * float(w) for c, w in zip(columns, weights, strict=True)])


def halfspaces(df: DataFrame, columns: Sequence[str], planes: Sequence[tuple[Sequence[float], float]], target: str, smooth: float | None = None) -> DataFrame:
    """plane, target, share of all rows with the target value on the plane's upper side (smooth: a sigmoid of that steepness)."""
    side = lambda z: F.when(z > 0, 1.0).otherwise(0.0) if smooth is None else 1 / (1 + F.exp(-smooth * z))
    sums = df.groupBy(F.col(target).alias("target")).agg(F.count("*").alias("n"), *[F.sum(side(dot(columns, w) - float(b))).alias(f"p{i}") for i, (w, b) in enumerate(planes)])
    total = sums.agg(F.sum("n").alias("total"))
    each = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("plane"), F.col(f"p{i}").alias("s")) for i in range(len(planes))]))
    return sums.join(total).select("target", "total", each.alias("e")).select("e.plane", "target", (F.col("e.s") / F.col("total")).alias("share"))


def prefixes(df: DataFrame, thresholds: Sequence[Mapping[str, float]], target: str, smooth: float | None = None) -> DataFrame:
    """prefix, target, share of all rows with the target value above every threshold."""
    above = lambda t: reduce(Column.__mul__, [F.when(F.col(c) > v, 1.0).otherwise(0.0) if smooth is None else 1 / (1 + F.exp(-smooth * (F.col(c) - v))) for c, v in t.items()])
    sums = df.groupBy(F.col(target).alias("target")).agg(F.count("*").alias("n"), *[F.sum(above(t)).alias(f"p{i}") for i, t in enumerate(thresholds)])
    total = sums.agg(F.sum("n").alias("total"))
    each = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("prefix"), F.col(f"p{i}").alias("s")) for i in range(len(thresholds))]))
    return sums.join(total).select("target", "total", each.alias("e")).select("e.prefix", "target", (F.col("e.s") / F.col("total")).alias("share"))


def histogram(df: DataFrame, attr: str, size: int) -> DataFrame:
    """code, n of every code of the domain."""
    counts = df.groupBy(F.col(attr).cast("long").alias("code")).agg(F.count("*").alias("n"))
    return df.sparkSession.range(size).toDF("code").join(counts, "code", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def prefix_sums(hist: DataFrame) -> DataFrame:
    return hist.select("code", F.sum("n").over(Window.orderBy("code").rowsBetween(Window.unboundedPreceding, 0)).alias("n"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    return hist.select("code", F.sum("n").over(Window.orderBy("code").rowsBetween(0, Window.unboundedFollowing)).alias("n"))


def all_ranges(hist: DataFrame) -> DataFrame:
    """lo, hi, n of every range of codes, from two prefix sums each."""
    upto = prefix_sums(hist)
    below = hist.select(F.col("code").alias("lo"), (F.sum("n").over(Window.orderBy("code").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    return upto.select(F.col("code").alias("hi"), F.col("n").alias("upto")).join(below, F.col("lo") <= F.col("hi")).select("lo", "hi", (F.col("upto") - F.col("before")).alias("n"))


def width_ranges(hist: DataFrame, width: int) -> DataFrame:
    """lo, n of every range of `width` codes."""
    w = Window.orderBy("code")
    n = F.sum("n").over(w.rowsBetween(0, width - 1))
    return hist.select(F.col("code").alias("lo"), n.alias("n"), F.count("*").over(w.rowsBetween(0, width - 1)).alias("_c")).where(F.col("_c") == width).drop("_c")


def boxes(table: DataFrame, queries: DataFrame, axes: Sequence[str]) -> DataFrame:
    """query, n: count of each box (columns query and <axis>_lo, <axis>_hi) over a histogram of the axes with n."""
    inside = reduce(Column.__and__, [F.col(a).between(F.col(f"{a}_lo"), F.col(f"{a}_hi")) for a in axes])
    return queries.join(table, inside, "left").groupBy("query").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"))


def prefix_2d(table: DataFrame, a: str, b: str) -> DataFrame:
    """a, b, n: counts of all cells up to (a, b), by two running sums over a filled table."""
    first = table.withColumn("n", F.sum("n").over(Window.partitionBy(a).orderBy(b)))
    return first.select(a, b, F.sum("n").over(Window.partitionBy(b).orderBy(a)).alias("n"))


def moments(hist: DataFrame, orders: Sequence[int]) -> DataFrame:
    """k, moment: sum of code ** k over rows."""
    row = hist.agg(*[F.sum(F.pow(F.col("code").cast("double"), F.lit(k)) * F.col("n")).alias(f"m{k}") for k in orders])
    each = F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.col(f"m{k}").alias("moment")) for k in orders]))
    return row.select(each.alias("e")).select("e.k", "e.moment")


def haar(hist: DataFrame, size: int) -> DataFrame:
    """level, block, n: difference of the sums of a dyadic block's halves; level 0 is the widest. size: a power of two."""
    parts = []
    width, level = size, 0
    while width > 1:
        half = width // 2
        sign = F.when(F.pmod("code", F.lit(width)) < half, F.col("n")).otherwise(-F.col("n"))
        parts.append(hist.groupBy(F.floor(F.col("code") / width).alias("block")).agg(F.sum(sign).alias("n")).select(F.lit(level).cast("long").alias("level"), "block", "n"))
        width, level = half, level + 1
    return reduce(DataFrame.unionByName, parts)


def range_2d(table: DataFrame, a: str, b: str, queries: DataFrame) -> DataFrame:
    """query, n: counts of boxes (query, a_lo, a_hi, b_lo, b_hi) from four corners of the prefix table each, so a box costs the same whatever it holds."""
    upto = prefix_2d(table, a, b).select(F.col(a).alias("x"), F.col(b).alias("y"), "n")
    corner = lambda x, y, s: F.struct(F.col(x).cast("long").alias("x"), F.col(y).cast("long").alias("y"), F.lit(s).alias("sign"))
    low = queries.withColumns({"a_lo": F.col("a_lo") - 1, "b_lo": F.col("b_lo") - 1})
    corners = F.array(corner("a_hi", "b_hi", 1), corner("a_lo", "b_hi", -1), corner("a_hi", "b_lo", -1), corner("a_lo", "b_lo", 1))
    met = low.select("query", F.explode(corners).alias("c")).select("query", "c.x", "c.y", "c.sign").join(upto, ["x", "y"], "left")
    return met.groupBy("query").agg(F.coalesce(F.sum(F.col("n") * F.col("sign")), F.lit(0)).cast("long").alias("n"))


def disjunctions(df: DataFrame, queries: Sequence[Sequence[Mapping[str, object]]]) -> DataFrame:
    """query, n: rows that satisfy at least one conjunction of each query, all of one pass over the distinct tuples of the queried attributes."""
    attrs = sorted({a for q in queries for terms in q for a in terms})
    cells = df.groupBy(*attrs).agg(F.count("*").alias("n"))
    some = lambda q: F.sum(F.when(reduce(Column.__or__, map(conjunction, q)), F.col("n")))
    row = cells.agg(*[F.coalesce(some(q), F.lit(0)).cast("long").alias(f"q{i}") for i, q in enumerate(queries)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("query"), F.col(f"q{i}").alias("n")) for i in range(len(queries))])).alias("e")).select("e.*")


def ranges(hist: DataFrame, queries: DataFrame) -> DataFrame:
    """query, n: counts of ranges (query, lo, hi) of codes, two prefix sums each; a range without codes counts 0."""
    upto = prefix_sums(hist)
    ends = queries.select("query", F.explode(F.array(F.struct("hi", F.lit(1).alias("sign")), F.struct((F.col("lo") - 1).alias("hi"), F.lit(-1).alias("sign")))).alias("e"))
    met = ends.select("query", F.col("e.hi").alias("code"), "e.sign").join(upto, "code", "left")
    return met.groupBy("query").agg(F.coalesce(F.sum(F.col("n") * F.col("sign")), F.lit(0)).cast("long").alias("n"))
