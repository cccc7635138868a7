"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each row draws an exponential key, -ln(u) / weight. Within a source the rows
with the smallest keys are taken until their sizes fill the source's token budget. Whole
epochs come first; only the rest of a budget selects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

#: Bits of a draw's place that one pass over the draws settles, and passes.
BITS, PASSES = 10, 2
PLACES = 1 << BITS * PASSES
#: Equal rows that one task numbers.
EQUAL_ROWS = 100_000


def uniform(seed: str, *keys: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of md5(seed|keys), alike in every engine."""
    text = [F.coalesce(k.cast("string"), F.lit("null")) for k in keys]
    bits = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), *text)), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / F.lit(float(2**52))


def numbered(rows: DataFrame, narrow: DataFrame, by: list[str]) -> DataFrame:
    """`rows` with `occurrence`: rows that are equal in the columns `by` count from 1, in any order.

    `narrow` holds the same rows with the columns `by` alone, in a table. Rows without an equal
    one, nearly all, do not move. The others are dealt into stretches of bounded size before
    they are numbered, so a row that fills a third of the table is never in one task.
    """
    again = narrow.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1")
    again = written(again.select(*[F.col(c).alias(f"_{c}") for c in by], F.ceil(F.col("n") / EQUAL_ROWS).cast("int").alias("_stretches")), "mix-again")
    if again.isEmpty():
        return rows.withColumn("occurrence", F.lit(1).cast("long"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    extra = [f"_{c}" for c in by]
    marked = rows.join(again, same, "left")
    alone = marked.where("_stretches is null").drop(*extra, "_stretches").withColumn("occurrence", F.lit(1).cast("long"))
    dealt = written(marked.where("_stretches is not null").withColumn("_stretch", F.pmod(F.monotonically_increasing_id(), F.col("_stretches")).cast("int")).drop("_stretches"), "mix-equal")
    sizes = dealt.groupBy(*extra, "_stretch").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy(*extra).orderBy("_stretch")) - F.col("_n")).drop("_n")
    before = before.toDF(*[f"_{c}" for c in before.columns])
    place = F.row_number().over(Window.partitionBy(*extra, "_stretch").orderBy(F.lit(1)))
    found = dealt.withColumn("occurrence", place.cast("long")).join(before, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in [*extra, "_stretch"]])
    found = found.withColumn("occurrence", F.col("occurrence") + F.col("__before"))
    return alone.unionByName(found.select(*alone.columns))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target from source, source_size.

    Sources in order of their code points, null last, weigh `weights` in turn and share
    `share` of all sizes. A target stops at `most` times its source's size and the excess
    is shared again by weight until none is above: targets are least(most * size, level *
    weight) for the level at which they add up. One row for each source; the rows of this
    aggregated table are ordered by one task.
    """
    turn = F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights)))
    rows = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn + 1)).withColumn("cap", most * F.col("source_size"))
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everywhere = Window.partitionBy()
    before = F.coalesce(F.sum("cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by_fill.rowsBetween(0, Window.unboundedFollowing))
    level = (share * F.sum("source_size").over(everywhere) - before) / rest
    level = F.when(level <= F.col("cap") / F.col("weight"), level)
    rows = rows.withColumn("level", level).withColumn("level", F.max("level").over(everywhere))
    return rows.select("source", "source_size", F.coalesce(F.least("cap", F.col("level") * F.col("weight")), F.col("cap")).alias("target"))


def draw(quality: Column, seed: str, *keys: Column) -> Column:
    """The exponential key; a quality that is null or not above 0 counts as 1e-6."""
    return -F.log(uniform(seed, *keys)) / F.greatest(F.coalesce(quality.cast("double"), F.lit(0.0)), F.lit(1e-6))


def place(drawn: Column) -> Column:
    """Which of PLACES stretches of the half-line a draw falls in; grows with the draw."""
    return F.least(F.lit(PLACES - 1), F.floor(drawn / (1 + drawn) * PLACES)).cast("long")


def cuts(rows: DataFrame, goal: DataFrame) -> DataFrame:
    """Where each source's fractional epoch ends: source, source_size, target, epochs, place, cut.

    rows: source, size, draw; goal: the result of targets(). Draws of lesser places are
    selected, and in `place` those up to `cut` (null: none). Each pass adds up the sizes
    by the next digit of the place inside the stretch in which the budget ends; only the
    last stretch, a millionth of the half-line, is ordered.
    """
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    edge = goal.withColumns({"budget": F.greatest(F.lit(0.0), F.col("target") - F.col("epochs") * F.col("source_size")), "place": F.lit(0).cast("long"), "before": F.lit(0).cast("long")})
    names = ["source", "source_size", "target", "epochs", "budget", "place", "before"]
    edge = written(edge.select(names), "mix-edge")
    rows = rows.withColumn("at", place(F.col("draw")))
    inside = lambda shift: rows.withColumnRenamed("source", "s").join(edge, F.col("s").eqNullSafe(F.col("source"))).where(F.shiftright("at", shift) == F.col("place"))
    for left in range(PASSES - 1, -1, -1):
        digit = F.shiftright("at", left * BITS)
        sums = inside((left + 1) * BITS).groupBy(*names, digit.alias("next")).agg(F.sum("size").alias("words"))
        sums = sums.withColumn("upto", F.col("before") + F.sum("words").over(Window.partitionBy("source").orderBy("next")))
        last = sums.where(F.col("upto") >= F.col("budget")).groupBy(*names).agg(F.min(F.struct("next", "upto", "words")).alias("e"))
        last = last.select(*names[:5], F.col("e.next").alias("place"), (F.col("e.upto") - F.col("e.words")).alias("before"))
        edge = written(last, "mix-edge")
    upto = F.col("before") + F.sum("size").over(Window.partitionBy("source").orderBy("draw").rangeBetween(Window.unboundedPreceding, 0))
    ends = inside(0).withColumn("upto", upto).where(F.col("upto") - F.col("size") / 2 <= F.col("budget")).groupBy("source").agg(F.max("draw").alias("cut"))
    ends = ends.withColumnRenamed("source", "s")
    return written(edge.join(ends, F.col("source").eqNullSafe(F.col("s")), "left").select(*names[:4], "place", "cut"), "mix-cuts")


def mix(docs: DataFrame, size: Column, quality: Column, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, key: str = "doc_id", source: str = "source", text: str = "text", seed: str = "mix", carry: tuple[str, ...] = ()) -> DataFrame:
    """row, size, source_size, target, times (how often the mix takes it) and taken (its words, repeats counted) of every document.

    row is a struct of the key and the columns named in `carry`. `size` (null: 0) and `quality` are columns of `docs`. A document of the fractional
    epoch is selected if half of it or more lies within the rest of its source's budget,
    so a source's taken words miss its target by half a document at most. Every row has a draw
    of its own, from `seed`, its key, a digest of its text and, among rows equal in both, their number: null and
    repeated keys and repeated rows are selected one by one. Texts never move: a narrow table of source, size
    and draw is written and summed by digits of the draw, so a hot source is never
    in one task, and the cuts, one row for each source, are joined to the documents. A
    null source is a source of its own; an empty table gives an empty result.
    """
    name = [F.col(c) for c in dict.fromkeys([key, *carry])]
    weight = F.greatest(F.coalesce(quality.cast("double"), F.lit(0.0)), F.lit(1e-6))
    digest = F.md5(F.coalesce(F.col(text), F.lit("")))
    rows = docs.select(F.struct(*name).alias("row"), F.col(key).cast("string").alias("key"), F.col(source).alias("source"), F.coalesce(size.cast("long"), F.lit(0).cast("long")).alias("size"), weight.alias("weight"), digest.alias("digest"))
    by = ["key", "source", "digest"]
    narrow = written(rows if not carry else rows.drop("row"), "mix-narrow")
    drawn = lambda x: numbered(x, narrow.select(*by), by).withColumn("draw", draw(F.col("weight"), seed, F.col("key"), F.col("digest"), F.col("occurrence"))).drop("key", "digest", "weight", "occurrence")
    narrow_drawn = written(drawn(narrow), "mix-rows")
    goal = targets(narrow_drawn.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    ends = cuts(narrow_drawn.select("source", "size", "draw"), goal).withColumnRenamed("source", "s")
    chosen = (place(F.col("draw")) < F.col("place")) | ((place(F.col("draw")) == F.col("place")) & (F.col("draw") <= F.col("cut")))
    times = F.col("epochs") + F.coalesce(chosen, F.lit(False)).cast("long")
    out = (drawn(rows) if carry else narrow_drawn).join(ends, F.col("source").eqNullSafe(F.col("s")))
    return out.select("row", "size", "source_size", "target", times.alias("times"), (times * F.col("size")).alias("taken"))


def repeated(docs: DataFrame, size: Column, quality: Column, key: str = "doc_id", source: str = "source", **how) -> DataFrame:
    """The rows of `docs`, all columns, each as often as the mix takes it (see mix)."""
    mixed = mix(docs, size, quality, key=key, source=source, carry=tuple(docs.columns), **how)
    return mixed.where("times > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("turn")).select("row.*")
