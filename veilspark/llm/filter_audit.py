"""How the filters of a filtering chain interact, for every order in which they may be applied.

Documents become counts of cells: a part of the table and a mask of the filters that the
document fails. A recursive CTE extends prefixes of orders letter by letter with the bits
applied so far; a level emits its step's metrics for each mask. The masks are bounded by
the filters, so the recursion never grows with the table; counts meet it afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: The letters of conditions A to D of `failures` and of the repeat condition.
LETTERS = "ABCDE"
#: One document in so many salts, where null keys would otherwise meet in one task.
SALTS = 1024


def failures(text: Column) -> list[Column]:
    """Conditions A to D on a text: few words, few distinct words, capitals, odd characters."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    capitals = F.regexp_count(text, F.lit("[A-Z]"))
    return [F.size(words) < 200, 100 * F.size(F.array_distinct(words)) < 50 * F.size(words), 100 * capitals > 3 * F.length(text), text.rlike("[#$%&*|]")]


def cells(docs: DataFrame, labels: DataFrame, part: str = "lang", key: str = "doc_id", column: str = "text") -> DataFrame:
    """part, mask, good, toxic, n: how many documents of a part fail exactly the filters of the mask.

    Bit i of the mask is filter i of LETTERS. Texts stay where they are read: a row moves
    as its key, part, bits and digest, about 60 bytes. Equal texts are counted for each
    (digest, part, labels) before they meet, so a text that a third of the rows share is
    a few rows in the end.
    """
    text = F.coalesce(F.col(column), F.lit(""))
    bits = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(failures(F.col("text")))), F.lit(0))
    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(part), F.lit("")).alias("part"), text.alias("text"))
    salt = F.when(F.col("id").isNull(), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).otherwise(0).cast("int")
    rows = rows.select("id", salt.alias("salt"), "part", F.sha2("text", 256).alias("digest"), bits.alias("bits"))
    given = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("id"))
    given = given.agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic")).withColumn("salt", F.lit(0))
    rows = rows.join(given, ["id", "salt"], "left").fillna(False, ["good", "toxic"])
    kind = ["digest", "part", "bits", "good", "toxic"]
    same = rows.groupBy("id", "salt", *kind).agg(F.count("*").alias("n"))
    least = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n")))
    groups = same.groupBy(*kind).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("unkeyed"), least.alias("first"))
    firsts = groups.groupBy("digest").agg(F.min("first.id").alias("least"))
    groups = groups.join(firsts, "digest")
    groups = groups.withColumn("fresh", F.col("unkeyed") + F.when(F.col("first.id") == F.col("least"), F.col("first.n")).otherwise(0))
    repeat = 1 << (len(LETTERS) - 1)
    split = F.array(F.struct(F.col("bits").alias("mask"), F.col("fresh").alias("n")), F.struct((F.col("bits") + repeat).alias("mask"), (F.col("n") - F.col("fresh")).alias("n")))
    counted = groups.select("part", "good", "toxic", F.explode(split).alias("cell")).groupBy("part", F.col("cell.mask").alias("mask"), "good", "toxic")
    return counted.agg(F.sum("cell.n").alias("n")).where("n > 0")


def steps(spark: SparkSession, letters: str = LETTERS) -> DataFrame:
    """prefix, step, letter, mask, kept, removed, redundant, unique_fails: what the last step of each prefix of an order does with each mask.

    The recursion starts with every mask cell and no filter; a level appends each letter
    whose bit is not applied yet. `before` and `applied` are the bits around the step.
    """
    values = ", ".join(f"('{c}', {1 << i})" for i, c in enumerate(letters))
    return spark.sql(f"""
        with recursive
          letters(letter, bit) as (values {values}),
          prefixes(prefix, step, letter, bit, before, applied, mask) as (
            select '', 0, '', 0, 0, 0, cast(id as int) from range({1 << len(letters)})
            union all
            select concat(p.prefix, l.letter), p.step + 1, l.letter, l.bit, p.applied, p.applied | l.bit, p.mask
            from prefixes p join letters l on p.applied & l.bit = 0)
        select prefix, step, letter, mask,
          mask & applied = 0 as kept,
          mask & bit > 0 and mask & before = 0 as removed,
          mask & bit > 0 and mask & before > 0 as redundant,
          mask = bit as unique_fails
        from prefixes where step > 0""")


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang", key: str = "doc_id", column: str = "text") -> DataFrame:
    """part, filter_order, step and the counts of each step of all orders of the filters LETTERS.

    kept: documents left after the step; removed: by it; redundant: fail its filter but
    were removed before; unique_fails: fail its filter only; good_lost, toxic_lost: removed
    with label quality = 1, toxic = 1; shapley: what its filter removes, summed over all
    orders. The last condition of LETTERS fails a document whose text some smaller key has
    in the whole table; repeated keys do not fail each other and null keys never fail. A
    null text counts as empty, a null part as the empty string, a document without labels
    as neither good nor toxic; of repeated labels of a key any 1 counts; an empty table
    gives an empty result. Other columns are not read.

    A step depends on the filters before it as a set ordered by the prefix alone, so
    metrics are made for each prefix and part and then meet the full orders; both tables of
    steps are bounded by the filters and are broadcast.
    """
    spark = docs.sparkSession
    counted = cells(docs, labels, part, key, column)
    step = steps(spark)
    count = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    met = counted.join(F.broadcast(step), "mask").groupBy("part", "prefix", "step", "letter").agg(
        *(count(F.col(c)).alias(c) for c in ("kept", "removed", "redundant", "unique_fails")),
        count(F.col("removed") & F.col("good")).alias("good_lost"), count(F.col("removed") & F.col("toxic")).alias("toxic_lost"),
    )
    full = step.where((F.col("step") == len(LETTERS)) & (F.col("mask") == 0)).select(F.col("prefix").alias("filter_order"))
    full = full.select("filter_order", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))).alias("n")).select("filter_order", F.expr("left(filter_order, n)").alias("prefix"))
    shapley = F.sum("removed").over(Window.partitionBy("part", "letter")).alias("shapley")
    return met.join(F.broadcast(full), "prefix").select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", shapley)
