"""Rows by category: posting lists in numbered stretches, and conditional samples from them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.noise import keyed_uniform
from ..functions.ranks import STRETCH, numbered_within, stretches
from ..functions.tables import looked_up

#: Row keys of one entry of a posting list.
ENTRY = 1024


def postings(df: DataFrame, key: str, columns: Sequence[str], entry: int = ENTRY, stretch_rows: int = STRETCH) -> DataFrame:
    """column, category, stretch, keys: the keys of the rows of each category, in entries of `entry` keys.

    The k-th row of a category is number k % entry of its entry k // entry. Keys come in an
    order of their hash, so an order that depends on the keys alone. A category that has
    half of all rows is numbered in stretches and stored in entries, so no task holds it
    whole. Null categories have no list; keys may repeat.
    """
    each = reduce(DataFrame.unionByName, [df.where(F.col(c).isNotNull()).select(F.lit(c).alias("column"), F.col(c).cast("long").alias("category"), F.col(key).alias("key")) for c in columns])
    each = each.withColumn("h", F.md5(F.col("key").cast("string")))
    n = stretches(df, stretch_rows)
    lead = F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("double") / 4294967296.0 * n)  # rises with h
    placed = numbered_within(each, ["column", "category"], lead, ["h", "key"])
    entries = placed.groupBy("column", "category", F.floor(F.col("_position") / entry).alias("stretch")).agg(F.array_sort(F.collect_list(F.struct("_position", "key"))).alias("keys"))
    return entries.withColumn("keys", F.col("keys.key"))


def looked_up_rows(wanted: DataFrame, lists: DataFrame, entry: int = ENTRY) -> DataFrame:
    """The rows of `wanted` (column, category, k, others) with key, the k-th row's; null where there is none. One join by column, category and stretch."""
    asked = wanted.withColumn("stretch", F.floor(F.col("k") / entry))
    return asked.join(lists, ["column", "category", "stretch"], "left").withColumn("key", F.get("keys", F.pmod("k", F.lit(entry)).cast("int"))).drop("keys", "stretch")


def category_counts(df: DataFrame, sizes: Mapping[str, int]) -> dict[str, np.ndarray]:
    """Rows of each category of each column, from one pass; bounded by the public sizes."""
    from .marginal import marginals

    out = {c: np.zeros(n, np.int64) for c, n in sizes.items()}
    for r in marginals(df, [(c,) for c in sizes]).collect():
        if r["k1"] is not None and 0 <= r["k1"] < len(out[r["clique"]]):
            out[r["clique"]][r["k1"]] = r["n"]
    return out


def conditional_sample(wanted: DataFrame, request: str, df: DataFrame, key: str, sizes: Mapping[str, int], seed: str = "condition", log_frequency: bool = True, entry: int = ENTRY) -> DataFrame:
    """request, column, category, k, key: for each request a column, one of its categories and one of that category's rows of `df`.

    The column is drawn evenly, the category with a share of log(1 + rows) (or of its rows),
    the row evenly. All draws are hashes of the request and the seed, so a retried task
    draws alike. Requests stay in place but for the join with the posting lists; tables of
    categories are bounded by their public sizes. A column without rows is never drawn; no
    rows at all give no sample.
    """
    counts = {c: x for c, x in category_counts(df, sizes).items() if x.sum()}
    if not counts:
        return wanted.select(F.col(request).alias("request"), *[F.lit(None).cast(t).alias(n) for n, t in (("column", "string"), ("category", "long"), ("k", "long"), ("key", df.schema[key].dataType))]).limit(0)
    names, widest = list(counts), max(map(len, counts.values()))
    weights = [np.log1p(x) if log_frequency else x.astype(float) for x in counts.values()]
    upto = np.stack([np.pad(np.cumsum(w) / w.sum(), (0, widest - len(w)), constant_values=2.0) for w in weights])
    rows = np.stack([np.pad(x.astype(float), (0, widest - len(x))) for x in counts.values()])
    out = wanted.select(F.col(request).alias("request"))
    out = out.withColumn("_c", F.least(F.floor(keyed_uniform(seed + "column", "request") * len(names)), F.lit(len(names) - 1)).cast("long"))
    out = looked_up(looked_up(out, F.col("_c"), upto, "_upto"), F.col("_c"), rows, "_rows")
    u = keyed_uniform(seed + "category", "request")
    out = out.withColumn("category", F.size(F.filter("_upto", lambda p: p <= u)).cast("long"))
    n = F.get("_rows", F.col("category").cast("int"))
    k = F.least(F.floor(keyed_uniform(seed + "row", "request") * n), n - 1).cast("long")
    column = F.get(F.array(*map(F.lit, names)), F.col("_c").cast("int"))
    asked = out.select("request", column.alias("column"), "category", k.alias("k"))
    return looked_up_rows(asked, postings(df, key, names, entry), entry).select("request", "column", "category", "k", "key")
