"""Approximate nearest neighbours by largest inner product: an inverted file with product-quantised residuals.

Coarse centroids and codebooks are fitted on a bounded sample; every row is assigned and
encoded. A query probes the cells whose centroids lie nearest, ranks their rows by
asymmetric distance tables and reranks by exact inner products the best and every other row whose
quantisation error leaves room for a place among them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written
from .vectors import kmeans, matrix, nearest, numbered, packed, stored_as, valid_vectors

#: Rows of the training sample in expectation; most cells; codewords of a subspace.
SAMPLE, MOST_CELLS, WORDS = 16_384, 1024, 256
#: Queries whose exact neighbours set the number of probes, and the recall that they must reach.
AUDIT, AUDIT_RECALL = 128, 0.97
#: Rows of a shard at large sizes; shards at least (where they get 64 rows); rows of a shard reranked first; queries of a group.
SHARD_ROWS, LEAST_SHARDS, RERANK, GROUP_QUERIES = 16_384, 32, 100, 8192


@dataclass
class Index:
    """Coarse centroids and, for each subspace, its codewords."""

    centroids: np.ndarray
    words: np.ndarray  # subspace, codeword, component
    dtype: str

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = nearest(x, self.centroids)
        rest = (x - self.centroids[cell]).reshape(len(x), len(self.words), -1)
        return cell, np.stack([nearest(rest[:, m], w) for m, w in enumerate(self.words)], 1).astype(np.uint8)

    def decode(self, cell: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The vectors for which centroids and codewords stand."""
        return self.centroids[cell] + self.words[np.arange(len(self.words)), codes].reshape(len(codes), -1)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Inner products of each query's parts with all codewords: query, subspace, codeword."""
        return np.einsum("qmd,mwd->qmw", q.reshape(len(q), len(self.words), -1), self.words)


def fit(x: np.ndarray, rows: int, dtype: str) -> Index:
    """Centroids (about the square root of all rows, MOST_CELLS at most) and codebooks of the sample's residuals."""
    cells = max(1, min(MOST_CELLS, round(rows**0.5), len(x)))
    centroids = kmeans(x, cells)
    rest = x - centroids[nearest(x, centroids)]
    dim = x.shape[1]
    parts = next(m for m in range(min(16, dim), 0, -1) if dim % m == 0)
    split = rest.reshape(len(x), parts, -1)
    return Index(centroids, np.stack([kmeans(split[:, m], min(WORDS, len(x)), 6) for m in range(parts)]), dtype)


def _chance(key: str, salt: str) -> Column:
    return F.pmod(F.xxhash64(F.col(key), F.lit(salt)), F.lit(1_000_003)) / 1_000_003


def _encoded(shared, key: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index: Index = shared.value
        for f in frames:
            if len(f):
                cell, codes = index.encode(np.array(f["vector"].tolist(), np.float64))
                yield pd.DataFrame({"vec_id": f[key], "cell": cell, "codes": [c.tobytes() for c in codes], "raw": packed(f["vector"], index.dtype)})

    return run


def _probed(shared, cell_shards, sizes: np.ndarray, probes: int, k: int, key: str):
    """One row for each query and shard that holds a probed cell; cells hold k rows beside the query or are all probed."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, shards = shared.value, cell_shards.value
        for f in frames:
            for lo in range(0, len(f), 1000):
                part = f.iloc[lo : lo + 1000]
                q = np.array(part["vector"].tolist(), np.float64)
                best = np.argsort(-(q @ index.centroids.T), 1, kind="stable")
                most = np.maximum(probes, (np.cumsum(sizes[best], 1) <= k).sum(1) + 1)
                out = {"query_id": [], "shard": [], "cells": [], "raw": []}
                for i, raw, cells, m in zip(part[key].tolist(), packed(part["vector"], index.dtype), best.tolist(), most.tolist(), strict=True):
                    at: dict[int, list[int]] = {}
                    for c in cells[:m]:
                        for s in shards[c]:
                            at.setdefault(s, []).append(c)
                    for s, own in at.items():
                        for name, v in zip(out, (i, s, own, raw), strict=True):
                            out[name].append(v)
                yield pd.DataFrame(out)

    return run


def _searched(shared, k: int, rerank: int):
    def run(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        index: Index = shared.value
        found = []
        if len(rows) and len(queries):
            rows = rows.sort_values("vec_id", kind="stable")
            ids, cell = rows["vec_id"].to_numpy(), rows["cell"].to_numpy()
            codes = np.frombuffer(b"".join(rows["codes"]), np.uint8).reshape(len(rows), -1)
            x = matrix(rows["raw"], index.dtype)
            error = np.linalg.norm(x - index.decode(cell, codes), axis=1)
            longest = np.linalg.norm(x, axis=1).max()
            members = {c: np.flatnonzero(cell == c) for c in np.unique(cell).tolist()}
            step = max(1, 4_000_000 // len(rows))
            for lo in range(0, len(queries), step):
                part = queries.iloc[lo : lo + step]
                q, own = matrix(part["raw"], index.dtype), part["query_id"].to_numpy()
                near = np.full((len(part), len(rows)), -np.inf, np.float32)
                table = index.tables(q)
                coarse = q @ index.centroids.T
                asked: dict[int, list[int]] = {}
                for i, cells in enumerate(part["cells"]):
                    for c in cells:
                        asked.setdefault(c, []).append(i)
                for c, who in asked.items():
                    if c in members:
                        at, who = members[c], np.array(who)
                        total = np.repeat(coarse[who, c][:, None], len(at), 1)
                        for m in range(table.shape[1]):
                            total += table[who, m][:, codes[at, m]]
                        near[np.ix_(who, at)] = total
                near[own[:, None] == ids[None, :]] = -np.inf
                n = min(rerank, len(rows))
                best = np.argsort(-near, 1, kind="stable")[:, :n]
                exact = np.einsum("qd,qnd->qn", q, x[best])
                exact[np.take_along_axis(near, best, 1) == -np.inf] = -np.inf
                # no row below the k-th exact score by more than its own error can belong to the best
                least = -np.sort(-exact, 1)[:, k - 1] if n >= k else np.full(len(part), -np.inf)
                norm = np.linalg.norm(q, axis=1)
                may = near + norm[:, None] * error[None, :] + (1e-5 * norm * longest)[:, None] >= least[:, None]
                for i, row in enumerate(may & (near > -np.inf)):
                    at = np.flatnonzero(row)
                    score = np.einsum("d,nd->n", q[i], x[at])
                    top = np.lexsort((ids[at], -score))[:k]
                    found.append(pd.DataFrame({"query_id": np.repeat(own[i : i + 1], len(top)), "vec_id": ids[at][top], "score": score[top]}))
        return pd.concat(found) if found else pd.DataFrame({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0)})

    return run


def _scanned(queries: np.ndarray, ids: np.ndarray, k: int, dtype: str):
    """The audit: exact best rows of a few queries in each batch, with their cells."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                s = queries @ matrix(f["raw"], dtype).T
                s[ids[:, None] == f["vec_id"].to_numpy()[None, :]] = -np.inf
                best = np.argsort(-s, 1, kind="stable")[:, :k]
                yield pd.DataFrame({"query": np.repeat(np.arange(len(ids)), best.shape[1]), "cell": f["cell"].to_numpy()[best].ravel(), "score": np.take_along_axis(s, best, 1).ravel()})

    return run


def probes_for(index: Index, rows: DataFrame, sample: list, k: int, recall: float) -> int:
    """The fewest probes with which the audited queries' exact neighbours lie in probed cells."""
    if not sample:
        return len(index.centroids)
    q = np.array([list(r[1]) for r in sample], np.float64)
    top = Window.partitionBy("query").orderBy(F.desc("score"))
    exact = rows.select("vec_id", "cell", "raw").mapInPandas(_scanned(q, np.array([r[0] for r in sample]), k, index.dtype), "query int, cell int, score double")
    exact = exact.where(F.col("score") > float("-inf")).withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k).select("query", "cell").collect()
    order = np.argsort(np.argsort(-(q @ index.centroids.T), 1, kind="stable"), 1)
    ranks = np.sort([order[r[0], r[1]] for r in exact])
    return int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))) - 1)]) + 1 if len(ranks) else len(index.centroids)


def shard_cells(sizes: dict[int, int], cells: int, per_shard: int) -> tuple[list[list[int]], int]:
    """Shards of each cell: small cells share one, a large cell has several to itself."""
    shards: list[list[int]] = []
    at, room = 0, per_shard
    for c in range(cells):
        n = sizes.get(c, 0)
        if n > per_shard:
            at += room < per_shard
            shards.append([at + i for i in range(-(-n // per_shard))])
            at, room = shards[-1][-1] + 1, per_shard
            continue
        if n > room:
            at, room = at + 1, per_shard
        shards.append([at])
        room -= n
    return shards, at + 1


def search(vectors: DataFrame, queries: Column, k: int = 20, key: str = "vec_id", column: str = "embedding", rerank: int = RERANK, recall: float = AUDIT_RECALL) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query row's k rows of largest inner product, itself left out.

    `queries` is a condition on columns of `vectors` that picks the query rows. Vectors that
    are null, zero, not finite, or of another than the most frequent length take no part.
    Every row is a vector of its own: keys may repeat, a query has k rows for each row of
    its key, and a null key is a candidate like any other. Ties go to the smaller key, null first. Fewer
    candidates than k give all of them; an empty table gives an empty result.

    The index is fitted on about SAMPLE rows chosen by a hash and holds every row. The
    number of probed cells is measured, not set: exact neighbours of AUDIT queries must
    lie in probed cells at the rate `recall`, and each query probes on until its cells hold k
    other rows. Of the rows of probed cells none of the best is lost: tables leave out only rows
    that their quantisation error keeps from the k best, however many are near copies. Cells are laid out in shards of bounded size
    (a hot cell in several). A shard's queries meet it in groups of bounded size, and a shard
    that no query probes does not move; only shards asked by more than GROUP_QUERIES are copied.
    """
    spark = vectors.sparkSession
    dtype = stored_as(vectors.schema[column].dataType)
    marked = vectors.select(F.col(key).alias("key"), F.col(column).alias("vector"), F.coalesce(queries, F.lit(False)).alias("asked"))
    rows = numbered(valid_vectors(marked), "key", "ann-rows")
    n = rows.count()
    if not n:
        return spark.createDataFrame([], f"query_id {(kind := rows.schema['key'].dataType.simpleString())}, rank int, vec_id {kind}, score double")
    keys, key, kind = rows.select("row", "key"), "row", "long"
    got = sorted(rows.where(_chance(key, "train") <= SAMPLE / n).select(key, "vector").collect()) or rows.limit(1).collect()
    index = fit(np.array([list(r[1]) for r in got], np.float64), n, dtype)
    shared = spark.sparkContext.broadcast(index)
    coded = written(rows.mapInPandas(_encoded(shared, key), f"vec_id {kind}, cell int, codes binary, raw binary"), "ann-codes")
    asked = rows.where("asked")
    n_asked = asked.count()
    audit = sorted(asked.where(_chance(key, "audit") <= AUDIT / max(1, n_asked)).select(key, "vector").collect())
    probes = probes_for(index, coded, audit, k, recall)
    sizes = {r[0]: r[1] for r in coded.groupBy("cell").count().collect()}
    per_shard = max(64, min(SHARD_ROWS, -(-n // LEAST_SHARDS)))
    held = np.array([sizes.get(c, 0) for c in range(len(index.centroids))])
    layout, _ = shard_cells(sizes, len(index.centroids), per_shard)
    first, pieces = (F.array(*map(F.lit, x)) for x in ([s[0] for s in layout], [len(s) for s in layout]))
    at = F.col("cell") + 1
    placed = coded.withColumn("shard", F.element_at(first, at) + F.pmod(F.xxhash64("vec_id"), F.element_at(pieces, at)).cast("int"))
    probed = written(asked.mapInPandas(_probed(shared, spark.sparkContext.broadcast(layout), held, probes, k, key), f"query_id {kind}, shard int, cells array<int>, raw binary"), "ann-probed")
    load = written(probed.groupBy("shard").agg(F.ceil(F.count("*") / GROUP_QUERIES).cast("int").alias("groups")), "ann-load")
    placed = placed.join(load, "shard").select("shard", F.explode(F.sequence(F.lit(1), "groups")).alias("part"), "vec_id", "cell", "codes", "raw")
    load = load.select(F.col("shard").alias("of"), F.col("groups").alias("copies"))
    probed = probed.join(load, F.col("shard") == F.col("of")).select("shard", (F.pmod(F.xxhash64("query_id"), "copies") + 1).cast("int").alias("part"), "query_id", "cells", "raw")
    found = placed.groupBy("shard", "part").cogroup(probed.groupBy("shard", "part")).applyInPandas(_searched(shared, k, rerank), f"query_id {kind}, vec_id {kind}, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    found = found.withColumn("rank", rank).where(F.col("rank") <= k)
    of = lambda name: keys.select(F.col("row").alias(name), F.col("key").alias(f"{name}_key"))
    return found.join(of("query_id"), "query_id").join(of("vec_id"), "vec_id").select(F.col("query_id_key").alias("query_id"), "rank", F.col("vec_id_key").alias("vec_id"), "score")
