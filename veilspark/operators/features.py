"""Vector features: random Fourier means, kernels, distances, nearest-neighbour votes."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import settled


def doubles(vector: Column) -> Column:
    return F.transform(vector, lambda x: x.cast("double"))


def inner(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def fourier_means(df: DataFrame, vector: str, frequencies: Sequence[Sequence[float]], *by: str) -> DataFrame:
    """feature, kind (cos, sin), mean of sqrt(2 / D) cos and sin of the projections; D: twice the frequencies."""
    scale = math.sqrt(1 / len(frequencies))
    v = doubles(F.col(vector))
    projected = df.where(F.col(vector).isNotNull()).select(*by, *[inner(v, F.array(*map(F.lit, map(float, w)))).alias(f"p{i}") for i, w in enumerate(frequencies)])
    row = projected.groupBy(*by).agg(*[F.avg(scale * f(F.col(f"p{i}"))).alias(f"{k}{i}") for i in range(len(frequencies)) for k, f in (("c", F.cos), ("s", F.sin))])
    each = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("feature"), F.lit(n).alias("kind"), F.col(f"{k}{i}").alias("mean")) for i in range(len(frequencies)) for k, n in (("c", "cos"), ("s", "sin"))]))
    return row.select(*by, each.alias("e")).select(*by, "e.*")


#: Different vectors of a block, in expectation; bins of a pass over distances; distances that are gathered at the end.
BLOCK, BINS, GATHERED = 512, 4096, 100_000


def blocks(df: DataFrame, vector: str, rows: int = BLOCK, key: str | None = None) -> tuple[DataFrame, int]:
    """(block, single, raw, weight, key: the different vectors in blocks, packed (in single precision if it holds them exactly), with how many rows have each and their least key; number of blocks).

    Equal vectors are one, however many they are, so a block is bounded. Null vectors and
    vectors with nulls take no part. The table is written: all pairs of blocks read it.
    """
    taken = df.select(doubles(F.col(vector)).alias("v"), (F.col(key) if key else F.lit(0)).cast("long").alias("k"))
    each = taken.where("v is not null and not exists(v, x -> x is null)").groupBy("v").agg(F.count("*").alias("n"), F.min("k").alias("key"))
    n = max(1, math.ceil(each.count() / rows))

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        x = np.stack([np.asarray(v, "<f8") for v in frame["v"]])
        with np.errstate(over="ignore"):
            short = x.astype("<f4")
        single = bool((short == x).all())
        return pd.DataFrame({"block": frame["block"].iloc[:1], "single": [single], "raw": [(short if single else x).tobytes()], "weight": [frame["n"].to_numpy("<i8").tobytes()], "key": [frame["key"].to_numpy("<i8").tobytes()]})

    dealt = each.withColumn("block", F.pmod(F.xxhash64("v"), F.lit(n)).cast("int"))
    return settled(dealt.groupBy("block").applyInPandas(pack, "block int, single boolean, raw binary, weight binary, key binary"), "vector-blocks"), n


def _unpacked(frame: pd.DataFrame) -> list[Block]:
    out = []
    for single, raw, weight, key in zip(frame["single"], frame["raw"], frame["weight"], frame["key"], strict=True):
        weight = np.frombuffer(weight, "<i8")
        out.append((np.frombuffer(raw, "<f4" if single else "<f8").astype(float).reshape(len(weight), -1), weight, np.frombuffer(key, "<i8")))
    return out


def _distances(x: np.ndarray, y: np.ndarray, measure: str = "l2") -> np.ndarray:
    """Squared L2, L1 or negative cosine of all pairs."""
    if measure == "cosine":
        with np.errstate(divide="ignore", invalid="ignore"):
            return -(x @ y.T) / np.sqrt(np.outer((x * x).sum(1), (y * y).sum(1)))
    out = np.zeros((len(x), len(y)))
    for i in range(x.shape[1]):  # one component after another: exact for equal vectors, and no array of all differences
        off = x[:, i, None] - y[None, :, i]
        out += np.abs(off) if measure == "l1" else off * off
    return out


#: Squared distances below this share of the squared norms lose digits in the expanded form.
CLOSE = 1e-2


def squared_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared L2 of all pairs by one product of matrices; by components where that would lose digits: close pairs, overflow, values that are not finite."""
    xx, yy = (x * x).sum(1), (y * y).sum(1)
    top = xx.max(initial=0) + yy.max(initial=0)
    if not top < 1e300:
        return _distances(x, y)
    out = x @ y.T
    out *= -2
    out += xx[:, None]
    out += yy
    i, j = np.nonzero(out < CLOSE * top)
    if len(i) > out.size // 8:
        return _distances(x, y)
    off = x[i] - y[j]
    out[i, j] = (off * off).sum(1)
    return out


#: Vectors of a strip of blocks that meets another in one task, and strips at least, for work for all cores.
STRIP, STRIPS = 32_768, 8

#: The vectors of a block, how many rows have each, and their keys.
Block = tuple[np.ndarray, np.ndarray, np.ndarray]


def over_pairs(a: tuple[DataFrame, int], b: tuple[DataFrame, int], run: Callable[[Iterator[tuple[int, int, Block, Block]]], pd.DataFrame], schema: str, once: bool = False) -> DataFrame:
    """The rows that run gives for (number of the block of a, of the block of b, the two blocks) of all pairs of blocks (once: each unordered pair of one table).

    Blocks are dealt to strips, STRIPS at least and of about STRIP vectors at most; each pair
    of strips is a task that has run over its pairs of blocks, so a vector is copied
    once for each strip of the other side and not for each block; what leaves a pair
    of strips is for `run` to keep small.
    """
    strips = [min(t[1], max(STRIPS, math.ceil(t[1] * BLOCK / STRIP))) for t in (a, b)]
    strip = lambda k: (F.col("block") % strips[k]).cast("int")
    left = a[0].withColumn("i", strip(0)).withColumn("j", F.explode(F.sequence(F.col("i") if once else F.lit(0), F.lit(strips[1] - 1))))
    right = b[0].withColumn("j", strip(1)).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("j") if once else F.lit(strips[0] - 1))))

    def both(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return empty
        xs, ys = (sorted(zip(t["block"].tolist(), _unpacked(t), strict=True), key=lambda r: r[0]) for t in (x, y))
        same = once and xs[0][0] % strips[0] == ys[0][0] % strips[1]  # of two strips all pairs are met, of one and itself half of them
        return run((p, q, u, v) for p, u in xs for q, v in ys if not same or p <= q)

    empty = pd.DataFrame({c.split()[0]: pd.Series([], dtype="float64" if c.split()[1] == "double" else "int64") for c in schema.split(", ")})
    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(both, schema)


def _kernel_sums(a: tuple[DataFrame, int], b: tuple[DataFrame, int], sigma2: float) -> DataFrame:
    """mean of the Gaussian kernel over all pairs of two tables' rows, or of one table's, where each unordered pair of blocks is met once."""
    one = a is b

    def run(pairs) -> pd.DataFrame:
        s, n = [], 0
        for p, q, (x, v, _), (y, w, _) in pairs:
            times = 2 if one and p != q else 1
            d = squared_distances(x, y)
            d *= -1 / (2 * sigma2)
            s.append(times * float(v @ np.exp(d, out=d) @ w))
            n += times * int(v.sum()) * int(w.sum())
        return pd.DataFrame({"s": [math.fsum(s)], "n": [n]})

    return over_pairs(a, b, run, "s double, n long", once=one).agg((F.sum("s") / F.sum("n")).alias("mean"))


def kernel_mean(a: DataFrame, b: DataFrame, vector: str, sigma2: float) -> DataFrame:
    """mean of the Gaussian kernel over all pairs; null where a side has no vectors. Only a sum leaves each pair of strips."""
    return _kernel_sums(blocks(a, vector), blocks(b, vector), sigma2)


def discrepancy(a: DataFrame, b: DataFrame, vector: str, sigma2: float) -> DataFrame:
    """mmd: the mean of the Gaussian kernel inside each table, less twice that between them."""
    x, y = blocks(a, vector), blocks(b, vector)
    parts = [_kernel_sums(*sides, sigma2).withColumnRenamed("mean", n) for sides, n in (((x, x), "aa"), ((y, y), "bb"), ((x, y), "ab"))]
    return parts[0].join(parts[1]).join(parts[2]).select((F.col("aa") + F.col("bb") - 2 * F.col("ab")).alias("mmd"))


def median_distance(df: DataFrame, vector: str, bins: int = BINS, gathered: int = GATHERED) -> float | None:
    """Exact median of the Euclidean distances of all unordered pairs of rows; null for fewer than two.

    A pass over the pairs of blocks counts distances in bins; the next one does so inside
    the bin that holds the middle, until few enough are left to be gathered, or all of them are equal.
    """
    table = blocks(df, vector)

    def counted(run) -> DataFrame:
        return over_pairs(table, table, run, "bin long, n long, least double, most double", once=True)

    def inside(pairs, lo: float, hi: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(distances in [lo, hi], rows' pairs of each) of pairs of blocks, every unordered pair once."""
        for p, q, (x, v, _), (y, w, _) in pairs:
            d, n = np.sqrt(squared_distances(x, y)), None
            if p == q:  # the pairs of a block and of a vector with itself
                n = np.triu(np.outer(v, w), 1) + np.diag(v * (v - 1) // 2)
                d[np.diag_indices_from(d)] = np.where(np.isnan(d.diagonal()), np.nan, 0.0)
            elif v.max() > 1 or w.max() > 1:
                n = np.outer(v, w)
            good = (d >= lo) & (d <= hi)
            if n is not None:
                good &= n > 0
            yield d[good], n[good] if n is not None else np.ones(np.count_nonzero(good), np.int64)

    def binned(lo: float, hi: float):
        def run(pairs) -> pd.DataFrame:
            n, least, most = np.zeros(bins, np.int64), np.full(bins, np.inf), np.full(bins, -np.inf)
            for d, m in inside(pairs, lo, hi):
                if not len(d):
                    continue
                if math.isinf(hi - lo):  # one bin for all
                    n[0], least[0], most[0] = n[0] + int(m.sum()), min(least[0], d.min()), max(most[0], d.max())
                    continue
                at = np.minimum(((d - lo) * (bins / (hi - lo))).astype(np.int64), bins - 1) if hi > lo else np.zeros(len(d), np.int64)
                n += np.bincount(at, m, bins).astype(np.int64)  # exact: a block pair's rows are far fewer than 2 ** 53
                np.minimum.at(least, at, d)
                np.maximum.at(most, at, d)
            full = np.flatnonzero(n)
            return pd.DataFrame({"bin": full, "n": n[full], "least": least[full], "most": most[full]})

        found = counted(run).groupBy("bin").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))
        return sorted(map(tuple, found.collect()))  # as many rows as bins

    def within(rows: list[tuple], place: int, below: int) -> tuple[int, tuple]:
        """(pairs below the bin that holds a place, the bin)."""
        for r in rows:
            if place < below + r[1]:
                return below, r
            below += r[1]
        raise IndexError(place)

    def ranked(rows: list[tuple], place: int) -> float:
        below, r = within(rows, place, 0)
        while r[2] < r[3]:
            if r[1] <= gathered:
                lo, hi = r[2], r[3]

                def run(pairs) -> pd.DataFrame:
                    found = [*inside(pairs, lo, hi)]  # noqa: B023
                    d, n = (np.concatenate(x) for x in zip(*found, strict=True))
                    return pd.DataFrame({"bin": 0, "n": n, "least": d, "most": d})

                for d, n in sorted((r["least"], r["n"]) for r in counted(run).collect()):
                    below += n
                    if place < below:
                        return float(d)
            below, r = within(binned(r[2], r[3]), place, below)
        return float(r[2])

    whole = binned(0.0, float("inf"))
    if not whole:
        return None
    (_, n, least, most), *_ = [(0, sum(r[1] for r in whole), min(r[2] for r in whole), max(r[3] for r in whole))]
    rows = binned(least, most)
    low, high = (n - 1) // 2, n // 2
    first = ranked(rows, low)
    return first if low == high else (first + ranked(rows, high)) / 2


def nearest_votes(queries: DataFrame, targets: DataFrame, key: str, vector: str, measure: str = "l2") -> DataFrame:
    """key, votes: how many queries have each target as their nearest (ties to the smaller key).

    Each pair of strips gives the nearest target of each of its different query vectors;
    the least of these over the target strips has the vote of all rows with that vector.
    Vectors of norm 0 have no cosine and are no query and no target of it.
    """

    def run(pairs) -> pd.DataFrame:
        best: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for block, _, (x, v, _), (y, _, k) in pairs:
            order = np.argsort(k, kind="stable")
            d = _distances(x, y[order], measure)
            d = np.where(np.isnan(d), np.inf, d)
            at = d.argmin(1)
            far, key = d[np.arange(len(x)), at], k[order][at]
            if block in best:
                _, old, former = best[block]
                worse = (old < far) | ((old == far) & (former < key))
                far, key = np.where(worse, old, far), np.where(worse, former, key)
            best[block] = v, far, key
        out = pd.concat([pd.DataFrame({"block": block, "place": np.arange(len(v)), "n": v, "far": far, "key": key}) for block, (v, far, key) in best.items()])
        return out[np.isfinite(out["far"])]

    met = over_pairs(blocks(queries, vector), blocks(targets, vector, key=key), run, "block long, place long, n long, far double, key long")
    best = met.groupBy("block", "place").agg(F.min(F.struct("far", "key")).alias("m"), F.first("n").alias("n"))
    return best.groupBy(F.col("m.key").alias(key)).agg(F.sum("n").alias("votes"))
