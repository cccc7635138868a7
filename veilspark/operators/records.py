"""Synthesis by updating records: rows leave over-full cells of a marginal and enter under-full ones.

Rows that have nothing but the attributes of a domain are as alike as their codes: then the
updates work on how many rows each cell of the domain has (`updated_counts`), and rows are
listed at the end. Rows with more columns, and domains of more than CELLS cells, are moved one by one (`updated`).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce
from typing import TypeVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.noise import keyed_uniform
from ..functions.ranks import numbered_within, stretches
from ..functions.tables import BROADCAST, at_most, literal, looked_up
from ..plans.domain import Clique, Domain
from ..sources.shared import Rounds
from .marginal import cell_codes, cell_id

#: Cells of a domain up to which the rows of all cells are counted on the driver (8 bytes each); attributes that such an array may have.
CELLS, AXES = 1 << 20, 32


def _upto(one_way: np.ndarray) -> np.ndarray:
    """Cumulative shares of all codes but the last, which takes the rest."""
    share = np.maximum(one_way, 0)
    return (np.cumsum(share) / max(share.sum(), 1e-12))[:-1]


def start(spark: SparkSession, domain: Domain, one_way: Mapping[str, np.ndarray], rows: int, seed: str = "start") -> DataFrame:
    """row_id and independent attributes drawn from their one-way shares."""
    out = spark.range(rows).withColumnRenamed("id", "row_id")
    for a in domain:
        upto = _upto(one_way[a])
        out = out.withColumn(a, at_most(literal(upto), len(upto), keyed_uniform(seed + a, "row_id")).cast("long"))
    return out


def _flows(target: np.ndarray, counts: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """(the chance with which a row of each cell leaves it, the rows that each cell lacks)."""
    off = (counts - target * counts.sum() / max(target.sum(), 1e-12)).ravel()
    return np.where(off > 0, alpha * off / np.maximum(counts.ravel(), 1), 0.0), np.maximum(-off, 0)


def moved(df: DataFrame, domain: Domain, clique: Clique, target: np.ndarray, counts: np.ndarray, alpha: float, seed: str, whole: float = 0.0) -> DataFrame:
    """One step towards a marginal: each row of an over-full cell leaves with the probability of the cell's excess, and draws its new cell by the deficits.

    Of the rows that enter a cell which has rows, a share of `whole` copies another row of
    that cell in all attributes (a complete update); the others, and all that enter an empty cell, change
    the clique's attributes alone (a partial update). Rows decide by a hash of their id, so
    a retried task moves the same rows. Partial updates order nothing and move nothing;
    complete ones look their donor up by (cell, position), with cells numbered in stretches.
    Tables of cells are bounded by the domain.
    """
    leave, room = _flows(target, counts, alpha)
    if not room.sum() or not (leave > 0).any():
        return df
    ids = np.flatnonzero(room)
    upto = np.cumsum(room[ids]) / room.sum()
    rows = looked_up(df.withColumn("_cell", cell_id(domain, clique)), F.col("_cell"), leave, "_leave")
    goes = F.coalesce(F.col("_leave") > 0, F.lit(False)) & (keyed_uniform(seed + "leave", "row_id") <= F.col("_leave"))  # most cells keep all rows: no hash
    place = at_most(literal(upto[:-1]), len(upto) - 1, keyed_uniform(seed + "enter", "row_id"))
    new = F.get(literal(ids), place).cast("long")
    rows = rows.withColumn("_new", F.when(goes, new).otherwise(F.col("_cell")))
    codes = {a: c for a, c in zip(clique, cell_codes(domain, clique, F.col("_new")), strict=True)}
    if whole <= 0:
        return rows.withColumns(codes).select(*df.columns)
    copies = F.coalesce(goes & (keyed_uniform(seed + "whole", "row_id") <= whole), F.lit(False))
    donors = numbered_within(rows.where(~F.coalesce(goes, F.lit(False))), ["_cell"], F.floor(keyed_uniform(seed + "donor", "row_id") * stretches(df)), [keyed_uniform(seed + "donor", "row_id"), "row_id"])
    rest = [c for c in df.columns if c != "row_id"]
    donors = donors.select(F.col("_cell").alias("_new"), F.col("_position").alias("_at"), "_size", F.struct(*rest).alias("_donor"))
    sizes = donors.groupBy("_new").agg(F.first("_size").alias("_of"))  # one row for each cell
    asked = rows.where(copies).join(F.broadcast(sizes) if domain.size(clique) <= BROADCAST else sizes, "_new", "left")
    asked = asked.withColumn("_at", F.floor(keyed_uniform(seed + "copy", "row_id") * F.col("_of"))).join(donors, ["_new", "_at"], "left")
    keep = {c: F.when(F.col("_donor").isNotNull(), F.col(f"_donor.{c}")).otherwise(codes.get(c, F.col(c))) for c in rest}
    return rows.where(~copies).withColumns(codes).select(*df.columns).unionByName(asked.select("row_id", *[v.alias(c) for c, v in keep.items()]))


# How the step falls with the pass, from 0, by name.
SCHEDULES: dict[str, Callable[[int], float]] = {
    "constant": lambda k: 1.0, "tenth": lambda k: 0.1, "fifth": lambda k: 0.2, "three tenths": lambda k: 0.3, "half": lambda k: 0.5,
    "geometric": lambda k: 0.98**k, "slowing": lambda k: 0.98 ** min(k, 100) * 0.99 ** max(0, k - 100), "steps": lambda k: 0.84 ** (k // 20), "exponential": lambda k: math.exp(-0.008 * k),
    "linear": lambda k: 1 / (1 + 0.02 * k), "root": lambda k: 1 / math.sqrt(1 + 0.12 * k), "fast": lambda k: 0.6**k,
}
# The shares of complete updates in even and in odd passes, by name.
MODES: dict[str, tuple[float, float]] = {"partial": (0.0, 0.0), "complete": (1.0, 1.0), "halves": (0.5, 0.5), "partial, complete": (0.0, 1.0), "halves, complete": (0.5, 1.0), "halves, partial": (0.5, 0.0)}


#: Passes at most, as in the reference.
MOST_ROUNDS = 50


def total_error(counts: Mapping[Clique, np.ndarray], targets: Mapping[Clique, np.ndarray]) -> float:
    """L1 distance of all counts from the targets scaled to as many rows."""
    return float(sum(np.abs(counts[c] - t * counts[c].sum() / max(t.sum(), 1e-12)).sum() for c, t in targets.items()))


State = TypeVar("State")


def _passes(state: State, targets: Mapping[Clique, np.ndarray], rounds: int, counted: Callable[[State, list[Clique]], Mapping[Clique, np.ndarray]], step: Callable[[State, State, Clique, int], State]) -> State:
    """The state after the passes until one does not lower the total error; a pass takes the targets in order of their error at its start, the worst first.

    `step` gets the state, the best one of earlier passes, a target's clique and the number of the pass.
    """

    def errors(state: State) -> dict[Clique, float]:
        counts = counted(state, list(targets))
        return {c: total_error({c: counts[c]}, {c: t}) for c, t in targets.items()}

    off = errors(state)
    best, least = state, sum(off.values())
    for k in range(rounds):
        for clique in sorted(targets, key=lambda c: -off[c]):
            state = step(state, best, clique, k)
        off = errors(state)
        if sum(off.values()) >= least:
            break
        best, least = state, sum(off.values())
    return best


def updated(df: DataFrame, domain: Domain, targets: Mapping[Clique, np.ndarray], rounds: int = MOST_ROUNDS, alpha: float = 1.0, schedule: str = "fast", mode: str = "partial", seed: str = "move") -> DataFrame:
    """Passes over all target marginals with decreasing step until their total error stops falling.

    The step of pass k is alpha times SCHEDULES[schedule](k), the share of complete updates
    MODES[mode]. Each step counts its marginal and settles the rows, and what it started from is removed.
    """
    from .synthesize import datavectors

    tables = Rounds(df.sparkSession, "records")

    def step(rows: DataFrame, best: DataFrame, clique: Clique, k: int) -> DataFrame:
        counts = datavectors(rows, domain, [clique])[clique]
        rows = tables(moved(rows, domain, clique, targets[clique], counts, alpha * SCHEDULES[schedule](k), f"{seed}{k}{','.join(clique)}", MODES[mode][k % 2]))
        tables.only(rows, best)
        return rows

    best = _passes(df, targets, rounds, lambda rows, cliques: datavectors(rows, domain, cliques), step)
    tables.only(best)
    return best


def _generator(seed: str) -> np.random.Generator:
    return np.random.default_rng(list(seed.encode()))


def start_counts(domain: Domain, one_way: Mapping[str, np.ndarray], rows: int, seed: str = "start") -> np.ndarray:
    """How many of the rows of `start` each cell of the domain has: one draw of all their numbers."""
    share = reduce(np.multiply.outer, [np.maximum(np.diff(_upto(one_way[a]), prepend=0.0, append=1.0), 0) for a in domain])
    out, ids = np.zeros(share.size, np.int64), np.flatnonzero(share)
    out[ids] = _generator(seed).multinomial(rows, share.ravel()[ids] / share.sum())
    return out.reshape(domain.shape)


def _by_cell(counts: np.ndarray, domain: Domain, clique: Clique) -> np.ndarray:
    """Counts of all cells of the domain as (cell of the clique, combination of the other attributes)."""
    return np.moveaxis(counts, domain.axes(clique), range(len(clique))).reshape(domain.size(clique), -1)


def moved_counts(counts: np.ndarray, domain: Domain, clique: Clique, target: np.ndarray, alpha: float, rng: np.random.Generator, whole: float = 0.0) -> np.ndarray:
    """`moved` for the counts of all cells of the domain, each with the same distribution as if its rows decided one by one.

    Rows decide independently and alike within a cell of the domain. So the number that leaves is
    binomial, the numbers that enter each cell of the clique are multinomial for each
    combination of the other attributes, and copies are dealt over the rows that stay in the cell.
    """
    rows = _by_cell(counts, domain, clique)
    leave, room = _flows(target.ravel(), rows.sum(1), alpha)
    ids = np.flatnonzero(room)
    if not ids.size or not (leave > 0).any():
        return counts
    gone = rng.binomial(rows, np.minimum(leave, 1)[:, None])
    stay = rows - gone
    enter = rng.multinomial(gone.sum(0), room[ids] / room.sum()).T
    copies = rng.binomial(enter, whole) * (stay[ids].sum(1, keepdims=True) > 0)
    out = stay.copy()
    out[ids] += enter - copies
    for cell, n in zip(ids, copies.sum(1), strict=True):
        if n:
            donors = np.flatnonzero(stay[cell])
            out[cell, donors] += rng.multinomial(n, stay[cell, donors] / stay[cell].sum())
    others = [a for a in domain if a not in clique]
    return np.moveaxis(out.reshape(domain.project([*clique, *others]).shape), range(len(clique)), domain.axes(clique))


def updated_counts(counts: np.ndarray, domain: Domain, targets: Mapping[Clique, np.ndarray], rounds: int = MOST_ROUNDS, alpha: float = 1.0, schedule: str = "fast", mode: str = "partial", seed: str = "move") -> np.ndarray:
    """`updated` for the counts of all cells of the domain: its passes, steps and end, with work that does not depend on the number of rows."""
    rng = _generator(seed)
    marginal = lambda x, c: _by_cell(x, domain, c).sum(1).reshape(domain.project(c).shape)
    step = lambda x, best, c, k: moved_counts(x, domain, c, targets[c], alpha * SCHEDULES[schedule](k), rng, MODES[mode][k % 2])
    return _passes(counts, targets, rounds, lambda x, cliques: {c: marginal(x, c) for c in cliques}, step)


def _mixed(x: np.ndarray, key: np.uint64) -> np.ndarray:
    """Hashes of 64-bit numbers (the finalizer of splitmix64)."""
    x = x + key
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shuffled(at: np.ndarray, rows: int, seed: str) -> np.ndarray:
    """Places of the numbers `at` (from 0) in a keyed permutation of the first `rows` numbers.

    A Feistel network over pairs of digits of about sqrt(rows) values each; the few numbers that come
    out beyond `rows` go through it again until they don't, which keeps it a permutation.
    """
    left_size = math.isqrt(max(rows - 1, 0)) + 1
    sizes = np.uint64(left_size), np.uint64(max(1, -(-rows // left_size)))
    keys = _generator(seed).integers(0, 1 << 64, (3, 2), np.uint64)
    out = at.astype(np.uint64)
    todo = np.arange(len(out))
    while todo.size:
        left, right = np.divmod(out[todo], sizes[1])
        for key in keys:
            left = (left + _mixed(right, key[0]) % sizes[0]) % sizes[0]
            right = (right + _mixed(left, key[1]) % sizes[1]) % sizes[1]
        out[todo] = left * sizes[1] + right
        todo = todo[out[todo] >= rows]
    return out.astype(np.int64)


def listed(spark: SparkSession, domain: Domain, counts: np.ndarray, seed: str = "list") -> DataFrame:
    """row_id and attributes of exactly as many rows of each cell as `counts` says, in the order of a keyed permutation.

    A row's cell follows from its id alone: nothing is ordered or moved, and a retried task lists the same rows.
    """
    ids, rows, shape = np.flatnonzero(counts), int(counts.sum()), domain.shape
    upto = np.cumsum(counts.ravel()[ids])
    names = ["row_id", *domain.attrs]

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = ids[np.searchsorted(upto, shuffled(batch.column(0).to_numpy(), rows, seed), "right")]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in np.unravel_index(cell, shape)]], names)

    return spark.range(rows).mapInArrow(filled, ", ".join(f"`{c}` long" for c in names))


def synthesized(spark: SparkSession, domain: Domain, one_way: Mapping[str, np.ndarray], rows: int, targets: Mapping[Clique, np.ndarray], **options) -> DataFrame:
    """row_id and attributes of `rows` rows that start independent and are updated towards the targets; `options` as for `updated`.

    Up to CELLS cells and AXES attributes of the domain rows are updated as counts and listed once; beyond that, one by one.
    """
    if domain.size() <= CELLS and len(domain) <= AXES:
        return listed(spark, domain, updated_counts(start_counts(domain, one_way, rows), domain, targets, **options))
    return updated(start(spark, domain, one_way, rows), domain, targets, **options)


def separated(cliques: Sequence[Clique]) -> list[list[Clique]]:
    """Groups of cliques that share no attribute with another group; their rows can be updated apart."""
    groups: list[tuple[set[str], list[Clique]]] = []
    for c in cliques:
        mine = [g for g in groups if g[0] & set(c)]
        groups = [g for g in groups if g not in mine] + [(set(c).union(*(g[0] for g in mine)), [*(x for g in mine for x in g[1]), c])]
    return [g[1] for g in groups]
