"""Attributes that hang on a synthetic table by one marginal: left out of the updates, appended at the end."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.noise import keyed_uniform
from ..functions.ranks import STRETCH, numbered_within, stretches
from ..functions.tables import looked_up
from ..plans.domain import Clique, Domain
from .marginal import cell_id


@dataclass(frozen=True)
class Leaf:
    """An attribute with the only marginal that holds it and that marginal's other attributes."""

    attr: str
    separator: Clique
    clique: Clique


def clipped(cliques: Sequence[Clique]) -> tuple[list[Clique], list[list[Leaf]]]:
    """(the cliques whose records are to be updated, layers of leaves in the order in which they were clipped).

    A leaf's clique is the only one that holds it. Each layer clips one leaf of every
    clique that has one; the clique goes, unless its other attributes are then in no
    clique, in which case they stay as one. Append the layers from the last to the first.
    """
    left, layers = list(dict.fromkeys(cliques)), []
    while True:
        holders: dict[str, list[Clique]] = {}
        for c in left:
            for a in c:
                holders.setdefault(a, []).append(c)
        layer: list[Leaf] = []
        used: set[Clique] = set()
        for a in sorted(holders, key=lambda a: (len(holders[a][0]), a)):
            c = holders[a][0]
            others = tuple(x for x in c if x != a)
            if len(holders[a]) > 1 or c in used or not others:
                continue
            if used & {d for x in others for d in holders[x]} - {c}:
                continue  # a separator's own clique goes in this layer: the next one decides
            used.add(c)
            layer.append(Leaf(a, others, c))
        if not layer:
            return left, layers
        layers.append(layer)
        left = [c for c in left if c not in used]
        held = {a for c in left for a in c}
        for leaf in layer:
            if not set(leaf.separator) <= held:
                left.append(leaf.separator)
                held |= set(leaf.separator)


def appended(rows: DataFrame, key: str, domain: Domain, leaf: Leaf, target: np.ndarray, seed: str = "append", stretch_rows: int = STRETCH) -> DataFrame:
    """`rows` with the leaf's attribute: each cell of the separator is dealt to codes by integer allocation.

    `target`: counts over leaf.clique in its order; negative ones count as 0, and a cell
    without any is dealt evenly. With n rows in the cell and running shares v, the rows of
    a keyed order up to place round(v n) take codes up to that one, so the counts of
    (cell, code) are the target's shares of n to within one. A row outside the domain of
    the separator gets null. Cells are numbered in stretches of about `stretch_rows` rows;
    running shares are a literal or a joined table by their size.
    """
    at = leaf.clique.index(leaf.attr)
    mass = np.maximum(np.moveaxis(target, at, -1).reshape(-1, domain[leaf.attr]), 0)
    total = mass.sum(1, keepdims=True)
    share = np.where(total > 0, mass / np.where(total > 0, total, 1), 1 / domain[leaf.attr])
    upto = np.cumsum(share, 1)[:, :-1]  # the last code takes the rest
    inside = F.lit(True)
    for a in leaf.separator:
        inside = inside & F.col(a).between(0, domain[a] - 1)
    cut = rows.withColumn("_cell", F.when(inside, cell_id(domain, leaf.separator)))
    u = keyed_uniform(seed, key)
    placed = numbered_within(cut, ["_cell"], F.floor(u * stretches(rows, stretch_rows)), [u, key])
    met = looked_up(placed, F.col("_cell"), upto, "_upto")
    code = F.size(F.filter("_upto", lambda v: F.floor(v * F.col("_size") + 0.5) <= F.col("_position"))).cast("long")
    return met.withColumn(leaf.attr, F.when(F.col("_cell").isNotNull(), code)).select(*[c for c in rows.columns if c != leaf.attr], leaf.attr)


def appended_layers(rows: DataFrame, key: str, domain: Domain, layers: Sequence[Sequence[Leaf]], targets: Mapping[Clique, np.ndarray], seed: str = "append") -> DataFrame:
    """All layers' attributes, from the last layer to the first."""
    for i, layer in enumerate(reversed(layers)):
        for leaf in layer:
            rows = appended(rows, key, domain, leaf, targets[leaf.clique], f"{seed}{i}{leaf.attr}")
    return rows
