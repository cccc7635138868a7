"""Domains of coded tables and the cliques over them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping
from itertools import chain, combinations
from math import prod

Clique = tuple[str, ...]


class Domain(Mapping[str, int]):
    """Ordered attributes with their sizes; codes of an attribute are 0 to size - 1. Size 1 marks a continuous attribute."""

    def __init__(self, sizes: Mapping[str, int] | Iterable[tuple[str, int]]):
        self._sizes = dict(sizes)

    def __getitem__(self, attr: str) -> int:
        return self._sizes[attr]

    def __iter__(self) -> Iterator[str]:
        return iter(self._sizes)

    def __len__(self) -> int:
        return len(self._sizes)

    def __repr__(self) -> str:
        return f"Domain({self._sizes})"

    @property
    def attrs(self) -> Clique:
        return tuple(self._sizes)

    @property
    def shape(self) -> tuple[int, ...]:
        return tuple(self._sizes.values())

    def size(self, attrs: Iterable[str] | None = None) -> int:
        return prod(self._sizes[a] for a in (self if attrs is None else attrs))

    def project(self, attrs: Iterable[str]) -> Domain:
        return Domain((a, self._sizes[a]) for a in attrs)

    def without(self, attrs: Iterable[str]) -> Domain:
        drop = set(attrs)
        return Domain((a, n) for a, n in self._sizes.items() if a not in drop)

    def merge(self, other: Domain) -> Domain:
        """Both domains' attributes; shared ones must agree."""
        if clash := [a for a in other if a in self and self[a] != other[a]]:
            raise ValueError(f"sizes differ: {clash}")
        return Domain({**self._sizes, **other._sizes})

    def contains(self, other: Iterable[str]) -> bool:
        return set(other) <= set(self)

    def canonical(self, attrs: Iterable[str]) -> Clique:
        """The attributes in this domain's order."""
        wanted = set(attrs)
        return tuple(a for a in self if a in wanted)

    def axes(self, attrs: Iterable[str]) -> tuple[int, ...]:
        place = {a: i for i, a in enumerate(self)}
        return tuple(place[a] for a in attrs)

    def by_size(self, descending: bool = False) -> Domain:
        return Domain(sorted(self._sizes.items(), key=lambda x: x[1], reverse=descending))

    def strides(self, clique: Iterable[str]) -> dict[str, int]:
        """Weight of each attribute's code in a cell number; the last attribute runs fastest."""
        out, step = {}, 1
        for a in reversed(list(clique)):
            out[a] = step
            step *= self._sizes[a]
        return dict(reversed(out.items()))


def powerset(clique: Clique) -> Iterator[Clique]:
    return chain.from_iterable(combinations(clique, k) for k in range(1, len(clique) + 1))


def downward_closure(cliques: Iterable[Clique]) -> list[Clique]:
    """All non-empty subsets of the cliques, short ones first."""
    return sorted({s for c in cliques for s in powerset(c)}, key=lambda s: (len(s), s))


def score_workload(workload: Mapping[Clique, float]) -> dict[Clique, float]:
    """Each candidate of the closure with the weighted overlap that it has with the workload."""
    return {c: sum(w * len(set(c) & set(q)) for q, w in workload.items()) for c in downward_closure(workload)}


def all_cliques(domain: Domain, k: int, most_cells: int | None = None) -> list[Clique]:
    return [c for c in combinations(domain.attrs, k) if most_cells is None or domain.size(c) <= most_cells]


def maximal(cliques: Iterable[Clique]) -> list[Clique]:
    """Cliques that no other contains."""
    sets = sorted({frozenset(c): c for c in cliques}.values(), key=len, reverse=True)
    out: list[Clique] = []
    for c in sets:
        if not any(set(c) <= set(o) for o in out):
            out.append(c)
    return out
