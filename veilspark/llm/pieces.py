"""Pre-tokens of texts, numbered through a bounded memory of each worker."""

from __future__ import annotations

import re
from itertools import islice

import numpy as np
import regex

#: Distinct pre-tokens that a worker remembers before it drops those it has met once.
REMEMBERED = 200_000


class _Numbers(dict):
    """Numbers keys in the order in which they first appear."""

    def __missing__(self, key):
        n = self[key] = len(self)
        return n


def ascii_pattern(pattern: str) -> re.Pattern:
    """The same pre-tokens on the bytes of ASCII texts, for the faster engine."""
    inside = re.sub(r"\[[^\]]*\]", lambda m: m[0].replace(r"\p{L}", "A-Za-z").replace(r"\p{N}", "0-9"), pattern)
    return re.compile(inside.replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]").encode(), re.ASCII)


class Pieces:
    """Splits texts by a pattern; `number` gives the pre-tokens' numbers, `fresh` the new ones."""

    def __init__(self, pattern: str):
        self.any, self.ascii = regex.compile(pattern), ascii_pattern(pattern)
        self.numbers, self.met = _Numbers(), np.empty(0, np.int64)

    def number(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """(number of every pre-token, pre-tokens of each text, the pre-tokens that are new, in order of their numbers)."""
        known = len(self.numbers)
        get, counts, out = self.numbers.__getitem__, np.empty(len(texts), np.int64), []
        for i, text in enumerate(texts):
            found = self.ascii.findall(text.encode()) if text.isascii() else [x.encode() for x in self.any.findall(text)]
            counts[i] = len(found)
            out.append(np.fromiter(map(get, found), np.int32, len(found)))
        fresh = list(islice(self.numbers, known, None))
        codes = np.concatenate(out) if out else np.empty(0, np.int32)
        met = np.bincount(codes, minlength=len(self.numbers))
        met[:known] += self.met
        self.met = met
        return codes, counts, fresh

    def forget(self) -> np.ndarray | None:
        """When the memory is full: the old numbers of the pre-tokens that stay, in the order of their new ones."""
        if len(self.numbers) < REMEMBERED:
            return None
        stay = np.flatnonzero(self.met >= 2)
        if len(stay) > REMEMBERED // 2:
            stay = stay[np.argsort(-self.met[stay], kind="stable")[: REMEMBERED // 2]]
        keys = list(self.numbers)
        self.numbers = _Numbers()
        for i in stay.tolist():
            self.numbers[keys[i]]
        self.met = np.zeros(len(stay), np.int64)
        return stay


def take_ranges(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """flat[starts[i] : starts[i] + counts[i]] for all i, one after another."""
    if not len(counts) or not counts.sum():
        return flat[:0]
    ends = np.cumsum(counts)
    return flat[np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1])]
