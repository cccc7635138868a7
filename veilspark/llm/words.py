"""Word streams of Arrow batches, shared by the text operators."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.compute as pc

WORD = re.compile(r"\w+")

#: Texts are handled in runs of about so many characters, whatever their number, so that a task's memory does not depend on the batch.
RUN_CHARS = 3_000_000


def runs(texts: list[str], limit: int = RUN_CHARS) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive texts that together hold about `limit` characters (one text at least)."""
    lo, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= limit:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def texts_of(batch, column: str = "text") -> list[str]:
    """The strings of an Arrow batch's column, null as the empty string."""
    return [x or "" for x in batch.column(column).to_pylist()]


def slices(batch, limit: int, column: str = "text") -> Iterator[tuple[int, int, list[str]]]:
    """(lo, hi, their texts) of consecutive rows that together hold about `limit` bytes (one row at least); no more texts than these are in memory."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(ends):
        before = ends[lo - 1] if lo else 0
        hi = min(len(ends), int(np.searchsorted(ends, before + limit)) + 1)
        yield lo, hi, texts_of(batch.slice(lo, hi - lo), column)
        lo = hi


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every lower-cased word, text after text; words in each text)."""
    words: list[str] = []
    counts = np.empty(len(texts), np.int64)
    for i, text in enumerate(texts):
        found = WORD.findall(text.lower())
        counts[i] = len(found)
        words += found
    if not words:
        return np.empty(0, np.uint64), counts
    codes, uniques = pd.factorize(np.array(words, dtype=object))
    return pd.util.hash_array(uniques, categorize=False).astype(np.uint64)[codes], counts


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: spreads every input bit over the output."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def owners(counts: np.ndarray) -> np.ndarray:
    """Index of the text that each word of a stream belongs to."""
    return np.repeat(np.arange(len(counts)), counts)
