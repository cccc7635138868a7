"""Integer noise that follows the discrete Laplace and Gaussian laws exactly, by rejection on rationals.

No floating-point number takes part, so the noise has no holes that a float's rounding
would open. The bits of a draw come from a hash of seed, cell and position, so a retried
task draws alike; a private release takes a fresh secret seed (see noise.fresh_seed).
"""

from __future__ import annotations

import hashlib
from fractions import Fraction
from math import isqrt

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class Draws:
    """Random integers and coins of one cell, as many as are asked for."""

    def __init__(self, seed: str, cell: str):
        self._start, self._block, self._pool, self._bits = f"{seed}|{cell}|".encode(), 0, 0, 0

    def _take(self, bits: int) -> int:
        while self._bits < bits:
            self._pool = self._pool << 256 | int.from_bytes(hashlib.sha256(self._start + str(self._block).encode()).digest(), "big")
            self._block, self._bits = self._block + 1, self._bits + 256
        self._bits -= bits
        out = self._pool >> self._bits
        self._pool &= (1 << self._bits) - 1
        return out

    def below(self, n: int) -> int:
        """An even draw from 0 to n - 1."""
        bits = (n - 1).bit_length()
        while (x := self._take(bits)) >= n:
            pass
        return x

    def coin(self, p: Fraction) -> bool:
        return self.below(p.denominator) < p.numerator

    def decays(self, x: Fraction) -> bool:
        """True with probability exp(-x), x >= 0: exp(-1) for each whole unit, and a run of coins of falling chance for the rest."""
        whole, rest = divmod(x, 1)
        return all(self._series(Fraction(1)) for _ in range(whole)) and self._series(rest)

    def _series(self, x: Fraction) -> bool:
        run = 1
        while self.coin(x / run):
            run += 1
        return run % 2 == 1

    def laplace(self, scale: int) -> int:
        """Integer with probability proportional to exp(-|x| / scale)."""
        while True:
            inside = self.below(scale)
            if not self.decays(Fraction(inside, scale)):
                continue
            steps = 0
            while self._series(Fraction(1)):
                steps += 1
            size, minus = inside + scale * steps, self.below(2)
            if size or not minus:
                return -size if minus else size

    def gaussian(self, variance: Fraction) -> int:
        """Integer with probability proportional to exp(-x ** 2 / (2 variance)), from Laplace draws of about that width."""
        scale = isqrt(int(variance)) + 1
        while True:
            x = self.laplace(scale)
            if self.decays((abs(x) - variance / scale) ** 2 / (2 * variance)):
                return x


def _noise(seed: str, keys: tuple[Column | str, ...], draw) -> Column:
    @F.pandas_udf("long")
    def column(cells: pd.Series) -> pd.Series:
        return cells.map(lambda cell: draw(Draws(seed, cell)))

    return column(F.concat_ws("|", *[F.coalesce((F.col(k) if isinstance(k, str) else k).cast("string"), F.lit("null")) for k in keys]))


def exact_gaussian(seed: str, variance: Fraction | int, *keys: Column | str) -> Column:
    """Discrete Gaussian noise for each row, keyed by its cell; a row of the same keys has the same noise."""
    variance = Fraction(variance)
    if variance <= 0:
        raise ValueError("variance must be positive")
    return _noise(seed, keys, lambda d: d.gaussian(variance))


def exact_laplace(seed: str, scale: int, *keys: Column | str) -> Column:
    """Discrete Laplace noise of an integer scale for each row, keyed by its cell."""
    if scale < 1:
        raise ValueError("scale must be 1 or more")
    return _noise(seed, keys, lambda d: d.laplace(scale))
