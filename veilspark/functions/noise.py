"""Noise columns.

The keyed forms draw from a hash of a seed and a cell, so any engine can redo them; they
serve tests and audits and give no privacy unless the seed is secret. For a private
release draw the seed from the operating system (fresh_seed) and release each measurement once.
"""

from __future__ import annotations

import math
import secrets

from pyspark.sql import Column
from pyspark.sql import functions as F


def fresh_seed() -> str:
    return secrets.token_hex(16)


def keyed_uniform(seed: str, *keys: Column | str) -> Column:
    """A number in (0, 1) from the first 32 bits of md5(seed|keys)."""
    text = F.concat_ws("|", F.lit(seed), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys])
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") + 1) / F.lit(4294967297.0)


def keyed_gaussian(seed: str, sigma: float, *keys: Column | str) -> Column:
    """Normal noise by Box and Muller."""
    radius = F.sqrt(-2 * F.log(keyed_uniform(seed + "a", *keys)))
    return sigma * radius * F.cos(2 * math.pi * keyed_uniform(seed + "b", *keys))


def keyed_laplace(seed: str, scale: float, *keys: Column | str) -> Column:
    u = keyed_uniform(seed, *keys) - 0.5
    return -scale * F.signum(u) * F.log(1 - 2 * F.abs(u))


def keyed_gumbel(seed: str, scale: float, *keys: Column | str) -> Column:
    return -scale * F.log(-F.log(keyed_uniform(seed, *keys)))


def gaussian_sigma(rho: float, sensitivity: float = 1.0) -> float:
    """Standard deviation of the Gaussian mechanism under rho-zCDP."""
    return sensitivity / math.sqrt(2 * rho)


def laplace_scale(epsilon: float, sensitivity: float = 1.0) -> float:
    return sensitivity / epsilon


def gumbel_scale(rho: float, sensitivity: float = 1.0) -> float:
    """Scale with which noisy-max selection satisfies rho-zCDP."""
    return sensitivity * math.sqrt(1 / (2 * rho))


def quieter(epsilon: float, rho: float, l1: float, l2: float) -> tuple[str, float]:
    """Of Laplace and Gaussian noise the one of less variance, with its parameter."""
    b, sigma = laplace_scale(epsilon, l1), gaussian_sigma(rho, l2)
    return ("laplace", b) if math.sqrt(2) * b < sigma else ("gaussian", sigma)
