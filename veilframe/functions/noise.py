"""Noise expressions for differential privacy (T9, DP1, DP2, DP6).

Laplace noise is the inverse distribution function of one uniform draw, Gaussian
noise the Box-Muller transform of two. With a key (a row's or a group's) the
draws are SHA-256 of (seed, name, key): the noise of a row is the same wherever
and however often it is computed, so a noisy column never describes two
datasets. Without a key noise comes from ``rand`` and ``randn`` and depends on the partitioning.
"""

from __future__ import annotations

import hashlib
import math
import secrets
import warnings

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .draws import keyed_uniform


def fresh_seed() -> int:
    """A seed from the OS; production plans use this and never log it."""
    return secrets.randbits(62)


def _own_seed(seed: int, name: str, part: int = 0) -> int:
    """A seed of its own for each unkeyed draw."""
    return int.from_bytes(hashlib.sha256(f"{seed}|{name}|{part}".encode()).digest()[:7], "big")


def laplace_sample(scale: float, seed: int, key: Column | None = None, name: str = "laplace",
                   lane: int = 0) -> Column:
    if scale < 0:
        raise ValueError("scale must be >= 0")

    if key is None:  # the difference of two exponential draws, each used once
        one, two = (F.log(F.lit(1.0) - F.rand(_own_seed(seed, name, part))) for part in (0, 1))
        return (one - two) * F.lit(float(scale))
    return laplace_of(keyed_uniform(key, seed, name, lane), scale)


def laplace_of(uniform: Column, scale: float) -> Column:
    """Laplace noise from a uniform draw (inverse distribution function)."""
    u = uniform - F.lit(0.5)
    return F.signum(u) * F.log(F.lit(1.0) - F.lit(2.0) * F.abs(u)) * F.lit(-float(scale))


def gaussian_sample(sigma: float, seed: int, key: Column | None = None, name: str = "gaussian") -> Column:
    if sigma < 0:
        raise ValueError("sigma must be >= 0")

    if key is None:
        return F.randn(_own_seed(seed, name)) * F.lit(float(sigma))
    radius = F.sqrt(F.lit(-2.0) * F.log(keyed_uniform(key, seed, name)))
    return radius * F.cos(F.lit(2 * math.pi) * keyed_uniform(key, seed, name, 1)) * F.lit(float(sigma))


def add_laplace(c, epsilon: float = 1.0, sensitivity: float = 1.0, seed: int | None = None,
                key: Column | None = None, name: str = "laplace", lane: int = 0) -> Column:
    """T9/DP1: value + Lap(0, sensitivity/epsilon); null stays null."""
    if epsilon <= 0:
        raise ValueError("epsilon must be positive")
    x = (F.col(c) if isinstance(c, str) else c).try_cast(DoubleType())
    return x + laplace_sample(sensitivity / epsilon, fresh_seed() if seed is None else seed, key, name, lane)


def gaussian_sigma(epsilon: float, delta: float, sensitivity: float = 1.0) -> float:
    if epsilon <= 0:
        raise ValueError("epsilon must be positive")
    if not 0 < delta < 1:
        raise ValueError("the Gaussian mechanism needs 0 < delta < 1")
    return sensitivity * math.sqrt(2 * math.log(1.25 / delta)) / epsilon


def add_gaussian(c, epsilon: float = 1.0, delta: float = 1e-5, sensitivity: float = 1.0,
                 seed: int | None = None, key: Column | None = None, name: str = "gaussian") -> Column:
    """DP2: value + N(0, sigma^2), sigma = sens * sqrt(2 ln(1.25/delta)) / epsilon."""
    if epsilon > 1:
        warnings.warn("the Gaussian mechanism's guarantee holds for epsilon up to 1", stacklevel=2)
    sigma = gaussian_sigma(epsilon, delta, sensitivity)
    x = (F.col(c) if isinstance(c, str) else c).try_cast(DoubleType())
    return x + gaussian_sample(sigma, fresh_seed() if seed is None else seed, key, name)


def truth_probability(epsilon: float) -> float:
    return math.exp(epsilon) / (1 + math.exp(epsilon))


def randomized_response(c, epsilon: float = 1.0, p: float | None = None, seed: int | None = None,
                        key: Column | None = None, name: str = "response") -> Column:
    """DP6: keep the true boolean with probability p, else flip it."""
    p = truth_probability(epsilon) if p is None else float(p)
    if not 0 <= p <= 1:
        raise ValueError("p must be in [0, 1]")
    b = (F.col(c) if isinstance(c, str) else c).cast("boolean")
    seed = fresh_seed() if seed is None else seed
    keep = (F.rand(_own_seed(seed, name)) if key is None else keyed_uniform(key, seed, name)) < F.lit(p)
    return F.when(keep, b).otherwise(~b)
