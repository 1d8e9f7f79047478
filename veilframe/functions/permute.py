"""A keyed bijection of 0..n-1, as Spark expressions (used by T4).

The numbers below ``a * b``, with ``a`` about the square root of n and ``a * b``
the least multiple of ``a`` from n on, are pairs (left < a, right < b). Each round of an
unbalanced Feistel network adds a keyed function of one half to the other,
modulo the other's size, so every round, and all of them, can be undone. Fewer
than ``a`` numbers lie from n on; a number that lands there is passed through
again (cycle walking), which keeps the whole a bijection of 0..n-1. That happens
to about one in sqrt(n) numbers, and again to as few of those.

The keyed functions are two affine steps modulo two primes; their constants come
from SHA-256 of the seed, the name and the round, on the driver. All products
stay below 2^62.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Primes below 2^31, so that products of two residues fit 62 bits.
PRIMES = (2**31 - 1, 2**31 - 19)
ROUNDS = 6
#: Passes through the network after the first that are ever needed, by a chance beyond any table.
WALK = 64


@dataclass(frozen=True)
class Permutation:
    """The network for n numbers under a seed and a name."""

    n: int
    seed: int
    name: str

    @property
    def sizes(self) -> tuple[int, int]:
        a = max(1, math.isqrt(max(0, self.n - 1)) + 1)
        return a, max(1, -(-self.n // a))

    def constants(self) -> list[tuple[int, int, int, int]]:
        """Four residues a round, from SHA-256 of ``seed|name|round``."""
        out = []
        for r in range(ROUNDS):
            digest = hashlib.sha256(f"{self.seed}|{self.name}|{r}".encode()).digest()
            x = [int.from_bytes(digest[8 * i : 8 * i + 8], "big") for i in range(4)]
            out.append((1 + x[0] % (PRIMES[0] - 1), x[1] % PRIMES[0], 1 + x[2] % (PRIMES[1] - 1), x[3] % PRIMES[1]))
        return out

    def walks(self) -> int:
        """Passes after the first that a number can need: no more than there are numbers from n on."""
        a, b = self.sizes
        return min(WALK, a * b - self.n)

    def apply(self, i: int) -> int:
        """The bijection in plain Python."""
        x = self._pass(i)
        while x >= self.n:
            x = self._pass(x)
        return x

    def _pass(self, x: int) -> int:
        a, b = self.sizes
        left, right = x // b, x % b
        for r, (m1, c1, m2, c2) in enumerate(self.constants()):
            y = ((right if r % 2 == 0 else left) * m1 + c1) % PRIMES[0]
            y = (y * m2 + c2) % PRIMES[1]
            if r % 2 == 0:
                left = (left + y) % a
            else:
                right = (right + y) % b
        return left * b + right

    def place(self, df: DataFrame, i: str, out: str) -> DataFrame:
        """``df`` with the bijection of its bigint column ``i`` (numbers below n) as ``out``.

        Every round of the first pass is a projection of its own, which Spark doesn't merge with the
        next, so each number is computed once; the few that land from n on are walked by ``aggregate``.
        """
        a, b = self.sizes
        left, right = f"{out}_left", f"{out}_right"
        staged = df.withColumns({left: F.call_function("div", F.col(i), F.lit(b)), right: F.col(i) % F.lit(b)})
        for r, constants in enumerate(self.constants()):
            half, other, size = (right, left, a) if r % 2 == 0 else (left, right, b)
            staged = staged.withColumn(other, (F.col(other) + _keyed(F.col(half), constants)) % F.lit(size))
        staged = staged.withColumn(out, F.col(left) * F.lit(b) + F.col(right)).drop(left, right)
        if self.walks():
            staged = staged.withColumn(out, F.when(F.col(out) < self.n, F.col(out)).otherwise(self._walked(F.col(out))))
        return staged

    def _walked(self, x: Column) -> Column:
        """The first number below n on the way from x; it fails rather than give a wrong place."""
        steps = F.sequence(F.lit(1), F.lit(self.walks()))
        lost = F.raise_error(F.lit("a number of the permutation did not come back")).cast("bigint")
        return F.aggregate(steps, x, lambda y, _: F.when(y < self.n, y).otherwise(self._pass_column(y)),
                           lambda y: F.when(y < self.n, y).otherwise(lost))

    def _pass_column(self, x: Column) -> Column:
        a, b = self.sizes
        left, right = F.call_function("div", x, F.lit(b)), x % F.lit(b)
        for r, constants in enumerate(self.constants()):
            if r % 2 == 0:
                left = (left + _keyed(right, constants)) % F.lit(a)
            else:
                right = (right + _keyed(left, constants)) % F.lit(b)
        return left * F.lit(b) + right


def _keyed(half: Column, constants: tuple[int, int, int, int]) -> Column:
    m1, c1, m2, c2 = constants
    return ((half * F.lit(m1) + F.lit(c1)) % F.lit(PRIMES[0]) * F.lit(m2) + F.lit(c2)) % F.lit(PRIMES[1])
