"""Seeded shuffles by arithmetic: a keyed permutation of the positions 0 to n - 1.

A position x below a * b (a and b about the root of n) is a pair (x // b, x % b). Rounds add a keyed function of one part to the other, modulo a and b in
turns, which can be taken back, so all rounds together are a permutation. Positions that it sends to n or beyond are sent on until they are below n (a
walk along the cycle); the driver follows the fewer than a such positions there are and so knows how many steps the longest walk has.

So the place of a row in any epoch, its batch, and the row at any place are each computed from one number: nothing is sorted or moved.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
LOW31 = (1 << 31) - 1
MOST = 1 << 44  # so that there are at most 2 ** 22 positions to follow


@dataclass(frozen=True)
class Permutation:
    n: int
    seed: int = 42
    epoch: int = 0

    def __post_init__(self):
        if not 0 <= self.n <= MOST:
            raise ValueError(f"n must be between 0 and {MOST}")

    @cached_property
    def sides(self) -> tuple[int, int]:
        a = max(1, math.isqrt(max(self.n - 1, 0)) + 1)
        return a, max(1, -(-self.n // a))

    @cached_property
    def keys(self) -> list[tuple[int, int, int]]:
        """For each round an odd factor, a summand and another odd factor, of up to 31 bits."""
        digests = [hashlib.md5(f"{self.seed}:{self.epoch}:{r}".encode()).digest() for r in range(ROUNDS)]
        part = lambda d, k: int.from_bytes(d[4 * k : 4 * k + 4], "little") & LOW31
        return [(part(d, 0) | 1, part(d, 1), part(d, 2) | 1) for d in digests]

    @cached_property
    def steps(self) -> int:
        """How often a position may have to be sent on."""
        a, b = self.sides
        x, k = np.arange(self.n, a * b, dtype=np.int64), 0
        # Walks begin where a position below n is sent to n or beyond; other cycles stay there for ever.
        x = x[self._sent(x, back=True) < self.n]
        while x.size:
            x = self._sent(x)
            x, k = x[x >= self.n], k + 1
        return k

    @staticmethod
    def _mixed(v: np.ndarray, key: tuple[int, int, int]) -> np.ndarray:
        t = v * key[0] + key[1]
        return (((t ^ (t >> 15)) & LOW31) * key[2]) >> 20

    def _sent(self, x: np.ndarray, back: bool = False) -> np.ndarray:
        a, b = self.sides
        left, right = x // b, x % b
        for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if r % 2 == 0:
                change = self._mixed(right, self.keys[r])
                left = (left - change if back else left + change) % a
            else:
                change = self._mixed(left, self.keys[r])
                right = (right - change if back else right + change) % b
        return left * b + right

    def _column(self, x: Column, back: bool) -> Column:
        a, b = (F.lit(v).cast("long") for v in self.sides)
        rounds = [F.struct(F.lit(r % 2 == 0).alias("first"), *[F.lit(v).cast("long").alias(f"k{i}") for i, v in enumerate(self.keys[r])]) for r in range(ROUNDS)]

        def step(p: Column, k: Column) -> Column:
            pick = lambda if_first, otherwise: F.when(k["first"], if_first).otherwise(otherwise)
            t = pick(p["r"], p["l"]) * k["k0"] + k["k1"]
            change = F.shiftright(t.bitwiseXOR(F.shiftright(t, 15)).bitwiseAND(F.lit(LOW31).cast("long")) * k["k2"], 20)
            own = pick(p["l"], p["r"])
            new = F.pmod(own - change if back else own + change, pick(a, b))
            return F.struct(pick(new, p["l"]).alias("l"), pick(p["r"], new).alias("r"))

        def once(v: Column) -> Column:
            pair = F.struct(F.call_function("div", v, b).alias("l"), F.pmod(v, b).alias("r"))
            return F.aggregate(F.array(*(rounds[::-1] if back else rounds)), pair, step, lambda p: p["l"] * b + p["r"])

        n = F.lit(self.n).cast("long")
        walked = once(x.cast("long"))
        if self.steps:
            walked = F.aggregate(F.array_repeat(F.lit(0), F.lit(self.steps)), walked, lambda v, _: F.when(v >= n, once(v)).otherwise(v))
        return F.when((x >= 0) & (x < n), walked)

    def place(self, position: Column) -> Column:
        """Where the row at a position comes in this epoch; null outside 0 to n - 1."""
        return self._column(position, False)

    def position(self, place: Column) -> Column:
        """The position of the row that comes at a place."""
        return self._column(place, True)

    def positions(self, places: list[int] | np.ndarray) -> np.ndarray:
        """The same for a few places, without Spark."""
        x = np.asarray(places, dtype=np.int64)
        if x.size and (x.min() < 0 or x.max() >= self.n):
            raise IndexError("places must be between 0 and n - 1")
        x = self._sent(x, back=True)
        while (x >= self.n).any():
            x = np.where(x >= self.n, self._sent(x, back=True), x)
        return x


def epoch_batches(df: DataFrame, n: int, size: int, seed: int, epoch: int = 0, position: str = "position") -> DataFrame:
    """Adds batch_id and place of this epoch to n rows at positions 0 to n - 1; the rows of an incomplete last batch go. A projection and a filter."""
    place = Permutation(n, seed, epoch).place(F.col(position))
    placed = df.withColumn("_place", place).where(F.col("_place") < n // size * size)
    return placed.withColumn("batch_id", F.call_function("div", F.col("_place"), F.lit(size))).withColumn("place", F.col("_place") % size).drop("_place")


def sample(df: DataFrame, n: int, k: int, seed: int, position: str = "position") -> DataFrame:
    """k of n rows at positions 0 to n - 1 (all, if fewer), each set as likely as the next: those whose place is below k."""
    return df.where(Permutation(n, seed).place(F.col(position)) < k)
