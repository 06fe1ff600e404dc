"""Aggregates over all rows up to each row, of one order or of each group's, without a task that sees a whole group.

Any aggregate that merges can be carried: it names its parts (sums, counts, least, greatest), and how its value is made of them. Rows are dealt into ranges
of the order; a range's parts are aggregated, the parts of the ranges before it are merged into a carry, and a window goes over a range alone. So there
is one small aggregate and one shuffle of rows, and a range of a group is the most that a task sorts.

Nulls come first in the order; rows with equal keys follow a hash of their plain columns, so that every run has the same result. Sums of doubles may
differ in their last digits with the number of ranges.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.operators.mixture import range_of
from sparkloom.operators.selection import tie_hash

_MERGES: dict[str, tuple[Callable, Callable]] = {
    # How a part is aggregated, and how a carry and a later part make one.
    "sum": (F.sum, lambda a, b: F.coalesce(a + b, a, b)),
    "count": (F.count, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
    "min": (F.min, F.least),
    "max": (F.max, F.greatest),
}


@dataclass(frozen=True)
class Running:
    """parts: (merge, column) each; value: of the parts' columns."""

    parts: tuple[tuple[str, Column], ...]
    value: Callable[..., Column]


def rows() -> Running:
    return Running((("count", F.lit(1)),), lambda n: n)


def total(c: Column) -> Running:
    return Running((("sum", c),), lambda s: F.coalesce(s, F.lit(0)))


def least(c: Column) -> Running:
    return Running((("min", c),), lambda x: x)


def greatest(c: Column) -> Running:
    return Running((("max", c),), lambda x: x)


def mean(c: Column) -> Running:
    """Of the values that aren't null; null before the first of them."""
    return Running((("sum", c), ("count", c)), lambda s, n: s / F.nullif(n, F.lit(0)))


def share(condition: Column, percent: bool = False) -> Running:
    """Of the rows so far, those that a condition holds for."""
    return Running((("count", F.when(condition, 1)), ("count", F.lit(1))), lambda k, n: (100.0 if percent else 1.0) * k / n)


def running(df: DataFrame, order: str, aggregates: dict[str, Running], group: list[str] | None = None, ranges: int | None = None) -> DataFrame:
    """The rows with a column for each aggregate over all rows up to it, itself included."""
    group = group or []
    ranged = df.withColumn("_range", range_of(df, order, ranges))
    parts = {f"_{name}{i}": (merge, c) for name, a in aggregates.items() for i, (merge, c) in enumerate(a.parts)}
    totals = ranged.groupBy(*group, "_range").agg(*[_MERGES[merge][0](c).alias(p) for p, (merge, c) in parts.items()])
    # Sums of counts are counts.
    carried = lambda merge: F.sum if merge == "count" else _MERGES[merge][0]
    before = W.partitionBy(*group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    carries = totals.select(*group, "_range", *[carried(merge)(p).over(before).alias(f"{p}_before") for p, (merge, _) in parts.items()])
    if group:
        on = [F.col(f"r.{g}").eqNullSafe(F.col(f"c.{g}")) for g in group]
        joined = ranged.alias("r").join(carries.alias("c"), [*on, F.col("r._range") == F.col("c._range")]).select("r.*", *[f"c.{p}_before" for p in parts])
    else:
        joined = ranged.join(F.broadcast(carries), "_range")  # a row for each range
    so_far = W.partitionBy(*group, "_range").orderBy(order, tie_hash(df)).rowsBetween(W.unboundedPreceding, 0)
    values = {p: _MERGES[merge][1](F.col(f"{p}_before"), _MERGES[merge][0](c).over(so_far)) for p, (merge, c) in parts.items()}
    # Parts first, values then, so that a window function stands for itself.
    placed = joined.select(*df.columns, *[v.alias(p) for p, v in values.items()])
    return placed.select(*df.columns, *[a.value(*[F.col(f"_{name}{i}") for i in range(len(a.parts))]).alias(name) for name, a in aggregates.items()])
