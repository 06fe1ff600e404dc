"""Rows to the intervals that hold their value, where intervals come as a table and may overlap: a range join as an equi join on cells.

An interval goes to the grid whose cells are as wide as it is, or up to twice as wide, and so lies in two cells at most. A value is looked up in one cell
of each grid that has intervals, then compared. So a row makes as many look-ups as there are widths (by powers of two), whatever the number of intervals, and
meets only intervals about its own place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

LEVELS = 62


def in_intervals(df: DataFrame, value: str, intervals: DataFrame, low: str, high: str) -> DataFrame:
    """The rows of df, each with each of the intervals (whole numbers, both ends included) that hold its value; rows in no interval, null values and ends, and
    intervals that end before they begin go. Columns of both sides must have different names."""
    for frame, names in ((df, [value]), (intervals, [low, high])):
        for f in (frame.schema[n] for n in names):
            if not isinstance(f.dataType, IntegralType):
                raise TypeError(f"{f.name} must be a whole number, not {f.dataType.simpleString()}")
    # In doubles, as the widest intervals are wider than a long; a level too many does no harm.
    width = F.col(high).cast("double") - F.col(low).cast("double") + 1
    level = F.least(F.ceil(F.log2(width)).cast("int"), F.lit(LEVELS))
    at = lambda c, k: F.call_function("shiftright", F.col(c).cast("bigint"), k)
    graded = intervals.where(F.col(low) <= F.col(high)).withColumn("_level", level)
    celled = graded.withColumn("_cell", F.explode(F.sequence(at(low, F.col("_level")), at(high, F.col("_level")))))
    # LEVELS + 1 numbers at most.
    levels = sorted(r[0] for r in graded.select("_level").distinct().collect())
    if not levels:
        return df.join(intervals, F.lit(False))
    probes = df.where(F.col(value).isNotNull()).withColumn("_probe", F.explode(F.array(*[F.struct(F.lit(k).alias("level"), at(value, F.lit(k)).alias("cell")) for k in levels])))
    met = probes.join(celled, (F.col("_probe.level") == F.col("_level")) & (F.col("_probe.cell") == F.col("_cell")))
    return met.where(F.col(value).between(F.col(low), F.col(high))).drop("_probe", "_level", "_cell")
