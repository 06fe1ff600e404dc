"""The first n rows in an order, for any n: the n-th key is found by counting, and a filter takes the rows up to it. No row moves.

Keys alone are staged once. A round picks pivots (a sample of the distinct keys by their hashes), counts the keys that lie between, before and on
them, and goes on in the gap that the n-th key is in, until it is a pivot or the gap holds few keys, which the driver looks at. Whatever n is, a round
is one aggregate to PIVOTS rows and one to twice as many. Rows that are equal by the order are told apart by a hash of their plain columns; rows that
are equal in that too are interchangeable.

Thresholds are found while the query is built. Nulls come first, as they do in an ascending sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType, StructType, TimestampNTZType, TimestampType

from sparkloom.session import discard, staged

PIVOTS = 512
FEW = 4096


def tie_hash(df: DataFrame) -> Column:
    """A hash of the plain columns."""
    plain = [f.name for f in df.schema if isinstance(f.dataType, AtomicType)]
    return F.xxhash64(*plain) if plain else F.lit(0).cast("long")


def comparable(df: DataFrame, by: list[Column]) -> list[Column]:
    """The columns of an order in types whose values the driver can send back as they were: times as microseconds."""
    kinds = df.select(*[c.alias(f"c{i}") for i, c in enumerate(by)]).schema
    return [F.unix_micros(c) if isinstance(f.dataType, TimestampType) else F.unix_micros(c.cast("timestamp")) if isinstance(f.dataType, TimestampNTZType) else c for c, f in zip(by, kinds, strict=True)]


def _literal(value: Row, kind: StructType) -> Column:
    return F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(value, kind, strict=True)])


def sampled_keys(df: DataFrame, key: Column, about: int) -> list:
    """About so many distinct keys in order (all, if there are fewer), whichever way the rows are dealt: those with the least hashes of `about` classes."""
    hashed = df.select(key.alias("k")).where("k is not null").select("k", F.xxhash64("k").alias("h"))
    least = hashed.groupBy(F.pmod("h", F.lit(about)).alias("b")).agg(F.min_by("k", "h").alias("k"))
    return [r.k for r in least.select("k").distinct().orderBy("k").collect()]


class Keys:
    """The keys of a table's rows in an order, staged; kept until close()."""

    def __init__(self, df: DataFrame, by: list[Column]):
        self.by = [*comparable(df, by), tie_hash(df)]
        self.key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(self.by)])
        self.table = staged(df.select(self.key.alias("k")), "keys")
        self.kind = self.table.schema["k"].dataType

    def close(self) -> None:
        discard(self.table)

    def literal(self, value: Row) -> Column:
        return _literal(value, self.kind)

    def nth(self, n: int) -> tuple[Row, int, int] | None:
        """(the n-th key from 1, rows before it, rows equal to it); none where there are fewer rows."""
        rows, before, left = self.table, 0, None
        while True:
            if left is None or left > FEW:
                pivots = self._pivots(rows, before)
                if not pivots:
                    return None
                found = self._narrowed(rows, pivots, n - before)
                if found is None:
                    return None
                skipped, low, high, count, on = found
                before += skipped
                if on is not None:
                    return on, before, count
                left = count
                if low is not None:
                    rows = rows.where(F.col("k") > self.literal(low))
                if high is not None:
                    rows = rows.where(F.col("k") < self.literal(high))
            else:
                few = rows.groupBy("k").count().orderBy("k").collect()
                for r in few:
                    if before + r["count"] >= n:
                        return r.k, before, r["count"]
                    before += r["count"]
                return None

    def _pivots(self, rows: DataFrame, salt: int) -> list[Row]:
        hashed = rows.select("k", F.xxhash64("k", F.lit(salt)).alias("h"))
        least = hashed.groupBy(F.pmod("h", F.lit(PIVOTS)).alias("b")).agg(F.min_by("k", "h").alias("k"))
        # Sorted by Spark, whose order of structs, texts and nulls is the one that counts; keys of equal hashes may come twice.
        return [r.k for r in least.select("k").distinct().orderBy("k").collect()]

    def _narrowed(self, rows: DataFrame, pivots: list[Row], n: int):
        """Rows before the gap (or pivot) with the n-th row, its ends, its rows, and the pivot itself where that is the n-th."""
        held = F.array(*[self.literal(p) for p in pivots])
        steps = [1 << k for k in range(len(pivots).bit_length() - 1, -1, -1)]
        upto = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda i, step: F.when(F.get(held, i + step - 1) <= F.col("k"), i + step).otherwise(i))
        at = rows.select("k", upto.alias("i")).select(F.when((F.col("i") > 0) & (F.get(held, F.col("i") - 1) == F.col("k")), 2 * F.col("i") - 1).otherwise(2 * F.col("i")).alias("at"))
        counts = dict(at.groupBy("at").count().collect())
        total = 0
        for slot in range(2 * len(pivots) + 1):
            here = counts.get(slot, 0)
            if total + here >= n:
                i = slot // 2
                if slot % 2:
                    return total, None, None, here, pivots[i]
                return total, pivots[i - 1] if i else None, pivots[i] if i < len(pivots) else None, here, None
            total += here
        return None


def upto(keys: Keys, value: Row) -> Column:
    """Rows whose key is at most `value`. The first part of the order is compared by itself too, as that comparison can reach the scan."""
    first = value[0]
    coarse = keys.by[0].isNull() if first is None else keys.by[0].isNull() | (keys.by[0] <= F.lit(first).cast(keys.kind[0].dataType))
    return coarse & (keys.key <= keys.literal(value))


def first_n(df: DataFrame, n: int, *by: str | Column) -> DataFrame:
    """The first n rows by the columns given, in no particular order; all rows where there are fewer."""
    if n < 1:
        return df.limit(0)
    keys = Keys(df, [F.col(c) if isinstance(c, str) else c for c in by])
    found = keys.nth(n)
    keys.close()
    if found is None:
        return df
    value, before, equal = found
    if before + equal == n:
        return df.where(upto(keys, value))
    # More rows are equal in every plain column than are wanted.
    return df.where(upto(keys, value) & (keys.key != keys.literal(value))).unionByName(df.where(keys.key == keys.literal(value)).limit(n - before))
