"""Token tables: statistics, splits, positions, batches, length buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from sparkloom.operators import prefix
from sparkloom.operators.mixture import range_of, seeded
from sparkloom.operators.selection import first_n
from sparkloom.session import staged

BUCKETS = (1024, 2048, 4096, 8192, 16384)


def only_sources(df: DataFrame, sources: list[str] | None) -> DataFrame:
    """Rows of these sources; the predicate reaches the scan. None keeps all."""
    return df if sources is None else df.where(F.col("source").isin(sources))


def shard_stats(df: DataFrame, shard: str = "shard") -> DataFrame:
    return df.groupBy(shard, "source").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens"))


def source_stats(df: DataFrame) -> DataFrame:
    """docs and tokens per source, and in all (source null)."""
    return df.rollup("source").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens"))


def running_stats(df: DataFrame, order: str, by_source: bool = False) -> DataFrame:
    """source, the order key, and docs, tokens, the shortest, longest and mean n_tokens up to each row, over all sources or each by itself."""
    n = F.col("n_tokens")
    told = {"docs": prefix.rows(), "tokens": prefix.total(n), "shortest": prefix.least(n), "longest": prefix.greatest(n), "mean_tokens": prefix.mean(n)}
    return prefix.running(df.select("source", order, "n_tokens"), order, told, ["source"] if by_source else None).drop("n_tokens")


def with_position(df: DataFrame, order: str, weight: str | None = None, ranges: int | None = None) -> DataFrame:
    """Adds `position`: the rows before (or the sum of their weights), in the order of a key: nulls first, and among equal keys by weight, then by a
    hash of the plain columns. Rows are dealt into ranges of the key; the ranges' totals, a number of rows that doesn't grow with the table's,
    give each its base; the running sum is within a range. No task sees the table."""
    w = F.lit(1) if weight is None else F.coalesce(F.col(weight), F.lit(0))
    ranged = df.withColumn("_range", range_of(df, order, ranges))
    totals = ranged.groupBy("_range").agg(F.sum(w).alias("_w"))
    base = totals.select("_range", F.coalesce(F.sum("_w").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    plain = [f.name for f in df.schema if isinstance(f.dataType, AtomicType)]
    ties = [w, F.xxhash64(*plain)] if plain else [w]
    before = W.partitionBy("_range").orderBy(order, *ties[weight is None :]).rowsBetween(W.unboundedPreceding, -1)
    return ranged.join(F.broadcast(base), "_range").withColumn("position", (F.col("_base") + F.coalesce(F.sum(w).over(before), F.lit(0))).cast("bigint")).drop("_range", "_base")


def holdout(df: DataFrame, fraction: float, shard: str, order: str) -> DataFrame:
    """Adds `held_out`: the last max(1, floor(n * fraction)) rows of each shard. A shard is a file, so its window is of bounded size."""
    by = W.partitionBy(shard)
    tail = F.greatest(F.lit(1), F.floor(F.count("*").over(by) * fraction))
    return df.withColumn("held_out", F.row_number().over(by.orderBy(F.col(order).desc())) <= tail)


def holdout_by_place(df: DataFrame, fraction: float, shard: str = "shard", place: str = "row_index", chosen: Column | None = None) -> DataFrame:
    """Adds `held_out` as holdout does, for rows that carry their file and their place in it, as readers.token_shards gives them. Rows aren't moved: a file has
    one number, the place from which on it is held out, and a scan compares. Without a choice that number comes from counts by file, which read no column; with
    one (a condition), only chosen rows are left, a file's last are counted among them, and files and places alone are sorted. Nothing is held out at
    fraction 0."""
    rows = df if chosen is None else df.where(chosen)
    if fraction <= 0:
        return rows.withColumn("held_out", F.lit(False))
    if chosen is None:
        marks = rows.groupBy(shard).agg(F.count(F.lit(1)).alias("n")).select(shard, (F.col("n") - F.greatest(F.lit(1), F.floor(F.col("n") * fraction))).alias("_from"))
    else:
        ranked = rows.select(shard, place, F.row_number().over(W.partitionBy(shard).orderBy(F.col(place).desc())).alias("r"), F.count("*").over(W.partitionBy(shard)).alias("n"))
        marks = ranked.where(F.col("r") <= F.greatest(F.lit(1), F.floor(F.col("n") * fraction))).groupBy(shard).agg(F.min(place).alias("_from"))
    # Staged, so that Spark knows its size: it is sent to all tasks where that is small, and joined by shuffle where there are very many files.
    return rows.join(staged(marks, "marks"), shard).withColumn("held_out", F.col(place) >= F.col("_from")).drop("_from")


def training_rows(df: DataFrame, fraction: float, shard: str, order: str) -> DataFrame:
    """Rows to train on; nothing is held out at fraction 0."""
    return df if fraction <= 0 else holdout(df, fraction, shard, order).where("not held_out").drop("held_out")


def validation_rows(df: DataFrame, fraction: float, shard: str, order: str) -> DataFrame:
    """Rows to validate on; none at fraction 0, so that no row is in both."""
    return df.limit(0) if fraction <= 0 else holdout(df, fraction, shard, order).where("held_out").drop("held_out")


def without(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    return df.join(other.select(key).distinct(), key, "left_anti")


def validation_sample(df: DataFrame, n: int, least_tokens: int, seed: int, key: str) -> DataFrame:
    """n rows in seeded order, then those that are long enough: the length is looked at after the sample is drawn."""
    return first_n(df, n, seeded(seed, key), key).where(F.col("n_tokens") >= least_tokens)


def fixed_batches(df: DataFrame, size: int, seed: int, key: str) -> DataFrame:
    """batch_id and place in seeded order; the rows of an incomplete last batch go."""
    n = df.count()
    placed = with_position(df.withColumn("_o", F.conv(F.substring(seeded(seed, key), 1, 15), 16, 10).cast("bigint")), "_o")
    return placed.where(F.col("position") < n // size * size).select(*df.columns, F.floor(F.col("position") / size).cast("bigint").alias("batch_id"), (F.col("position") % size).alias("place"))


def length_buckets(df: DataFrame, per_bucket: int, seed: int, key: str, buckets: tuple[int, ...] = BUCKETS) -> DataFrame:
    """Up to per_bucket rows whose n_tokens is within a tenth of a bucket; buckets don't overlap, so a row is in one at most."""
    bucket = F.lit(None).cast("int")
    for b in buckets:
        bucket = F.when(F.col("n_tokens").between(int(0.9 * b), int(1.1 * b)), b).otherwise(bucket)
    rows = df.withColumn("bucket", bucket).where("bucket is not null")
    return rows.withColumn("_n", F.row_number().over(W.partitionBy("bucket").orderBy(seeded(seed, key), key))).where(F.col("_n") <= per_bucket).drop("_n")
