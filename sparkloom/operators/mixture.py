"""Choosing rows: caps, budgets, thresholds, seeded orders, chunks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from sparkloom.functions.text import is_legacy_code
from sparkloom.functions.tokens import estimated_row_bytes
from sparkloom.operators.selection import Keys, comparable, first_n, sampled_keys, tie_hash, upto


def seeded(seed: int, *keys: str) -> Column:
    """A number-like text whose order is random for the seed and the same in every engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def shuffled(df: DataFrame, seed: int, key: str) -> DataFrame:
    return df.orderBy(seeded(seed, key), key)


def take_first(df: DataFrame, n: int, group: list[str], order: list) -> DataFrame:
    """The first n rows of each group. Planned as a group limit before the shuffle, so a hot group costs n rows a task."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def sample_per_group(df: DataFrame, n: int, group: str, seed: int, key: str) -> DataFrame:
    return take_first(df, n, [group], [seeded(seed, key), key])


def quality_take(df: DataFrame, score: str, least: int, n: int, seed: int, key: str) -> DataFrame:
    """The first n in seeded order of the rows that score at least `least`."""
    return first_n(df.where(F.col(score) >= least), n, seeded(seed, key), key)


def estimated_cut(df: DataFrame, target: int, order: str, text: str = "text", mean: int = 700, hard: int = 2_000_000) -> DataFrame:
    """Rows with text, in order, until `mean` tokens each would reach the target."""
    return first_n(df.where(F.coalesce(F.col(text), F.lit("")) != ""), min(hard, max(1, -(-target // mean))), order)


def capped_after(df: DataFrame, cap: int, order: str) -> DataFrame:
    """The first max(cap, 1) rows: the cap is looked at after a row is taken."""
    return first_n(df, max(cap, 1), order)


def current_code(df: DataFrame, cap: int, order: str, code: str = "code") -> DataFrame:
    """Rows that no legacy pattern matches, up to the first of them that is the cap-th row examined or a later one. Rows without code aren't
    examined. The cap-th key and the key of that last row are found by counting and by a minimum; a filter takes the rest."""
    rows = df.where(F.coalesce(F.col(code), F.lit("")) != "")
    passing = rows.where(~is_legacy_code(F.col(code)))
    keys = Keys(rows, [F.col(order)])
    found = keys.nth(max(cap, 1))
    keys.close()
    if found is None:
        return passing
    last = passing.where(keys.key >= keys.literal(found[0])).agg(F.min(keys.key).alias("k")).first().k
    return passing if last is None else passing.where(upto(keys, last))


def legacy_rate(df: DataFrame, code: str = "code") -> DataFrame:
    """examined, rejected, rejected_percent."""
    rows = df.where(F.coalesce(F.col(code), F.lit("")) != "")
    return rows.agg(F.count("*").alias("examined"), F.count_if(is_legacy_code(F.col(code))).alias("rejected")).withColumn("rejected_percent", 100.0 * F.col("rejected") / F.greatest("examined", F.lit(1)))


def running_legacy_rate(df: DataFrame, order: str, every: int, code: str = "code") -> DataFrame:
    """The order key, examined, rejected_percent so far, after every `every` rows with code."""
    from sparkloom.operators import prefix

    rows = df.where(F.coalesce(F.col(code), F.lit("")) != "").select(order, is_legacy_code(F.col(code)).alias("legacy"))
    told = {"examined": prefix.rows(), "rejected_percent": prefix.share(F.col("legacy"), percent=True)}
    return prefix.running(rows, order, told).where(F.col("examined") % every == 0).drop("legacy")


def range_of(df: DataFrame, order: str, ranges: int | None = None) -> Column:
    """Number of the range of `order` that a row is in, of about as many rows each; nulls are in the first, as they sort first. There are as many
    ranges as shuffle partitions, 64 at least, so that a range stays one task's work as tables and clusters grow; bounds are found in a literal
    array by bisection. Numbers have bounds by rows; other keys (texts, times) by a sample of the distinct ones. Bounds are looked up while the query is built."""
    n = ranges or max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    key = comparable(df, [F.col(order)])[0]
    if isinstance(df.select(order).schema[0].dataType, NumericType):
        bounds = sorted(set(df.agg(F.percentile_approx(order, [k / n for k in range(1, n)], max(10_000, 10 * n))).first()[0] or []))
    else:
        keys = sampled_keys(df, key, 8 * n)
        bounds = list(dict.fromkeys(keys[k * len(keys) // n] for k in range(1, n))) if keys else []
    if not bounds:
        return F.lit(0)
    steps = [1 << k for k in range(len(bounds).bit_length() - 1, -1, -1)]
    held = F.array(*[F.lit(b) for b in bounds])
    found = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda i, step: F.when(F.get(held, i + step - 1) <= key, i + step).otherwise(i))
    return F.when(F.col(order).isNull(), 0).otherwise(found)


def plan_table(spark: SparkSession, plan: dict[str, tuple[int, int]]) -> DataFrame:
    """source, target, cap: a few rows, one for each source that is planned."""
    return spark.createDataFrame([(s, t, c) for s, (t, c) in plan.items()], "source string, target bigint, cap bigint")


def budget_cut(df: DataFrame, plan: DataFrame, order: str, tokens: str = "n_tokens", buckets: int | None = None) -> DataFrame:
    """Per source: rows in order while the tokens before them are under the target and the rows before them under the cap; the row that
    crosses the target stays. Sources without a plan pass whole. Null keys come first, equal keys go by tokens and then a hash of the plain columns.

    Both conditions are monotone, so the kept rows are a prefix. A source may hold a third of all rows, so none is sorted by one task: rows
    are dealt into ranges of the order within the source, ranges' totals give each its base, and only within a range is there a window."""
    planned = df.join(F.broadcast(plan), "source", "left")
    ranged = planned.withColumn("_range", range_of(df, order, buckets))
    totals = ranged.where("target is not null").groupBy("source", "_range").agg(F.sum(tokens).alias("_t"), F.count("*").alias("_c"))
    before = W.partitionBy("source").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    bases = totals.select("source", "_range", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_t0"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_c0"))
    # Ranges that start at or beyond the target or the cap are dropped before any row is sorted.
    live = ranged.join(F.broadcast(bases), ["source", "_range"], "left").where("target is null or (_t0 < target and _c0 < cap)")
    rows_before = W.partitionBy("source", "_range").orderBy(order, tokens, tie_hash(df)).rowsBetween(W.unboundedPreceding, -1)
    spent = F.col("_t0") + F.coalesce(F.sum(tokens).over(rows_before), F.lit(0))
    kept = F.col("_c0") + F.coalesce(F.count(F.lit(1)).over(rows_before), F.lit(0))
    out = live.where("target is not null").withColumn("_ok", (spent < F.col("target")) & (kept < F.col("cap"))).where("_ok").drop("_ok")
    return out.unionByName(live.where("target is null")).select(*df.columns)


def chunk_by_rows(df: DataFrame, order: str, limit: int) -> DataFrame:
    """chunk_id by position; positions come from range totals, not from one sorted task."""
    from sparkloom.operators.corpus import with_position

    return with_position(df, order).withColumn("chunk_id", F.floor(F.col("position") / limit).cast("bigint")).drop("position")


def _next_starts(sizes: np.ndarray, rows: int, size: int) -> np.ndarray:
    """Where the next chunk starts, for a chunk that starts at each row."""
    total = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(len(sizes))
    return np.minimum(at + rows, np.searchsorted(total, total[:-1] + size, side="left").clip(at + 1))


def chunk_by_rows_and_bytes(df: DataFrame, order: str, rows: int, size: int, tokens: str = "n_tokens", source: str = "source", shard: str | None = None, span: int | None = None) -> DataFrame:
    """chunk_id of a writer that closes a chunk when it has `rows` rows or `size` estimated bytes, in the order of a key; `shard` splits the table into files
    that are cut each by itself.

    Each chunk's start depends on the one before, but a chunk that is open where a span of rows begins ends within its first `rows` rows. So each
    span (with the first `rows` rows of the next, to see its last chunks' ends) tells for every such place where a chunk that starts there
    leads to in the next span, and how many chunks on. One task follows these maps from span to span, one at a time; then spans are labelled. span: rows in
    a span, `rows` at least; by default as many spans as shuffle partitions. Keys are unique within a shard; rows without
    a shard are one of their own, rows of unknown size count as empty."""
    from sparkloom.operators.corpus import with_position

    if rows < 1 or size < 1:
        raise ValueError("rows and size must be at least 1")
    name = F.coalesce(F.concat(F.lit("="), F.col(shard).cast("string")), F.lit("")) if shard else F.lit("")
    size_of = F.coalesce(estimated_row_bytes(F.col(tokens), F.col(source)).cast("bigint"), F.lit(0).cast("bigint"))
    keyed = df.withColumn("_shard", name).withColumn("_bytes", size_of)
    if shard:
        # A shard is a file, so its window is of bounded size, as in corpus.holdout.
        placed = keyed.withColumn("_at", F.row_number().over(W.partitionBy("_shard").orderBy(order)).cast("bigint") - 1)
    else:
        placed = with_position(keyed, order).withColumnRenamed("position", "_at")
    spark = df.sparkSession
    m = max(rows, span or -(-df.count() // max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    narrow = placed.select("_shard", "_at", "_bytes", F.floor(F.col("_at") / m).cast("bigint").alias("_span"))
    ahead = narrow.where((F.col("_span") > 0) & (F.col("_at") - F.col("_span") * m < rows)).withColumn("_span", F.col("_span") - 1)
    spans = narrow.unionByName(ahead).groupBy("_shard", "_span")

    def lead(rows_of: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
        rows_of = rows_of.sort_values("_at")
        at, own = rows_of["_at"].to_numpy(), int((rows_of["_at"] < (rows_of["_span"].iloc[0] + 1) * m).sum())
        return at, _next_starts(rows_of["_bytes"].to_numpy(), rows, size), own

    def maps(rows_of: pd.DataFrame) -> pd.DataFrame:
        _, after, own = lead(rows_of)
        out, steps = after[:own].copy(), np.ones(own, np.int64)
        for i in range(own - 1, -1, -1):
            if after[i] < own:
                out[i], steps[i] = out[after[i]], steps[after[i]] + 1
        n = min(rows, own)
        return pd.DataFrame({"_shard": [rows_of["_shard"].iloc[0]], "_span": [rows_of["_span"].iloc[0]], "own": [own], "out": [(out[:n] - own).astype(np.int64)], "steps": [steps[:n]]})

    def follow(batches):
        shard_now, entry, chunk = None, 0, 0
        for b in batches:
            told = []
            for s, k, own, out, steps in zip(b["_shard"], b["_span"], b["own"], b["out"], b["steps"], strict=True):
                if s != shard_now:
                    shard_now, entry, chunk = s, 0, 0
                told.append((s, k, entry, chunk))
                if entry < own:
                    entry, chunk = int(out[entry]), chunk + int(steps[entry])
                else:
                    entry -= own
            yield pd.DataFrame(told, columns=["_shard", "_span", "_entry", "_chunk"])

    def label(rows_of: pd.DataFrame) -> pd.DataFrame:
        at, after, own = lead(rows_of)
        start, starts = int(rows_of["_entry"].iloc[0]), np.zeros(own, np.int64)
        while start < own:
            starts[start] = 1
            start = int(after[start])
        ids = rows_of["_chunk"].iloc[0] - 1 + np.cumsum(starts)
        return pd.DataFrame({"_shard": rows_of["_shard"].iloc[0], "_at": at[:own], "chunk_id": ids})

    led = spans.applyInPandas(maps, "_shard string, _span bigint, own bigint, out array<bigint>, steps array<bigint>")
    entries = led.repartition(1).sortWithinPartitions("_shard", "_span").mapInPandas(follow, "_shard string, _span bigint, _entry bigint, _chunk bigint")
    entered = narrow.unionByName(ahead).join(entries, ["_shard", "_span"])
    cut = entered.groupBy("_shard", "_span").applyInPandas(label, "_shard string, _at bigint, chunk_id bigint")
    return placed.join(cut, ["_shard", "_at"]).drop("_shard", "_at", "_bytes")
