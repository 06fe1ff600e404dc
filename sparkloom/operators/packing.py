"""Laying token lists end to end and cutting them into sequences of one length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.tokens import IGNORED
from sparkloom.operators.corpus import with_position


def sequences(df: DataFrame, order: str, length: int, arrays: list[str], skip: int = 0, size: Column | None = None) -> DataFrame:
    """chunk_id and, for each of the equally long arrays, its part of every sequence; the last may be short. Documents are cut into slices at
    multiples of the length and only slices move, so a token is never a row. Chunks before `skip` are not built. size: how long the arrays are, where that is known without
    building them; bounds and totals of positions then read no array, and each array is built once."""
    sized = df.withColumn("_n", F.size(arrays[0]) if size is None else size.cast("int")).where("_n > 0")
    return cut(with_position(sized, order, "_n"), length, arrays, skip)


def cut(placed: DataFrame, length: int, arrays: list[str], skip: int = 0, most: int | None = None) -> DataFrame:
    """The sequences of rows whose `position` and number of ids `_n` are known; from number `skip` on, up to number `most`."""
    first, last = F.floor(F.col("position") / length), F.floor((F.col("position") + F.col("_n") - 1) / length)
    until = last if most is None else F.least(last, F.lit(most))
    wanted = placed.where(last >= skip) if most is None else placed.where((last >= skip) & (first <= most))
    slices = wanted.select("position", "_n", *arrays, F.explode(F.sequence(F.greatest(first, F.lit(skip)), until)).alias("chunk_id"))
    start = F.greatest(F.col("chunk_id") * length - F.col("position"), F.lit(0))
    end = F.least((F.col("chunk_id") + 1) * length - F.col("position"), F.col("_n").cast("bigint"))
    pieces = slices.select("chunk_id", (F.col("position") + start).alias("at"), *[F.slice(a, (start + 1).cast("int"), (end - start).cast("int")).alias(a) for a in arrays])
    joined = pieces.groupBy("chunk_id").agg(F.sort_array(F.collect_list(F.struct("at", *arrays))).alias("p"))
    return joined.select("chunk_id", *[F.flatten(F.col(f"p.{a}")).alias(a) for a in arrays])


def _count(n_ids: str | None) -> list[Column]:
    return [F.col(n_ids).alias("_ids")] if n_ids else []


def pack_drop_tail(df: DataFrame, order: str, length: int, end_id: int | None, ids: str = "tokens", skip: int = 0, n_ids: str | None = None) -> DataFrame:
    """chunk_id, input_ids: documents with an end id each; an incomplete last sequence goes. No end id counts as 0. n_ids: a column with the number
    of ids, where there is one."""
    ended = df.withColumn("input_ids", F.concat(F.col(ids), F.array(F.lit(end_id or 0))))
    return sequences(ended.select(order, "input_ids", *_count(n_ids)), order, length, ["input_ids"], skip, F.col("_ids") + 1 if n_ids else None).where(F.size("input_ids") == length)


def masked(ids: Column, pad: int) -> Column:
    """Labels: the ids, with every pad id ignored, wherever it comes from."""
    return F.transform(ids, lambda i: F.when(i == pad, IGNORED).otherwise(i))


def pack_pad_tail(df: DataFrame, order: str, length: int, end_id: int, pad: int, ids: str = "tokens", append_end: bool = True, n_ids: str | None = None) -> DataFrame:
    """chunk_id, input_ids, labels; the last sequence is padded. n_ids: a column with the number of ids, where there is one."""
    ended = df.withColumn("input_ids", F.concat(F.col(ids), F.array(F.lit(end_id))) if append_end else F.col(ids))
    packed = sequences(ended.select(order, "input_ids", *_count(n_ids)), order, length, ["input_ids"], size=F.col("_ids") + int(append_end) if n_ids else None)
    full = packed.select("chunk_id", F.concat("input_ids", F.array_repeat(F.lit(pad), F.lit(length) - F.size("input_ids"))).alias("input_ids"))
    return full.withColumn("labels", masked(F.col("input_ids"), pad))


def pack_prompt_mask(df: DataFrame, order: str, length: int, end_id: int, pad: int, prompt: str = "prompt_ids", target: str = "target_ids") -> DataFrame:
    """chunk_id, input_ids, labels: prompts carry no label, targets and end ids do; examples may straddle sequences; the last is padded."""
    target_ids = F.concat(F.col(target), F.array(F.lit(end_id)))
    both = df.select(order, F.concat(F.col(prompt), target_ids).alias("input_ids"), F.concat(F.transform(F.col(prompt), lambda _: F.lit(IGNORED)), target_ids).alias("labels"))
    packed = sequences(both, order, length, ["input_ids", "labels"])
    room = F.lit(length) - F.size("input_ids")
    return packed.select("chunk_id", F.concat("input_ids", F.array_repeat(F.lit(pad), room)).alias("input_ids"), F.concat("labels", F.array_repeat(F.lit(IGNORED), room)).alias("labels"))
